"""Sessions with the settings that the operators are designed for, and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(app: str = "tessera", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with DEFAULTS, overridden by conf. Partition counts stay the cluster's own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | (conf or {})).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as there are cores, where it has fewer: for small rows that cost far more to work on than to move."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def load_views(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> None:
    """Register the tables as temporary views; nothing is read before a query needs it."""
    for name in names:
        load(spark, directory, name).createOrReplaceTempView(name)
