"""Reading the driver's tables: only the columns that a query needs, in small batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches between the JVM and Python have at most BATCH_BYTES of the session's whole texts.

    Each running task holds some batches on either side; by rows alone, long texts would make them large.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df
