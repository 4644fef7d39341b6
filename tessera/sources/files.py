"""File sources and sinks, literal rows, and settings for object stores."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text", "avro", "iceberg", "delta")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, columns: Sequence[str] = (), where: str | None = None, **options) -> DataFrame:
    """A scan whose columns and filter reach the files where the format can take them. iceberg, delta and avro need their jars."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by its join keys: later joins and aggregates on them need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_hypertable(df: DataFrame, path: str, at: str, chunk_ms: int, keys: Sequence[str] = (), codec: str = "zstd", mode: str = "append") -> None:
    """A time-series table in chunks of chunk_ms (by `at`, epoch milliseconds), each sorted by keys and time and compressed: a folder _chunk=<start> for each."""
    start = (F.floor(F.col(at) / chunk_ms) * chunk_ms).cast("long")
    rows = df.withColumn("_chunk", start).repartition("_chunk", *keys).sortWithinPartitions("_chunk", *keys, at)
    rows.write.mode(mode).partitionBy("_chunk").option("compression", codec).parquet(path)


def read_hypertable(spark: SparkSession, path: str, at: str, chunk_ms: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """Samples with start <= at <= end; only their chunks are listed and read."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.where((F.col("_chunk") > start - chunk_ms) & (F.col(at) >= start))
    if end is not None:
        df = df.where((F.col("_chunk") <= end) & (F.col(at) <= end))
    return df.drop("_chunk")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, rows) of a hypertable."""
    return spark.read.parquet(path).groupBy(F.col("_chunk").cast("long").alias("chunk")).agg(F.count(F.lit(1)).alias("rows"))


def drop_chunks(spark: SparkSession, path: str, before: int, chunk_ms: int) -> list[int]:
    """Retention: delete the folders of chunks that end at or before `before`; their starts are returned. Nothing is rewritten."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = []
    for status in fs.listStatus(there):
        name = status.getPath().getName()
        if name.startswith("_chunk=") and int(name[7:]) + chunk_ms <= before:
            fs.delete(status.getPath(), True)
            gone.append(int(name[7:]))
    return sorted(gone)


def values(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def dual(spark: SparkSession) -> DataFrame:
    """One row without columns of use: SELECT without FROM."""
    return spark.range(1).select(F.lit("X").alias("dummy"))


def point_lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def tiered_scan(hot: DataFrame, warm: DataFrame, cold: DataFrame, at: str, now, start=None, end=None, hot_hours: int = 48, warm_days: int = 30) -> DataFrame:
    """One table from three tiers by age, with `tier`; a tier whose ages don't overlap start..end isn't read."""
    h = F.timestamp_add("HOUR", F.lit(-hot_hours), F.lit(now))
    w = F.timestamp_add("DAY", F.lit(-warm_days), F.lit(now))
    parts = [(hot, "hot", F.col(at) >= h), (warm, "warm", (F.col(at) < h) & (F.col(at) >= w)), (cold, "cold", F.col(at) < w)]
    out = None
    for df, name, rule in parts:
        rows = df.where(rule)
        if start is not None:
            rows = rows.where(F.col(at) >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col(at) <= F.lit(end))
        rows = rows.withColumn("tier", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def object_store_conf(connection: str) -> dict[str, str]:
    """Hadoop settings from a connection string.

    s3://key:secret@endpoint/bucket?region=r (MinIO: an endpoint with a port, path-style access), or
    Azure's `DefaultEndpointsProtocol=...;AccountName=...;AccountKey=...;BlobEndpoint=...`.
    """
    if "AccountName=" in connection:
        parts = dict(p.split("=", 1) for p in connection.split(";") if "=" in p)
        account = parts["AccountName"]
        out = {f"spark.hadoop.fs.azure.account.key.{account}.dfs.core.windows.net": parts["AccountKey"]}
        if "BlobEndpoint" in parts:
            out[f"spark.hadoop.fs.azure.account.endpoint.{account}"] = parts["BlobEndpoint"]
        return out
    u = urlparse(connection)
    query = dict(p.split("=", 1) for p in u.query.split("&") if "=" in p)
    out = {"spark.hadoop.fs.s3a.access.key": u.username or "", "spark.hadoop.fs.s3a.secret.key": u.password or ""}
    if u.hostname:
        secure = query.get("secure", "false" if u.port else "true")
        out["spark.hadoop.fs.s3a.endpoint"] = f"{'https' if secure == 'true' else 'http'}://{u.hostname}" + (f":{u.port}" if u.port else "")
        out["spark.hadoop.fs.s3a.path.style.access"] = "true" if u.port else "false"
    if "region" in query:
        out["spark.hadoop.fs.s3a.endpoint.region"] = query["region"]
    return out
