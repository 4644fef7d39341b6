"""The registry of queries: a Spark callable for each name, and the SQL it is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import TABLES, load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the equivalent SQL if there is one."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return put


def same_sql(name: str, text: str, spark_text: str | None = None) -> None:
    """Register a query whose plan is best left to SQL: the text, or Spark's own variant of it."""
    body = spark_text or text
    used = [t for t in TABLES if re.search(rf"\b{t}\b", body)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            load(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(body)

    query(text, name)(run)
