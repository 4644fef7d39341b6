"""information_schema as DataFrames over the session's catalog, and the constraints declared with tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_constraints: list[tuple[str, str, str, list[str]]] = []


def declare(table: str, kind: str, columns: Sequence[str], name: str | None = None) -> None:
    """Remember a PRIMARY KEY, UNIQUE or FOREIGN KEY; Spark doesn't enforce it."""
    _constraints.append((name or f"{table}_{'_'.join(columns)}_{kind.split()[0].lower()}", table, kind.upper(), list(columns)))


def tables(spark: SparkSession) -> DataFrame:
    rows = [("spark_catalog", t.namespace[0] if t.namespace else "default", t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def columns(spark: SparkSession) -> DataFrame:
    rows = [(t.name, c.name, n + 1, "YES" if c.nullable else "NO", c.dataType) for t in spark.catalog.listTables() for n, c in enumerate(spark.catalog.listColumns(t.name))]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def table_constraints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, t, k) for n, t, k, _ in _constraints], "constraint_name string, table_name string, constraint_type string")


def key_column_usage(spark: SparkSession) -> DataFrame:
    rows = [(n, t, c, i + 1) for n, t, _, cols in _constraints for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "constraint_name string, table_name string, column_name string, ordinal_position int")
