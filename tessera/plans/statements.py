"""Utility statements: EXPLAIN, SHOW, USE, DESCRIBE, materialized views. Transactions are those of `tessera.plans.session`; here they have nothing to do."""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.rounds import drop_round, keep_round

NOTHING = ("BEGIN", "START TRANSACTION", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE", "GRANT", "REVOKE", "CREATE INDEX", "DROP INDEX", "CREATE EXTENSION", "DROP EXTENSION", "VACUUM", "ANALYZE")


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text: simple, extended, codegen, cost or formatted."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


_views: dict[str, tuple[str, DataFrame]] = {}


def _materialize(spark: SparkSession, name: str, text: str) -> None:
    """The query's rows, written, as a view; what the view was before is deleted."""
    rows = keep_round(spark.sql(text), f"view-{name}")
    rows.createOrReplaceTempView(name)
    if name in _views:
        drop_round(_views[name][1])
    _views[name] = (text, rows)


def _explained(spark: SparkSession, text: str, options: str) -> DataFrame:
    """The plan; with COSTS its statistics, with VERBOSE all its stages, with FORMAT JSON as a tree, with ANALYZE also the rows and seconds of a run."""
    df = spark.sql(text)
    if re.search(r"FORMAT\s+JSON", options):
        plan = df._jdf.queryExecution().optimizedPlan().toJSON()
    else:
        plan = explain(df, "cost" if "COSTS" in options else "extended" if "VERBOSE" in options else "formatted")
    if "ANALYZE" not in options:
        return spark.createDataFrame([(plan,)], "plan string")
    began = time.perf_counter()
    n = df.count()
    return spark.createDataFrame([(plan, n, time.perf_counter() - began)], "plan string, rows long, seconds double")


def execute(spark: SparkSession, text: str) -> DataFrame:
    """Spark SQL, and the statements above; those without effect here give an empty result."""
    text = text.strip().rstrip(";")
    if m := re.match(r"EXPLAIN\s*(?:\(([^)]*)\))?((?:\s*(?:ANALYZE|VERBOSE|COSTS)\b)*)\s*(?=SELECT|WITH|VALUES|FROM)", text, re.I):
        return _explained(spark, text[m.end() :], f"{m[1] or ''} {m[2] or ''}".upper())
    if m := re.match(r"CREATE\s+(OR\s+REPLACE\s+)?MATERIALIZED\s+VIEW\s+(IF\s+NOT\s+EXISTS\s+)?(\w+)\s+AS\s+(.*)$", text, re.I | re.S):
        if m[3] in _views and not m[1]:
            if not m[2]:
                raise ValueError(f"view {m[3]} exists")
        else:
            _materialize(spark, m[3], m[4])
        return spark.createDataFrame([], "result string")
    if m := re.match(r"REFRESH\s+MATERIALIZED\s+VIEW\s+(\w+)$", text, re.I):
        _materialize(spark, m[1], _views[m[1]][0])
        return spark.createDataFrame([], "result string")
    if m := re.match(r"DROP\s+MATERIALIZED\s+VIEW\s+(IF\s+EXISTS\s+)?(\w+)$", text, re.I):
        if m[2] not in _views and not m[1]:
            raise ValueError(f"no view {m[2]}")
        if m[2] in _views:
            spark.catalog.dropTempView(m[2])
            drop_round(_views.pop(m[2])[1])
        return spark.createDataFrame([], "result string")
    if any(re.match(rf"{w.replace(' ', r'\s+')}\b", text, re.I) for w in NOTHING) and not re.match(r"BEGIN\s+\S", text, re.I):
        return spark.createDataFrame([], "result string")
    if re.match(r"SHOW\s+ALL$", text, re.I):
        return spark.sql("SET")
    if m := re.match(r"SHOW\s+([\w.]+)$", text, re.I):
        if m[1].upper() not in ("TABLES", "DATABASES", "SCHEMAS", "FUNCTIONS", "VIEWS", "CATALOGS"):
            return spark.createDataFrame([(m[1], spark.conf.get(m[1], None))], "name string, setting string")
    return spark.sql(text)
