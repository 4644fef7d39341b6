"""One query language over all models: SQL, and statements for graphs, series, vectors and live results.

Besides what Spark SQL reads:

    SELECT * FROM metrics RANGE 1000 TO 5000 BUCKET 1000 AVG value     time series: buckets of a range;
        after the range: [WHERE ...] [BY series] [BUCKET ...] [ORDER DESC] [LIMIT n] [OFFSET m]
    TRAVERSE follows FROM 1 MAX_DEPTH 3 [WHERE ...]                     breadth-first rows of an edge table
    RELATE 1 -> follows -> 2                                            an edge more (the table's new state)
    SELECT * FROM 1 -> follows -> likes                                 ids reached by arrows
    NEAREST 5 TO [1.0, 0.0] FROM docs BY cosine [PROBES n] [WHERE ...]  vector search, by an index where there is one
    CREATE INDEX i ON docs USING ivfflat (embedding) WITH (lists = 10)  an inverted-file index of the table as it is (hnsw gives the same)
    TRAIN MODEL m USING linear_regression FEATURES a, b TARGET y FROM t; PREDICT m FROM t; EVALUATE m FROM t; DROP MODEL m; LIST MODELS
    SELECT ... FETCH author                                             a reference column joined to its table
    LIVE SELECT ... / LIVE SELECT DIFF ...                              a handle that re-runs and reports changes
    ... TIMEOUT 5s                                                      a limit for `rows`, which fetches the result
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vector_index, vectors
from tessera.operators import graph, ml
from tessera.operators import timeseries as ts
from tessera.streaming.changes import live_diff

UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def duration_ms(text: str) -> int:
    """1h, 30s, 250ms, 2d, 1w; a bare number is milliseconds."""
    n, unit = re.match(r"(\d+)\s*([a-z]*)$", text.strip()).groups()
    return int(n) * UNITS[unit or "ms"]


RANGE = re.compile(
    r"SELECT\s+\*\s+FROM\s+(?P<name>\w+)\s+RANGE\s+(?P<start>-?\d+)\s+TO\s+(?P<end>-?\d+)(?:\s+WHERE\s+(?P<where>.*?))?(?:\s+BY\s+(?P<by>\w+(?:\s*,\s*\w+)*))?"
    r"(?:\s+BUCKET\s+(?P<size>\w+)\s+(?P<aggregate>[\w.]+)\s+(?P<value>\w+))?(?:\s+ORDER\s+(?P<down>DESC))?(?:\s+LIMIT\s+(?P<limit>\d+))?(?:\s+OFFSET\s+(?P<offset>\d+))?$", re.I | re.S
)


class Live:
    """A live query: `poll` re-runs it; with diff it returns what was added and removed since the last poll."""

    def __init__(self, engine: Engine, text: str, diff: bool):
        self.engine, self.text, self.diff, self._last = engine, text, diff, None

    def poll(self) -> DataFrame:
        now = self.engine.query(self.text)
        last, self._last = self._last, now
        if not self.diff:
            return now
        return live_diff(last if last is not None else now.limit(0), now)


class Engine:
    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame], references: Mapping[str, tuple[str, str]] | None = None):
        """references: column -> (table, key) for FETCH."""
        self.spark, self.tables, self.references = spark, dict(tables), dict(references or {})
        self.indexes: dict[str, tuple[str, vector_index.Index]] = {}

    def query(self, text: str) -> DataFrame | Live:
        text = text.strip().rstrip(";")
        if m := re.match(r"LIVE\s+SELECT(\s+DIFF)?\b", text, re.I):
            return Live(self, "SELECT" + text[m.end() :], bool(m[1]))
        text = self._timeout(text)
        if re.match(r"TRAVERSE\b", text, re.I):
            return self._traverse(text)
        if re.match(r"RELATE\b", text, re.I):
            return self._relate(text)
        if re.match(r"NEAREST\b", text, re.I):
            return self._nearest(text)
        if m := re.match(r"SELECT\s+\*\s+FROM\s+(\S+)\s*((?:(?:->|<-)\s*\w+\s*)+)$", text, re.I):
            return self._arrows(m[1], m[2])
        if m := RANGE.match(text):
            return self._range(**m.groupdict())
        if m := re.match(r"CREATE\s+INDEX\s+(\w+)\s+ON\s+(\w+)\s+USING\s+(?:ivfflat|hnsw)\s*\(\s*(\w+)[^)]*\)(?:\s+WITH\s*\(([^)]*)\))?$", text, re.I):
            return self._create_index(*m.groups())
        if m := re.match(r"DROP\s+INDEX\s+(\w+)$", text, re.I):
            self.indexes = {t: (n, i) for t, (n, i) in self.indexes.items() if n != m[1]}
            return self.spark.createDataFrame([], "result string")
        if re.match(r"(?:TRAIN|DROP|LIST)\s+MODELS?\b|PREDICT\b|EVALUATE\b", text, re.I):
            return self._model(text)
        fetch = re.search(r"\s+FETCH\s+([\w\s,]+)$", text, re.I)
        df = self._sql(text[: fetch.start()] if fetch else text)
        for column in [c.strip() for c in fetch[1].split(",")] if fetch else []:
            table, key = self.references[column]
            other = self.tables[table]
            df = df.join(other.select(F.col(key).alias(column), F.struct(*other.columns).alias(f"{column}_row")), column, "left")
        return df

    def _sql(self, text: str) -> DataFrame:
        for name, df in self.tables.items():
            if re.search(rf"\b{name}\b", text):
                df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def _timeout(self, text: str) -> str:
        return re.sub(r"\s+TIMEOUT\s+\w+$", "", text, flags=re.I)

    def rows(self, text: str) -> list:
        """The query's rows on the driver; with TIMEOUT its jobs are cancelled after that time, and TimeoutError is raised."""
        m = re.search(r"\s+TIMEOUT\s+(\w+)\s*;?\s*$", text, re.I)
        df = self.query(text)
        if not m:
            return df.collect()
        sc, tag = self.spark.sparkContext, f"timeout-{uuid.uuid4().hex}"
        timer = threading.Timer(duration_ms(m[1]) / 1000, lambda: sc.cancelJobsWithTag(tag))
        sc.addJobTag(tag)
        began = time.monotonic()
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            if time.monotonic() - began >= duration_ms(m[1]) / 1000:
                raise TimeoutError(f"not done after {m[1]}") from e
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def _create_index(self, name: str, table: str, column: str, options: str | None) -> DataFrame:
        given = dict(re.findall(r"(\w+)\s*=\s*(\d+)", options or ""))
        df = self.tables[table]
        lists = int(given["lists"]) if "lists" in given else None
        self.indexes[table] = (name, vector_index.build(df, lists, id_col=df.columns[0], vector_col=column))
        return self.spark.createDataFrame([], "result string")

    def _model(self, text: str) -> DataFrame:
        if m := re.match(r"TRAIN\s+MODEL\s+(\w+)\s+USING\s+(\w+)\s+FEATURES\s+([\w\s,]+?)(?:\s+TARGET\s+(\w+))?\s+FROM\s+(\w+)(?:\s+WITH\s*\((.*)\))?$", text, re.I):
            options = {k: json.loads(v) for k, v in re.findall(r"(\w+)\s*=\s*([^,\s]+)", m[6] or "")}
            ml.train(m[1], m[2].lower(), self.tables[m[5]], [f.strip() for f in m[3].split(",")], m[4], **options)
            return self.spark.createDataFrame([(m[1], m[2].lower())], "model string, kind string")
        if m := re.match(r"PREDICT\s+(\w+)\s+FROM\s+(\w+)$", text, re.I):
            return ml.predict(m[1], self.tables[m[2]])
        if m := re.match(r"EVALUATE\s+(\w+)\s+FROM\s+(\w+)$", text, re.I):
            return self.spark.createDataFrame(sorted(ml.evaluate(m[1], self.tables[m[2]]).items()), "metric string, value double")
        if m := re.match(r"DROP\s+MODEL\s+(\w+)$", text, re.I):
            return self.spark.createDataFrame([(m[1], ml.drop_model(m[1]))], "model string, dropped boolean")
        return self.spark.createDataFrame(ml.list_models(), "model string, kind string")

    def _traverse(self, text: str) -> DataFrame:
        name, start, depth, where = re.match(r"TRAVERSE\s+(\w+)\s+FROM\s+(\S+)\s+MAX_DEPTH\s+(\d+)(?:\s+WHERE\s+(.*))?$", text, re.I | re.S).groups()
        edges = self.tables[name]
        rows = graph.traverse(self._ids(start, edges), edges.where(where) if where else edges, int(depth))
        return rows

    def _ids(self, start: str, edges: DataFrame) -> DataFrame:
        return self.spark.range(1).select(F.lit(start.strip("'\"")).cast(edges.schema["src"].dataType).alias("id"))

    def _relate(self, text: str) -> DataFrame:
        a, name, b = re.match(r"RELATE\s+(\S+)\s*->\s*(\w+)\s*->\s*(\S+)$", text, re.I).groups()
        edges = self.tables[name]
        values = {"src": F.lit(a.strip("'\"")), "dst": F.lit(b.strip("'\"")), "type": F.lit(name)}
        row = self.spark.range(1).select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in edges.schema])
        self.tables[name] = edges.unionByName(row)
        return self.tables[name]

    def _arrows(self, start: str, steps: str) -> DataFrame:
        now = None
        for arrow, name in re.findall(r"(->|<-)\s*(\w+)", steps):
            edges = self.tables[name]
            a, b = ("src", "dst") if arrow == "->" else ("dst", "src")
            now = self._ids(start, edges) if now is None else now
            now = edges.select(F.col(a).alias("id"), F.col(b).alias("_to")).join(now, "id").select(F.col("_to").alias("id")).distinct()
        return now

    def _nearest(self, text: str) -> DataFrame:
        k, vector, name, metric, probes, where = re.match(r"NEAREST\s+(\d+)\s+TO\s+\[([^\]]*)\]\s+FROM\s+(\w+)\s+BY\s+(\w+)(?:\s+PROBES\s+(\d+))?(?:\s+WHERE\s+(.*))?$", text, re.I | re.S).groups()
        df, numbers = self.tables[name], [float(x) for x in vector.split(",")]
        if name in self.indexes and self.indexes[name][1].metric == metric.lower() and not where:
            return vector_index.search(df, self.indexes[name][1], numbers, int(k), int(probes or 8))
        vec = next(f.name for f in df.schema if f.dataType.typeName() == "array")
        return vectors.search(df, numbers, int(k), metric.lower(), where=F.expr(where) if where else None, col=vec, id_col=df.columns[0])

    def _range(self, name: str, start: str, end: str, where: str | None, by: str | None, size: str | None, aggregate: str | None, value: str | None, down: str | None, limit: str | None, offset: str | None) -> DataFrame:
        df = self.tables[name]
        at = next(c for c in ("t_ms", "timestamp", "at", "ts") if c in df.columns)
        rows = ts.time_range(df.where(where) if where else df, at, int(start), int(end))
        keys = [b.strip() for b in by.split(",")] if by else []
        out = ts.bucket_aggregate(rows, keys, at, value, duration_ms(size), [aggregate]) if size else rows
        if down or limit or offset:
            time_col = F.col("bucket" if size else at)
            out = out.orderBy(time_col.desc() if down else time_col, *[c for c in out.columns if c not in ("bucket", at)])
        out = out.offset(int(offset)) if offset else out
        return out.limit(int(limit)) if limit else out
