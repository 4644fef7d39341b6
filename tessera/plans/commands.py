"""Command-style access (TS.*, VECTOR.*, GEO*, keyed stores) to the DataFrame operators: state in, DataFrame out."""

from __future__ import annotations

import re
import shlex
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry, spatial, vectors
from tessera.operators import timeseries as ts
from tessera.plans.cypher import Graph, clauses
from tessera.plans.graphrag import KnowledgeBases
from tessera.plans.statements import explain
from tessera.sources.rounds import keep_round

SERIES = "series string, t_ms long, value double, seq long"
VECTORS = "id string, embedding array<double>, metadata map<string,string>"
PLACES = "name string, x double, y double"


class Store:
    """Named series, vector sets and places, each a DataFrame. Commands that change one replace its DataFrame."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._series, self.labels, self.policy, self.rules = spark.createDataFrame([], SERIES), {}, {}, {}
        self.vectors: dict[str, DataFrame] = {}
        self.places: dict[str, DataFrame] = {}
        self.shapes: dict[str, DataFrame] = {}
        self.indexes: dict[str, dict] = {}
        self.graphs: dict[str, Graph] = {}
        self.config: dict[str, str] = {"QUERY_TIMEOUT": "0", "MAX_QUEUED_QUERIES": "0"}
        self.slow: list[tuple[str, str, float]] = []
        self.knowledge = KnowledgeBases(spark)
        self._seq = 0
        self._new: list[tuple] = []

    def run(self, line: str) -> DataFrame | str | int:
        name, *args = shlex.split(line)
        f = getattr(self, name.lower().replace(".", "_"), None)
        if f is None or name.startswith("_"):
            raise ValueError(f"unknown command {name}")
        return f(*args)

    # time series
    def ts_create(self, key: str, *options: str) -> str:
        o = [x.upper() for x in options]
        self.policy[key] = options[o.index("DUPLICATE_POLICY") + 1].lower() if "DUPLICATE_POLICY" in o else "last"
        if "LABELS" in o:
            rest = options[o.index("LABELS") + 1 :]
            self.labels[key] = dict(zip(rest[::2], rest[1::2]))
        return "OK"

    def ts_alter(self, key: str, *options: str) -> str:
        return self.ts_create(key, *options)

    def load_series(self, rows: DataFrame) -> None:
        """Samples in bulk: (series, t_ms, value)."""
        added = rows.select("series", "t_ms", F.col("value").cast("double").alias("value"), (F.monotonically_increasing_id() + self._seq).alias("seq"))
        self._seq += 1 << 50
        self.series = self.series.unionByName(added)

    @property
    def series(self) -> DataFrame:
        """All samples; those that came one by one since the last look are added as one batch."""
        if self._new:
            self._series, self._new = self._series.unionByName(self.spark.createDataFrame(self._new, SERIES)), []
        return self._series

    @series.setter
    def series(self, rows: DataFrame) -> None:
        self._series = rows

    def compact(self) -> None:
        """Write the samples and read them again: the plan no longer grows with the commands so far."""
        self.series = keep_round(self.series, "series")

    def ts_add(self, key: str, at: str, value: str) -> int:
        self._seq += 1
        self._new.append((key, int(at), float(value), self._seq))
        return int(at)

    def ts_madd(self, *args: str) -> int:
        for k in range(0, len(args), 3):
            self.ts_add(*args[k : k + 3])
        return len(args) // 3

    def ts_incrby(self, key: str, delta: str, at: str) -> int:
        last = self._of(key).orderBy(F.desc("t_ms")).first()
        return self.ts_add(key, at, str((last["value"] if last else 0.0) + float(delta)))

    def ts_decrby(self, key: str, delta: str, at: str) -> int:
        return self.ts_incrby(key, str(-float(delta)), at)

    def _of(self, *keys: str) -> DataFrame:
        out = None
        for key in keys:
            rows = ts.deduplicate(self.series.where(F.col("series") == key), ["series"], "t_ms", "value", self.policy.get(key, "last"), "seq")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.series.drop("seq").limit(0)

    def ts_get(self, key: str) -> DataFrame:
        return ts.latest(self._of(key), ["series"], "t_ms", "value")

    def ts_mget(self, *filters: str) -> DataFrame:
        return ts.latest(self._of(*self._matching(filters)), ["series"], "t_ms", "value")

    def _range(self, rows: DataFrame, start: str, end: str, options: tuple[str, ...], down: bool) -> DataFrame:
        low, high = (-(1 << 62) if start == "-" else int(start)), ((1 << 62) if end == "+" else int(end))
        rows = ts.time_range(rows, "t_ms", low, high)
        o = [x.upper() for x in options]
        if "AGGREGATION" in o:
            k = o.index("AGGREGATION")
            rows = ts.compaction(rows, ["series"], "t_ms", "value", options[k + 1], int(options[k + 2]))
        rows = rows.orderBy("series", F.desc("t_ms") if down else "t_ms")
        return rows.limit(int(options[o.index("COUNT") + 1])) if "COUNT" in o else rows

    def ts_range(self, key: str, start: str, end: str, *options: str) -> DataFrame:
        return self._range(self._of(key), start, end, options, False)

    def ts_revrange(self, key: str, start: str, end: str, *options: str) -> DataFrame:
        return self._range(self._of(key), start, end, options, True)

    def _many(self, start: str, end: str, args: tuple[str, ...], down: bool) -> DataFrame:
        k = [x.upper() for x in args].index("FILTER")
        return self._range(self._of(*self._matching(args[k + 1 :])), start, end, args[:k], down)

    def ts_mrange(self, start: str, end: str, *args: str) -> DataFrame:
        return self._many(start, end, args, False)

    def ts_mrevrange(self, start: str, end: str, *args: str) -> DataFrame:
        return self._many(start, end, args, True)

    def _matching(self, filters: tuple[str, ...]) -> list[str]:
        wanted = dict(f.split("=", 1) for f in filters)
        return sorted(k for k, v in self.labels.items() if all(v.get(a) == b for a, b in wanted.items()))

    def ts_queryindex(self, *filters: str) -> DataFrame:
        return self.spark.createDataFrame([(k,) for k in self._matching(filters)], "series string")

    def ts_del(self, key: str, start: str, end: str) -> str:
        self.series = self.series.where(~((F.col("series") == key) & F.col("t_ms").between(int(start), int(end))))
        return "OK"

    def ts_info(self, key: str) -> DataFrame:
        return self._of(key).groupBy("series").agg(F.count(F.lit(1)).alias("samples"), F.min("t_ms").alias("first_t_ms"), F.max("t_ms").alias("last_t_ms"))

    def ts_createrule(self, source: str, dest: str, _: str, aggregate: str, size: str) -> str:
        self.rules[source, dest] = (aggregate, int(size))
        return "OK"

    def ts_deleterule(self, source: str, dest: str) -> str:
        self.rules.pop((source, dest))
        return "OK"

    def apply_rules(self) -> None:
        """Write every rule's buckets into its destination."""
        for (source, dest), (aggregate, size) in self.rules.items():
            made = ts.compaction(self._of(source), [], "t_ms", "value", aggregate, size)
            self.load_series(made.select(F.lit(dest).alias("series"), "t_ms", "value"))

    # vectors
    def vector_create(self, key: str, *_: str) -> str:
        self.vectors.setdefault(key, self.spark.createDataFrame([], VECTORS))
        return "OK"

    def ft_create(self, key: str, *options: str) -> str:
        """FT.CREATE name [ON HASH] SCHEMA field TYPE ... VECTOR algorithm n name value ...: the vector field's DIM and DISTANCE_METRIC are kept."""
        o = [x.upper() for x in options]
        spec = {k.lower(): options[o.index(k) + 1] for k in ("DIM", "DISTANCE_METRIC", "TYPE") if k in o}
        self.indexes[key] = {"metric": {"COSINE": "cosine", "L2": "l2", "IP": "dot"}[spec.get("distance_metric", "COSINE").upper()], "dim": int(spec["dim"]) if "dim" in spec else None}
        return self.vector_create(key)

    def ft_add(self, key: str, name: str, numbers: str, *metadata: str) -> str:
        want, got = self.indexes.get(key, {}).get("dim"), len(numbers.split(","))
        if want and got != want:
            raise ValueError(f"{got} dimensions, the index has {want}")
        return self.vector_add(key, name, numbers, *metadata)

    def vector_add(self, key: str, name: str, numbers: str, *metadata: str) -> str:
        row = [(name, [float(x) for x in numbers.split(",")], dict(zip(metadata[::2], metadata[1::2])))]
        self.vector_create(key)
        kept = self.vectors[key].where(F.col("id") != name)
        self.vectors[key] = kept.unionByName(self.spark.createDataFrame(row, VECTORS))
        return "OK"

    def vector_get(self, key: str, name: str) -> DataFrame:
        return self.vectors[key].where(F.col("id") == name)

    def vector_del(self, key: str, name: str) -> str:
        self.vectors[key] = self.vectors[key].where(F.col("id") != name)
        return "OK"

    def vector_search(self, key: str, numbers: str, k: str, metric: str = "cosine", threshold: str | None = None, *filters: str) -> DataFrame:
        where = None
        for f in filters:
            a, b = f.split("=", 1)
            c = F.col("metadata")[a] == b
            where = c if where is None else where & c
        return vectors.search(self.vectors[key], [float(x) for x in numbers.split(",")], int(k), metric.lower(), float(threshold) if threshold else None, where, "embedding", "id").select("id", "score")

    vector_knn = vector_search

    def ft_search(self, key: str, query: str, *options: str) -> DataFrame:
        """FT.SEARCH index "filter=>[KNN k @field $name]" PARAMS n name numbers ... [LIMIT offset count]; filters are * or @field:{value} ...

        Without such a query text, as VECTOR.SEARCH: the numbers, then k.
        """
        m = re.match(r"\s*(.*?)\s*=>\s*\[\s*KNN\s+(\d+)\s+@\w+\s+\$(\w+)", query, re.I)
        if not m:
            return self.vector_search(key, query, *options)
        o = [x.upper() for x in options]
        given = options[o.index("PARAMS") + 2 :]
        numbers = dict(zip(given[::2], given[1::2]))[m[3]]
        where = [f"{a}={b}" for a, b in re.findall(r"@(\w+):\{([^}]*)\}", m[1])]
        found = self.vector_search(key, numbers, m[2], self.indexes.get(key, {}).get("metric", "cosine"), None, *where)
        if "LIMIT" in o:
            k = o.index("LIMIT")
            found = found.orderBy(F.desc("score"), "id").offset(int(options[k + 1])).limit(int(options[k + 2]))
        return found

    def vector_info(self, key: str) -> DataFrame:
        return self.vectors[key].agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).alias("dims"))

    vector_stats = vector_info

    def ft_info(self, key: str) -> DataFrame:
        spec = self.indexes.get(key, {})
        return self.vector_info(key).withColumn("metric", F.lit(spec.get("metric", "cosine"))).withColumn("dim", F.lit(spec.get("dim")).cast("int"))

    def vector_count(self, key: str) -> int:
        return self.vectors[key].count()

    def vector_list(self, key: str) -> DataFrame:
        return self.vectors[key].select("id")

    def load_vectors(self, key: str, rows: DataFrame) -> None:
        """Vectors in bulk: (id, embedding, metadata map)."""
        self.vectors[key] = rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), "metadata")

    def vector_drop(self, key: str) -> int:
        return int(self.vectors.pop(key, None) is not None)

    ft_del = vector_del

    def ft_dropindex(self, key: str, *_: str) -> int:
        self.indexes.pop(key, None)
        return self.vector_drop(key)

    # graphs
    def load_graph(self, name: str, graph: Graph) -> None:
        self.graphs[name] = graph

    def graph_query(self, name: str, text: str) -> DataFrame | str:
        """GRAPH.QUERY: rows for a query with RETURN (or CALL); else the graph after it is kept. A name that is new is an empty graph."""
        if name not in self.graphs:
            self.graphs[name] = Graph(self.spark.createDataFrame([], "id long, labels array<string>, name string"), self.spark.createDataFrame([], "src long, dst long, type string"))
        began = time.perf_counter()
        words = [w for w, _ in clauses(text)]
        out = self.graphs[name].query(text) if "RETURN" in words or words[:1] == ["CALL"] else None
        if out is None:
            self.graphs[name] = self.graphs[name].execute(text)
        self.slow.append((name, text, time.perf_counter() - began))
        self.slow = sorted(self.slow, key=lambda r: -r[2])[:10]
        return "OK" if out is None else out

    def graph_explain(self, name: str, text: str) -> str:
        return explain(self.graphs[name].query(text))

    def graph_profile(self, name: str, text: str) -> DataFrame:
        """(plan, rows, seconds) of the query, run as a whole."""
        found, began = self.graphs[name].query(text), time.perf_counter()
        n = found.count()
        return self.spark.createDataFrame([(explain(found), n, time.perf_counter() - began)], "plan string, rows long, seconds double")

    def graph_delete(self, name: str) -> str:
        del self.graphs[name]
        return "OK"

    def graph_list(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.graphs)], "graph string")

    def graph_config(self, what: str, name: str, value: str | None = None) -> DataFrame | str:
        """GET name (* for all) or SET name value."""
        if what.upper() == "SET":
            self.config[name.upper()] = value
            return "OK"
        rows = [(k, v) for k, v in sorted(self.config.items()) if name in ("*", k) or name.upper() == k]
        return self.spark.createDataFrame(rows, "name string, value string")

    def graph_slowlog(self, name: str) -> DataFrame:
        """The slowest queries of a graph, by the time to plan them (results are lazy)."""
        return self.spark.createDataFrame([(t, s) for n, t, s in self.slow if n == name], "query string, seconds double")

    # knowledge
    def graphrag_build(self, name: str, doc_id: str, body: str, *_: str) -> DataFrame:
        return self.knowledge.build(name, doc_id, body)

    def graphrag_query(self, name: str, question: str, *options: str) -> DataFrame:
        return self.knowledge.query(name, question, *options)

    def graphrag_stats(self, name: str) -> DataFrame:
        return self.knowledge.stats(name)

    # places
    def geoadd(self, key: str, *args: str) -> int:
        rows = [(args[k + 2], float(args[k]), float(args[k + 1])) for k in range(0, len(args), 3)]
        new = self.spark.createDataFrame(rows, PLACES)
        old = self.places.get(key)
        self.places[key] = new if old is None else old.join(new.select("name"), "name", "left_anti").unionByName(new)
        return len(rows)

    def geopos(self, key: str, *names: str) -> DataFrame:
        return self.places[key].where(F.col("name").isin(list(names)))

    def geohash(self, key: str, *names: str) -> DataFrame:
        return self.geopos(key, *names).select("name", spatial.geohash(F.col("x"), F.col("y"), 11).alias("hash"))

    def geodist(self, key: str, a: str, b: str) -> DataFrame:
        p, q = self.geopos(key, a).toDF("n1", "x1", "y1"), self.geopos(key, b).toDF("n2", "x2", "y2")
        return p.join(F.broadcast(q)).select(spatial.haversine(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("metres"))

    def georadius(self, key: str, x: str, y: str, metres: str) -> DataFrame:
        d = spatial.haversine(F.col("x"), F.col("y"), F.lit(float(x)), F.lit(float(y)))
        return self.places[key].withColumn("metres", d).where(F.col("metres") <= float(metres)).orderBy("metres", "name")

    def geo_geometry_add(self, key: str, name: str, text: str) -> str:
        """GEO.POLYGON.ADD, GEO.LINESTRING.ADD: a named geometry, by its text."""
        new = self.spark.createDataFrame([(name, text)], "name string, wkt string")
        old = self.shapes.get(key)
        self.shapes[key] = new if old is None else old.where(F.col("name") != name).unionByName(new)
        return "OK"

    geo_polygon_add = geo_linestring_add = geo_geometry_add

    def load_shapes(self, key: str, rows: DataFrame) -> None:
        """Geometries in bulk: (name, wkt)."""
        self.shapes[key] = rows.select("name", "wkt")

    def geo_geometry_get(self, key: str, *names: str) -> DataFrame:
        return self.shapes[key].where(F.col("name").isin(list(names)))

    def geo_geometry_del(self, key: str, *names: str) -> str:
        self.shapes[key] = self.shapes[key].where(~F.col("name").isin(list(names)))
        return "OK"

    def _related(self, key: str, text: str, how: str) -> DataFrame:
        rows, other = self.shapes[key].withColumn("_g", geometry.from_wkt(F.col("wkt"))), geometry.from_wkt(F.lit(text))
        return rows.where(geometry.boxes_meet(F.col("_g"), other)).where(geometry.relates(F.col("_g"), other, how)).select("name")

    def geo_within(self, key: str, text: str) -> DataFrame:
        """Names of the geometries that are within the given one; the next three likewise."""
        return self._related(key, text, "within")

    def geo_intersects(self, key: str, text: str) -> DataFrame:
        return self._related(key, text, "intersects")

    def geo_contains(self, key: str, text: str) -> DataFrame:
        return self._related(key, text, "contains")

    def geo_overlaps(self, key: str, text: str) -> DataFrame:
        return self._related(key, text, "overlaps")

    def geo_fence_add(self, name: str, text: str, alerts: str = "ENTER,EXIT") -> str:
        self.geo_geometry_add("_fences", name, text)
        return "OK"

    def geo_fence_del(self, name: str) -> str:
        return self.geo_geometry_del("_fences", name)

    def geo_fence_list(self) -> DataFrame:
        return self.shapes.get("_fences", self.spark.createDataFrame([], "name string, wkt string"))

    def geo_fence_check(self, entity: str, x: str, y: str) -> DataFrame:
        """Names of the fences around the entity's place."""
        return self.geo_contains("_fences", f"POINT({x} {y})")

    def georadiusbymember(self, key: str, name: str, metres: str) -> DataFrame:
        at = self.geopos(key, name).first()
        return self.georadius(key, str(at["x"]), str(at["y"]), metres)
