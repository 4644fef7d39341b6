"""Time series, vectors, graph, spatial, streams (batch twins), changes, DML, ML and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import spatial, vectors
from tessera.operators import dml, graph, ml, text
from tessera.operators import timeseries as ts
from tessera.queries.base import query, same_sql
from tessera.session import load
from tessera.streaming import changes, windows

HOUR, DAY = 3_600_000, 86_400_000


def samples(spark: SparkSession, d: str) -> DataFrame:
    """events as a time series: (event_id, series, t_ms, value)."""
    return load(spark, d, "events").select("event_id", F.col("event_type").alias("series"), "user_id", ts.epoch_ms(F.col("ts")).alias("t_ms"), "value")


S = "(SELECT event_id, event_type AS series, user_id, epoch_us(ts) // 1000 AS t_ms, value FROM events)"


@query(f"""SELECT series, t_ms // {DAY} * {DAY} AS bucket, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum, min(value) AS min, max(value) AS max, count(value) AS count,
round(max(value) - min(value), 6) AS range, arg_min(value, t_ms) AS first, arg_max(value, t_ms) AS last, round(stddev_pop(value), 6) AS std_p, round(var_pop(value), 4) AS var_p FROM {S} s GROUP BY 1, 2""")
def ts_bucket_agg(spark: SparkSession, d: str) -> DataFrame:
    got = ts.bucket_aggregate(samples(spark, d), ["series"], "t_ms", "value", DAY, ["avg", "sum", "min", "max", "count", "range", "first", "last", "std.p", "var.p"])
    return got.withColumns({"avg": F.round("avg", 6), "sum": F.round("sum", 4), "range": F.round("range", 6), "std_p": F.round("std_p", 6), "var_p": F.round("var_p", 4)})


@query(f"SELECT event_id, value FROM {S} s WHERE t_ms BETWEEN 1704500000000 AND 1705500000000")
def ts_range(spark: SparkSession, d: str) -> DataFrame:
    return ts.time_range(samples(spark, d), "t_ms", 1704500000000, 1705500000000).select("event_id", "value")


@query(f"SELECT series, t_ms // {HOUR} * {HOUR} AS bucket, round(avg(value), 6) AS value FROM {S} s GROUP BY 1, 2")
def ts_downsample(spark: SparkSession, d: str) -> DataFrame:
    return ts.downsample(samples(spark, d), ["series"], "t_ms", "value", HOUR).withColumn("value", F.round("value", 6))


@query(f"SELECT event_id, round(avg(value) OVER (PARTITION BY series ORDER BY t_ms RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) + 1e-9, 6) AS moving_avg FROM {S} s")
def ts_moving_average(spark: SparkSession, d: str) -> DataFrame:
    return ts.moving_average(samples(spark, d), ["series"], "t_ms", "value", DAY).select("event_id", F.round(F.col("moving_avg") + 1e-9, 6).alias("moving_avg"))


W = "(PARTITION BY series ORDER BY t_ms)"


@query(f"SELECT event_id, CASE WHEN t_ms > lag(t_ms) OVER {W} THEN round((value - lag(value) OVER {W}) / ((t_ms - lag(t_ms) OVER {W}) / 1000.0), 9) END AS rate FROM {S} s")
def ts_rate(spark: SparkSession, d: str) -> DataFrame:
    return ts.rate(samples(spark, d), ["series"], "t_ms", "value").select("event_id", F.round("rate", 9).alias("rate"))


@query(f"SELECT event_id, round(value - lag(value) OVER {W}, 6) AS delta FROM {S} s")
def ts_delta(spark: SparkSession, d: str) -> DataFrame:
    return ts.delta(samples(spark, d), ["series"], "t_ms", "value").select("event_id", F.round("delta", 6).alias("delta"))


@query(f"SELECT event_id, round(sum(value) OVER (PARTITION BY series ORDER BY t_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cumulative_sum FROM {S} s")
def ts_cumulative_sum(spark: SparkSession, d: str) -> DataFrame:
    return ts.cumulative_sum(samples(spark, d), ["series"], "t_ms", "value").select("event_id", F.round("cumulative_sum", 4).alias("cumulative_sum"))


@query(f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER {W} AS n FROM {S} s),
e(series, n, value, ema) AS (SELECT series, n, value, value FROM o WHERE n = 1 UNION ALL SELECT o.series, o.n, o.value, 0.3 * o.value + 0.7 * e.ema FROM e JOIN o ON o.series = e.series AND o.n = e.n + 1)
SELECT o.event_id, round(ema, 6) AS ema FROM e JOIN o USING (series, n)""")
def ts_ewma(spark: SparkSession, d: str) -> DataFrame:
    return ts.exponential_average(samples(spark, d), ["series"], "t_ms", "value", 0.3).select("event_id", F.round("ema", 6).alias("ema"))


@query(f"SELECT event_id, round((value - m) / sd, 6) AS z FROM {S} s JOIN (SELECT series, avg(value) AS m, stddev_pop(value) AS sd FROM {S} t GROUP BY series) g USING (series) WHERE sd > 0 AND abs((value - m) / sd) > 1.5")
def ts_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return ts.anomalies(samples(spark, d), ["series"], "value", 1.5).select("event_id", F.round("z", 6).alias("z"))


for _policy, _sql in {"last": "arg_max(value, event_id)", "first": "arg_min(value, event_id)", "sum": "round(sum(value), 4)", "max": "max(value)", "min": "min(value)"}.items():

    @query(f"SELECT series, t_ms // {HOUR} * {HOUR} AS t_ms, {_sql} AS value FROM {S} s GROUP BY 1, 2", name=f"ts_dedup_{_policy}")
    def _dedup(spark: SparkSession, d: str, policy: str = _policy) -> DataFrame:
        s = samples(spark, d).withColumn("t_ms", ts.bucket(F.col("t_ms"), HOUR))
        got = ts.deduplicate(s, ["series"], "t_ms", "value", policy, "event_id")
        return got.withColumn("value", F.round("value", 4)) if policy == "sum" else got


@query(f"SELECT series, max(t_ms) AS t_ms, arg_max(value, t_ms) AS value FROM {S} s GROUP BY series")
def ts_latest(spark: SparkSession, d: str) -> DataFrame:
    return ts.latest(samples(spark, d), ["series"], "t_ms", "value")


@query("SELECT event_id FROM events WHERE event_type = 'click' AND user_id % 2 = 1")
def ts_label_filter(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("labels", F.create_map(F.lit("type"), F.col("event_type"), F.lit("odd"), (F.col("user_id") % 2).cast("string")))
    return ts.label_filter(e, "labels", {"type": "click", "odd": "1"}).select("event_id")


@query(f"""SELECT series, round(CASE WHEN sum(span) > 0 THEN sum(value * span) / sum(span) ELSE avg(value) END, 3) AS twa
FROM (SELECT *, coalesce(lead(t_ms) OVER {W} - t_ms, 0) AS span FROM {S} s) x GROUP BY series""")
def ts_twa(spark: SparkSession, d: str) -> DataFrame:
    return ts.time_weighted_average(samples(spark, d), ["series"], "t_ms", "value").withColumn("twa", F.round("twa", 3))


@query(f"SELECT series, t_ms // {DAY} * {DAY} AS t_ms, CAST(max(value) AS DOUBLE) AS value FROM {S} s GROUP BY 1, 2")
def ts_compaction(spark: SparkSession, d: str) -> DataFrame:
    return ts.compaction(samples(spark, d), ["series"], "t_ms", "value", "max", DAY)


@query(f"SELECT series, t_ms // {DAY} * {DAY} AS bucket, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM {S} s GROUP BY 1, 2")
def ts_continuous_aggregate(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    old, new = (ts.continuous_aggregate(s.where(c), ["series"], "t_ms", "value", DAY) for c in ("value < 40", "value >= 40"))
    return ts.merge_state(old, new, ["series"]).withColumn("total", F.round("total", 4))


# vectors
Q = "(SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 100 = 0)"


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every vector with the one whose id is one less."""
    e = load(spark, d, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("e")), "vec_id")


def _pairwise(name: str, sql: str, f) -> None:
    @query(f"SELECT a.vec_id, round({sql}, 4) AS v FROM embeddings a JOIN (SELECT vec_id + 1 AS vec_id, embedding AS e FROM embeddings) b ON a.vec_id = b.vec_id", name=name)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return neighbours(spark, d).select("vec_id", F.round(f(F.col("e"), F.col("embedding")), 4).alias("v"))


D = "list_zip(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[]))"
_pairwise("vec_l2", f"sqrt(list_sum(list_transform({D}, lambda p: (p[1] - p[2]) * (p[1] - p[2]))))", vectors.l2)
_pairwise("vec_dot", f"list_sum(list_transform({D}, lambda p: p[1] * p[2]))", vectors.dot)
_pairwise("vec_l1", f"list_sum(list_transform({D}, lambda p: abs(p[1] - p[2])))", vectors.l1)
_pairwise("vec_hamming", f"list_sum(list_transform({D}, lambda p: CASE WHEN (p[1] > 0.5) <> (p[2] > 0.5) THEN 1 ELSE 0 END))", vectors.hamming)
_pairwise("vec_cosine", "1 - list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[]))", vectors.cosine_distance)


@query("SELECT q AS query_id, vec_id AS id, round(s, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT q, vec_id, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS r FROM (SELECT q, vec_id, list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM " + Q + " q, embeddings WHERE vec_id <> q) x) y WHERE r <= 10")
def vec_knn(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return vectors.knn_join(e, e.where("vec_id % 100 = 0"), 10).withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, label, list_cosine_similarity(CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS s FROM embeddings) x WHERE label IN (1, 2, 3) AND s >= 0 ORDER BY s DESC, vec_id LIMIT 25")
def vec_threshold_filter(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    got = vectors.search(e, list(first[0]), 25, threshold=0.0, where=F.col("label").isin(1, 2, 3)) if first else e.limit(0).withColumn("score", F.lit(0.0))
    return got.select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, len(embedding) AS dims, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vec_norm_dims(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", vectors.dims(e).cast("long").alias("dims"), F.round(vectors.norm(e), 6).alias("norm"))


# graph: customer -> nation -> region, supplier -> nation; ids in ranges of their own
NODES = """(SELECT r_regionkey AS id FROM region UNION ALL SELECT 100 + n_nationkey FROM nation UNION ALL SELECT 1000 + s_suppkey FROM supplier UNION ALL SELECT 10000000 + c_custkey FROM customer)"""
EDGES = """(SELECT 100 + n_nationkey AS src, n_regionkey AS dst, 'in_region' AS type FROM nation UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, 'based_in' FROM supplier UNION ALL SELECT 10000000 + c_custkey, 100 + c_nationkey, 'lives_in' FROM customer)"""


def place_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r, n, s, c = (load(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    long = lambda e: e.cast("long")
    nk, sk, ck = F.col("n_nationkey") + 100, F.col("s_suppkey") + 1000, F.col("c_custkey") + 10_000_000
    nodes = r.select(long(F.col("r_regionkey")).alias("id")).unionByName(n.select(long(nk).alias("id"))).unionByName(s.select(sk.alias("id"))).unionByName(c.select(ck.alias("id")))
    edges = n.select(long(nk).alias("src"), long(F.col("n_regionkey")).alias("dst"), F.lit("in_region").alias("type"))
    edges = edges.unionByName(s.select(sk.alias("src"), long(F.col("s_nationkey") + 100).alias("dst"), F.lit("based_in").alias("type")))
    return nodes, edges.unionByName(c.select(ck.alias("src"), long(F.col("c_nationkey") + 100).alias("dst"), F.lit("lives_in").alias("type")))


def trade_graph(spark: SparkSession, d: str) -> DataFrame:
    """Customer -> supplier through orders and lineitem, and supplier -> customer's nation: a graph with triangles."""
    l, o, c = load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "customer")
    bought = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"])
    a = bought.select((F.col("c_custkey") + 10_000_000).alias("src"), (F.col("l_suppkey") + 1000).alias("dst"))
    b = bought.select((F.col("l_suppkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))
    return a.unionByName(b).unionByName(c.select((F.col("c_custkey") + 10_000_000).alias("src"), (F.col("c_nationkey") + 100).cast("long").alias("dst"))).distinct()


BOUGHT = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
TRADE = f"""(SELECT 10000000 + c_custkey AS src, 1000 + l_suppkey AS dst {BOUGHT} UNION SELECT 1000 + l_suppkey, 100 + c_nationkey {BOUGHT} UNION SELECT 10000000 + c_custkey, 100 + c_nationkey FROM customer)"""


@query(f"SELECT src AS n0, dst AS n1 FROM {EDGES} e WHERE type = 'lives_in'")
def g_one_hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = place_graph(spark, d)
    return graph.match_path(nodes, edges, nodes, 1, types=["lives_in"])


@query(f"SELECT a.src AS n0, a.dst AS n1, b.dst AS n2 FROM {EDGES} a JOIN {EDGES} b ON a.dst = b.src")
def g_two_hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = place_graph(spark, d)
    return graph.match_path(nodes, edges, nodes, 2)


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES} x), p(start, \"end\", hops) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT p.start, e.dst, hops + 1 FROM p JOIN e ON p.\"end\" = e.src WHERE hops < 3) SELECT start, \"end\", hops FROM p")
def g_var_length(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = place_graph(spark, d)
    return graph.variable_length(nodes, edges, 1, 3)


@query(f"SELECT id, (SELECT count(*) FROM {EDGES} e WHERE e.dst = id) AS in_degree, (SELECT count(*) FROM {EDGES} e WHERE e.src = id) AS out_degree, (SELECT count(*) FROM {EDGES} e WHERE e.src = id) + (SELECT count(*) FROM {EDGES} e WHERE e.dst = id) AS degree FROM {NODES} n")
def g_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*place_graph(spark, d))


@query(f"""WITH t AS MATERIALIZED (SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM {TRADE} x GROUP BY 1, 2),
tri AS (SELECT x.a, x.b, y.b AS c FROM t x JOIN t y ON x.b = y.a JOIN t z ON z.a = x.a AND z.b = y.b)
SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) u GROUP BY id""")
def g_triangles(spark: SparkSession, d: str) -> DataFrame:
    edges = trade_graph(spark, d)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.triangles(nodes, edges).where("triangles > 0")


@query(f"SELECT id, CASE WHEN id < 100 THEN id WHEN id < 1000 THEN n_regionkey ELSE n_regionkey END AS component FROM (SELECT r_regionkey AS id, r_regionkey AS n_regionkey FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey FROM nation UNION ALL SELECT 1000 + s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 10000000 + c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey) x")
def g_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_components(*place_graph(spark, d))


@query(f"SELECT n_regionkey AS component, 2 + count(*) - 2 + 1 + (SELECT count(*) FROM customer JOIN nation m ON c_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey) + (SELECT count(*) FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey) AS members FROM nation n GROUP BY n_regionkey")
def g_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(*place_graph(spark, d))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {TRADE} x), b(node, depth) AS (SELECT 10000000, 0 UNION SELECT e.dst, depth + 1 FROM b JOIN e ON b.node = e.src WHERE depth < 4) SELECT 10000000 AS start, node, min(depth) AS depth FROM b GROUP BY node")
def g_bfs(spark: SparkSession, d: str) -> DataFrame:
    start = spark.range(1).select(F.lit(10_000_000).cast("long").alias("id"))
    return graph.bfs(start, trade_graph(spark, d))


@query(f"WITH e AS MATERIALIZED (SELECT * FROM {EDGES} x) SELECT src AS source, dst AS target, type AS relationship, CASE type WHEN 'lives_in' THEN 1 ELSE 2 END AS depth FROM e WHERE type = 'lives_in' OR (type = 'in_region' AND src IN (SELECT dst FROM e WHERE type = 'lives_in'))")
def g_traverse(spark: SparkSession, d: str) -> DataFrame:
    _, edges = place_graph(spark, d)
    return graph.traverse(edges.where("type = 'lives_in'").select(F.col("src").alias("id")), edges, 2)


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {EDGES} x UNION SELECT dst, src FROM {EDGES} x), b(node, cost) AS (SELECT 100, 0 UNION SELECT e.dst, cost + 1 FROM b JOIN e ON b.node = e.src WHERE cost < 6)
SELECT node, CAST(min(cost) AS DOUBLE) AS cost FROM b GROUP BY node""")
def g_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(100, place_graph(spark, d)[1])


@query(f"""WITH e AS MATERIALIZED (SELECT src, dst FROM {EDGES} x), n AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM {NODES} y) AS one FROM {NODES} z),
r0 AS (SELECT id, one * 0.15 AS base FROM n), o AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY src),
l1 AS MATERIALIZED (SELECT id, base + 0.85 * coalesce((SELECT sum(b.base / k) FROM e JOIN o USING (src) JOIN r0 b ON b.id = e.src WHERE e.dst = r0.id), 0) AS base FROM r0),
l2 AS MATERIALIZED (SELECT r0.id, r0.base + 0.85 * coalesce((SELECT sum(b.base / k) FROM e JOIN o USING (src) JOIN l1 b ON b.id = e.src WHERE e.dst = r0.id), 0) AS base FROM r0)
SELECT id, round(base, 12) AS rank FROM l2""")
def g_pagerank(spark: SparkSession, d: str) -> DataFrame:
    """On this graph of depth two the ranks are at rest after three rounds, so that SQL can unroll them."""
    return graph.pagerank(*place_graph(spark, d), tolerance=0.0, iterations=4).select("id", F.round("rank", 12).alias("rank"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM {EDGES} x UNION SELECT dst, src FROM {EDGES} x), v AS (SELECT n_nationkey + 100 AS id, n_regionkey AS r FROM nation),
k AS MATERIALIZED (SELECT v.id, v.r, (SELECT count(*) FROM {EDGES} y WHERE y.dst = v.id) AS leaves FROM v),
m AS (SELECT r, sum(leaves) AS leaves, count(*) AS nations FROM k GROUP BY r),
far AS (SELECT r AS id, nations + leaves AS others, nations + 2 * leaves AS total FROM m
UNION ALL SELECT k.id, m.nations + m.leaves, 1 + 2 * (m.nations - 1) + k.leaves + 3 * (m.leaves - k.leaves) FROM k JOIN m USING (r)
UNION ALL SELECT y.src, m.nations + m.leaves, 1 + 2 + 3 * (m.nations - 1) + 2 * (k.leaves - 1) + 4 * (m.leaves - k.leaves) FROM {EDGES} y JOIN k ON y.dst = k.id JOIN m USING (r) WHERE y.type <> 'in_region')
SELECT id, round(others / total, 9) AS closeness FROM far""")
def g_closeness(spark: SparkSession, d: str) -> DataFrame:
    return graph.closeness(*place_graph(spark, d)).withColumn("closeness", F.round("closeness", 9))


@query(f"""WITH k AS (SELECT v.id, v.r, (SELECT count(*) FROM {EDGES} y WHERE y.dst = v.id) AS leaves FROM (SELECT n_nationkey + 100 AS id, n_regionkey AS r FROM nation) v),
m AS (SELECT r, sum(leaves) + count(*) AS below, sum((leaves + 1) * (leaves + 1)) AS squares FROM k GROUP BY r)
SELECT r AS id, CAST((below * below - squares) / 2.0 AS DOUBLE) AS betweenness FROM m
UNION ALL SELECT k.id, CAST(k.leaves * (k.leaves - 1) / 2.0 + k.leaves * (m.below - k.leaves) AS DOUBLE) FROM k JOIN m USING (r)
UNION ALL SELECT src, 0.0 FROM {EDGES} y WHERE type <> 'in_region'""")
def g_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.betweenness(*place_graph(spark, d))


@query(f"SELECT n.id, e.src AS neighbour FROM {NODES} n LEFT JOIN {EDGES} e ON e.dst = n.id")
def g_optional_match(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = place_graph(spark, d)
    return nodes.join(edges.select("src", F.col("dst").alias("id")), "id", "left").select("id", F.col("src").alias("neighbour"))


@query(f"SELECT dst AS id, list(src ORDER BY src) AS members, count(*) AS n FROM {EDGES} e GROUP BY dst")
def g_collect(spark: SparkSession, d: str) -> DataFrame:
    return place_graph(spark, d)[1].groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("members"), F.count(F.lit(1)).alias("n"))


# spatial: points by arithmetic on keys
PTS = "(SELECT c_custkey AS id, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey * 17 % 170 - 85 AS DOUBLE) AS y FROM customer)"


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return load(spark, d, "customer").select(k.alias("id"), (k * 37 % 360 - 180).cast("double").alias("x"), (k * 17 % 170 - 85).cast("double").alias("y"))


X, Y = F.col, F.col


@query(f"SELECT id, round(sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)), 9) AS dist FROM {PTS} p")
def sp_distance(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", F.round(spatial.distance(F.col("x"), F.col("y"), F.lit(10.0), F.lit(20.0)), 9).alias("dist"))


@query(f"SELECT id, round(2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(48.85 - y) / 2), 2) + cos(radians(y)) * cos(radians(48.85)) * pow(sin(radians(2.35 - x) / 2), 2)))), 3) AS metres FROM {PTS} p")
def sp_haversine(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", F.round(spatial.haversine(F.col("x"), F.col("y"), F.lit(2.35), F.lit(48.85)), 3).alias("metres"))


@query("SELECT a.id AS id, b.id AS other_id FROM (SELECT c_custkey AS id, CAST(c_custkey * 37 % 360 - 180 AS DOUBLE) AS x, CAST(c_custkey * 17 % 170 - 85 AS DOUBLE) AS y FROM customer) a JOIN (SELECT 1000 + s_suppkey AS id, CAST(s_suppkey * 53 % 360 - 180 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 170 - 85 AS DOUBLE) AS y FROM supplier) b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 5")
def sp_dwithin(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = load(spark, d, "supplier").select((k + 1000).alias("id"), (k * 53 % 360 - 180).cast("double").alias("x"), (k * 29 % 170 - 85).cast("double").alias("y"))
    return spatial.within_join(points(spark, d), s, 5.0).select("id", "other_id")


@query(f"""SELECT id, ((((0 > y) <> (40 > y)) AND x < 60 * y / 40.0) <> (((40 > y) <> (0 > y)) AND x < 60 * (y - 40) / -40.0 + 60)) AS inside FROM {PTS} p""")
def sp_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    r = spatial.ring([(0, 0), (60, 40), (120, 0)])
    return points(spark, d).select("id", spatial.in_polygon(F.col("x"), F.col("y"), r).alias("inside"))


@query(f"SELECT id FROM {PTS} p WHERE x BETWEEN -20 AND 60 AND y BETWEEN 0 AND 45")
def sp_bbox(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where(spatial.in_box(F.col("x"), F.col("y"), (-20, 0, 60, 45))).select("id")


@query(f"SELECT id, round(radians(x) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(y) / 2)) * 6378137, 3) AS my FROM {PTS} p")
def sp_mercator(spark: SparkSession, d: str) -> DataFrame:
    m = spatial.to_mercator(F.col("x"), F.col("y"))
    return points(spark, d).select("id", F.round(m["x"], 3).alias("mx"), F.round(m["y"], 3).alias("my"))


@query(f"SELECT id, round(fmod(degrees(atan2(sin(radians(10 - x)) * cos(radians(20)), cos(radians(y)) * sin(radians(20)) - sin(radians(y)) * cos(radians(20)) * cos(radians(10 - x)))) + 360, 360), 6) AS bearing FROM {PTS} p WHERE NOT (x = 10 AND y = 20)")
def sp_bearing(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("not (x = 10 and y = 20)").select("id", F.round(spatial.bearing(F.col("x"), F.col("y"), F.lit(10.0), F.lit(20.0)), 6).alias("bearing"))


@query(f"SELECT id, round(sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)), 9) AS dist FROM {PTS} p ORDER BY dist, id LIMIT 10")
def sp_nearest(spark: SparkSession, d: str) -> DataFrame:
    return sp_distance(spark, d).orderBy("dist", "id").limit(10)


@query(f"SELECT g, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM (SELECT id % 5 AS g, x, y FROM {PTS} p) q GROUP BY g")
def sp_extent(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy((F.col("id") % 5).alias("g")).agg(spatial.extent(F.col("x"), F.col("y")).alias("e")).select("g", "e.*")


@query()
def sp_hull(spark: SparkSession, d: str) -> DataFrame:
    return spatial.group_hull(points(spark, d).withColumn("g", F.col("id") % 5), ["g"], "x", "y")


@query("SELECT event_id, user_id, CASE WHEN i THEN 'enter' ELSE 'exit' END AS event FROM (SELECT event_id, user_id, i, coalesce(lag(i) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM (SELECT event_id, user_id, value BETWEEN 20 AND 60 AS i FROM events) x) y WHERE i <> was")
def sp_geofence(spark: SparkSession, d: str) -> DataFrame:
    return changes.geofence(load(spark, d, "events"), "user_id", "event_id", F.col("value").between(20, 60)).select("event_id", "user_id", "event")


# stream windows, batch twins
@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(value) AS count, round(sum(value), 4) AS sum, min(value) AS min, arg_max(value, ts) AS last FROM events GROUP BY 1, 2")
def win_tumbling(spark: SparkSession, d: str) -> DataFrame:
    got = windows.tumbling(load(spark, d, "events"), "ts", "6 hours", ["event_type"], "value", ["count", "sum", "min", "last"])
    return got.select("window_start", "event_type", "count", F.round("sum", 4).alias("sum"), "min", "last")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(k) AS window_start, event_type, count(value) AS count, round(avg(value), 6) AS avg FROM events, (SELECT unnest([0, 1, 2]) AS k) h GROUP BY 1, 2")
def win_sliding(spark: SparkSession, d: str) -> DataFrame:
    got = windows.sliding(load(spark, d, "events"), "ts", "3 hours", "1 hour", ["event_type"], "value", ["count", "avg"])
    return got.select("window_start", "event_type", "count", F.round("avg", 6).alias("avg"))


@query("""SELECT user_id, min(ts) AS window_start, count(*) AS count, round(sum(value), 4) AS sum FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, s""")
def win_session(spark: SparkSession, d: str) -> DataFrame:
    got = windows.session(load(spark, d, "events"), "ts", "2 hours", ["user_id"], "value", ["count", "sum"])
    return got.select("user_id", "window_start", "count", F.round("sum", 4).alias("sum"))


@query("SELECT user_id, CAST(floor((rn - 1) / 5) AS BIGINT) AS \"window\", count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) x GROUP BY 1, 2")
def win_count(spark: SparkSession, d: str) -> DataFrame:
    return windows.count_windows(load(spark, d, "events"), ["user_id"], "event_id", 5, "value").withColumn("total", F.round("total", 4))


def change_stream(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return load(spark, d, "events").select(F.col("user_id").alias("key"), op.alias("op"), "value", F.col("event_id").alias("seq"), F.lit("events").alias("table"), (F.col("event_id") % 7).alias("tx"))


C = "(SELECT user_id AS key, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, value, event_id AS seq, event_id % 7 AS tx FROM events)"


@query(f"SELECT key, value FROM (SELECT key, arg_max(value, seq) AS value, arg_max(op, seq) AS op FROM {C} c GROUP BY key) x WHERE op <> 'delete'")
def cdc_latest(spark: SparkSession, d: str) -> DataFrame:
    return changes.latest_state(change_stream(spark, d), ["key"], "seq", "op", ["value"])


@query(f"SELECT seq FROM {C} c WHERE op IN ('insert', 'delete') AND tx IN (1, 2)")
def cdc_filter(spark: SparkSession, d: str) -> DataFrame:
    return changes.filter_changes(change_stream(spark, d), ["events"], ["insert", "delete"], [1, 2]).select("seq")


@query("SELECT user_id, count(*) AS version, round(sum(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value ELSE 0 END), 4) AS balance FROM events GROUP BY user_id")
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    return changes.fold_events(load(spark, d, "events"), ["user_id"], "event_id", "event_type", "value", {"purchase": 1, "error": -1}).withColumn("balance", F.round("balance", 4))


@query("SELECT user_id, event_type, 'added' AS change FROM (SELECT user_id, event_type FROM events WHERE value > 50 EXCEPT ALL SELECT user_id, event_type FROM events WHERE value < 60) a UNION ALL SELECT user_id, event_type, 'removed' FROM (SELECT user_id, event_type FROM events WHERE value < 60 EXCEPT ALL SELECT user_id, event_type FROM events WHERE value > 50) b")
def live_diff(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return changes.live_diff(e.where("value < 60").select("user_id", "event_type"), e.where("value > 50").select("user_id", "event_type"))


# changes to tables
@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 0 FROM region")
def insert_select(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "region").select(F.col("r_regionkey") + 100, "r_name")
    return dml.insert_select(load(spark, d, "nation"), rows, ["n_nationkey", "n_name"], {"n_regionkey": F.lit(0)})


NEW = "(SELECT n_nationkey + 10 AS n_nationkey, 'NEW' || n_name AS n_name, 9 AS n_regionkey FROM nation)"


def new_nations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select((F.col("n_nationkey") + 10).alias("n_nationkey"), F.concat(F.lit("NEW"), "n_name").alias("n_name"), F.lit(9).alias("n_regionkey"))


@query(f"SELECT * FROM nation UNION ALL SELECT * FROM {NEW} x WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def upsert_do_nothing(spark: SparkSession, d: str) -> DataFrame:
    return dml.upsert_do_nothing(load(spark, d, "nation"), new_nations(spark, d), ["n_nationkey"])


@query(f"SELECT coalesce(o.n_nationkey, x.n_nationkey) AS n_nationkey, coalesce(x.n_name, o.n_name) AS n_name, coalesce(o.n_regionkey, x.n_regionkey) AS n_regionkey FROM nation o FULL JOIN {NEW} x ON o.n_nationkey = x.n_nationkey")
def upsert_do_update(spark: SparkSession, d: str) -> DataFrame:
    return dml.upsert_do_update(load(spark, d, "nation"), new_nations(spark, d), ["n_nationkey"], ["n_name"])


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def update_expr(spark: SparkSession, d: str) -> DataFrame:
    return dml.update(load(spark, d, "supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": F.lit(0.0)}, F.col("s_acctbal") < 0)


@query("SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN 'R1' ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def update_from(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return dml.update_from(load(spark, d, "customer"), n, ["c_nationkey"], {"c_mktsegment": F.lit("R1")}).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def delete_using(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return dml.delete_using(load(spark, d, "customer"), o, ["c_custkey"]).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE NOT coalesce(nullif(p_size, 7) > 25, false)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete(load(spark, d, "part"), F.nullif(F.col("p_size"), F.lit(7)) > 25).select("p_partkey")


@query("SELECT user_id, event_id AS xmin, value FROM events WHERE event_id <= 600 AND NOT (event_id % 5 = 0 AND event_id + 100 <= 600) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def mvcc_snapshot(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "events").select("user_id", F.col("event_id").alias("xmin"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") + 100).alias("xmax"), "value")
    return dml.mvcc_snapshot(v, ["user_id"], 600).select("user_id", "xmin", "value")


@query(f"SELECT event_id FROM {S} s WHERE t_ms >= (SELECT max(t_ms) FROM {S} t) - {5 * DAY}")
def retention(spark: SparkSession, d: str) -> DataFrame:
    return dml.retain(samples(spark, d), F.col("t_ms"), 5 * DAY).select("event_id")


@query("SELECT event_id, CASE WHEN h < 48 THEN 'hot' WHEN h <= 720 THEN 'warm' ELSE 'cold' END AS tier FROM (SELECT event_id, (epoch_ms(TIMESTAMP '2024-02-05') - epoch_us(ts) // 1000) / 3600000.0 AS h FROM events) x")
def tiering(spark: SparkSession, d: str) -> DataFrame:
    age = (F.lit(1707091200000) - ts.epoch_ms(F.col("ts"))) / 3_600_000.0
    return load(spark, d, "events").select("event_id", dml.tier(age).alias("tier"))


@query("SELECT c_custkey, repeat('*', length(c_name) - 4) || right(c_name, 4) AS c_name FROM customer WHERE c_nationkey = 3 OR c_acctbal > 9000")
def masking_row_security(spark: SparkSession, d: str) -> DataFrame:
    rows = dml.row_security(load(spark, d, "customer"), [F.col("c_nationkey") == 3, F.col("c_acctbal") > 9000])
    return dml.mask_column(rows, "c_name", "partial").select("c_custkey", "c_name")


# statistics, features, text
@query("SELECT event_type, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 4) AS intercept, round(regr_r2(value, user_id), 6) AS r2 FROM events GROUP BY event_type")
def linreg(spark: SparkSession, d: str) -> DataFrame:
    got = ml.linear_regression(load(spark, d, "events"), "value", "user_id", ["event_type"])
    return got.select("event_type", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, 0.0 AS constant FROM lineitem GROUP BY l_returnflag")
def corr(spark: SparkSession, d: str) -> DataFrame:
    q, e = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(ml.correlation(q, e), 6).alias("r"), ml.correlation(q, F.lit(1.0)).alias("constant"))


same_sql("covar", "SELECT l_returnflag, round(covar_samp(l_quantity, l_tax), 6) AS s, round(covar_pop(l_quantity, l_tax), 6) AS p FROM lineitem GROUP BY l_returnflag")


@query("SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type), 6) AS zscore FROM events")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return ml.standardize(load(spark, d, "events"), "value", ["event_type"]).select("event_id", F.round("zscore", 6).alias("zscore"))


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 9) AS scaled FROM events")
def minmax(spark: SparkSession, d: str) -> DataFrame:
    return ml.minmax(load(spark, d, "events"), "value").select("event_id", F.round("scaled", 9).alias("scaled"))


@query("SELECT event_id, CAST(event_type = 'click' AS INT) AS event_type_click, CAST(event_type = 'view' AS INT) AS event_type_view FROM events")
def onehot(spark: SparkSession, d: str) -> DataFrame:
    return ml.one_hot(load(spark, d, "events"), "event_type", ["click", "view"]).select("event_id", "event_type_click", "event_type_view")


@query("SELECT event_id, round(pow(value, 2), 6) AS value_2, round(pow(value, 3), 4) AS value_3, round(ln(value + 1), 9) AS log, round(sqrt(value), 9) AS root FROM events WHERE value >= 0")
def polynomial(spark: SparkSession, d: str) -> DataFrame:
    got = ml.polynomial(load(spark, d, "events").where("value >= 0"), "value", 3)
    return got.select("event_id", F.round("value_2", 6).alias("value_2"), F.round("value_3", 4).alias("value_3"), F.round(F.log1p("value"), 9).alias("log"), F.round(F.sqrt("value"), 9).alias("root"))


@query(r"SELECT doc_id, type, text, 0.8 AS confidence FROM (SELECT doc_id, 'email' AS type, unnest(regexp_extract_all(text, '[a-z0-9._]+@[a-z0-9.]+[a-z]')) AS text FROM documents UNION ALL SELECT doc_id, 'number', unnest(regexp_extract_all(text, '[0-9]{3,}')) FROM documents) x")
def entity_regex(spark: SparkSession, d: str) -> DataFrame:
    return text.extract_patterns(load(spark, d, "documents"), "doc_id", "text", {"email": "[a-z0-9._]+@[a-z0-9.]+[a-z]", "number": "[0-9]{3,}"})


@query("SELECT DISTINCT doc_id, k AS text FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS w FROM documents) x JOIN (VALUES ('Idiot'), ('clown')) t(k) ON w = lower(k)".replace("\\\\", "\\"))
def entity_keyword(spark: SparkSession, d: str) -> DataFrame:
    known = spark.sql("SELECT * FROM VALUES ('Idiot', 'insult'), ('clown', 'insult') AS t(keyword, type)")
    return text.extract_keywords(load(spark, d, "documents"), "doc_id", "text", known).select("doc_id", "text")


@query(r"SELECT text, 'number' AS type, 0.8 AS confidence FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]{3,}')) AS text FROM documents) x")
def entity_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = text.extract_patterns(load(spark, d, "documents"), "doc_id", "text", {"number": "[0-9]{3,}"})
    return text.dedupe_exact(found)


@query(f"""SELECT a.src AS start, a.dst AS "end", 1 AS hops, round(0.9, 6) AS confidence FROM {EDGES} a UNION ALL SELECT a.src, b.dst, 2, round(0.81, 6) FROM {EDGES} a JOIN {EDGES} b ON a.dst = b.src""")
def path_score(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = place_graph(spark, d)
    return text.best_paths(nodes, edges.withColumn("confidence", F.lit(0.9)), 2, 3).select("start", "end", "hops", F.round("confidence", 6).alias("confidence"))


@query(r"SELECT doc_id, CAST(a + b AS BIGINT) AS score FROM (SELECT doc_id, len(regexp_extract_all(lower(text), '\bthat\b')) AS a, len(regexp_extract_all(lower(text), '\bwith\b')) AS b FROM documents) x WHERE a > 0 AND b > 0")
def fulltext(spark: SparkSession, d: str) -> DataFrame:
    return text.term_frequencies(load(spark, d, "documents"), "doc_id", "text", ["that", "with"])
