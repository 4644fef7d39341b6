"""Queries through the front ends, sources and compositions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import spatial
from tessera.operators import graph, knowledge
from tessera.plans import aql, cql, multimodel
from tessera.plans.commands import Store
from tessera.plans.cypher import Graph
from tessera.plans.procedures import ProcedureCatalog, call
from tessera.queries.base import query
from tessera.queries.models import EDGES, PTS, S, place_graph, points, samples
from tessera.session import load, load_views
from tessera.sources import catalog, files
from tessera.sources.rounds import shared_folder
from tessera.sources.versions import VersionedTable
from tessera.streaming import changes


def labelled_graph(spark: SparkSession, d: str) -> Graph:
    nodes, edges = place_graph(spark, d)
    i = F.col("id")
    label = F.when(i < 100, "Region").when(i < 1000, "Nation").when(i < 10_000_000, "Supplier").otherwise("Customer")
    return Graph(nodes.select("id", F.array(label).alias("labels")), edges)


@query(f"SELECT b.dst AS region, count(*) AS n FROM {EDGES} a JOIN {EDGES} b ON a.dst = b.src WHERE a.type = 'lives_in' GROUP BY b.dst")
def cypher_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return labelled_graph(spark, d).query("MATCH (c:Customer)-[:lives_in]->(n:Nation)-[:in_region]->(r:Region) RETURN r.id AS region, count(*) AS n")


@query(f"SELECT n.id AS nation, e.src AS supplier FROM (SELECT DISTINCT src AS id FROM {EDGES} x WHERE type = 'in_region') n LEFT JOIN (SELECT * FROM {EDGES} y WHERE type = 'based_in') e ON e.dst = n.id")
def cypher_optional(spark: SparkSession, d: str) -> DataFrame:
    return labelled_graph(spark, d).query("MATCH (n:Nation) OPTIONAL MATCH (s)-[:based_in]->(n) RETURN n.id AS nation, s.id AS supplier")


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES} x), p(a, b, h) AS (SELECT src, dst, 1 FROM e UNION ALL SELECT p.a, e.dst, h + 1 FROM p JOIN e ON p.b = e.src WHERE h < 2) SELECT a, b FROM p WHERE a >= 10000000")
def cypher_variable_length(spark: SparkSession, d: str) -> DataFrame:
    return labelled_graph(spark, d).query("MATCH (c:Customer)-[*1..2]->(x) RETURN c.id AS a, x.id AS b")


@query(f"SELECT dst AS id, count(*) AS in_degree FROM {EDGES} e GROUP BY dst")
def call_procedure(spark: SparkSession, d: str) -> DataFrame:
    return call("graph.degreeCentrality", *place_graph(spark, d)).where("in_degree > 0").select("id", "in_degree")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(max(c_acctbal), 2) AS best FROM customer WHERE c_acctbal > 1000 GROUP BY c_mktsegment")
def aql_collect(spark: SparkSession, d: str) -> DataFrame:
    text = "FOR c IN customer FILTER c.c_acctbal > 1000 COLLECT segment = c.c_mktsegment AGGREGATE n = COUNT(1), best = ROUND(MAX(c.c_acctbal), 2) RETURN {segment: segment, n: n, best: best}"
    return aql.run(spark, text, {"customer": load(spark, d, "customer")})


@query("SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")
def aql_join(spark: SparkSession, d: str) -> DataFrame:
    text = "FOR o IN orders FILTER o.o_totalprice > 200000 FOR c IN customer FILTER o.o_custkey == c.c_custkey RETURN {k: o.o_orderkey, name: c.c_name}"
    return aql.run(spark, text, {"customer": load(spark, d, "customer"), "orders": load(spark, d, "orders")})


@query("SELECT vec_id FROM embeddings WHERE list_contains([label, label + 1], 3)")
def cql_contains(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "embeddings").select("vec_id", F.array("label", F.col("label") + 1).alias("tags"))
    return cql.Keyspace(spark, {"t": t}).execute("SELECT vec_id FROM t WHERE tags CONTAINS 3 ALLOW FILTERING")


@query(f"SELECT t_ms // 3600000 * 3600000 AS bucket, max(value) AS max FROM {S} s WHERE t_ms BETWEEN 1704500000000 AND 1705500000000 GROUP BY 1")
def mm_range(spark: SparkSession, d: str) -> DataFrame:
    return multimodel.Engine(spark, {"metrics": samples(spark, d)}).query("SELECT * FROM metrics RANGE 1704500000000 TO 1705500000000 BUCKET 1h max value")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def mm_fetch(spark: SparkSession, d: str) -> DataFrame:
    e = multimodel.Engine(spark, {"orders": load(spark, d, "orders"), "customer": load(spark, d, "customer")}, {"o_custkey": ("customer", "c_custkey")})
    return e.query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' FETCH o_custkey").select("o_orderkey", "o_custkey_row.c_name")


@query(f"SELECT 'click' AS series, t_ms // 86400000 * 86400000 AS t_ms, round(avg(value), 6) AS value FROM {S} s WHERE series = 'click' GROUP BY 2")
def command_ts_range(spark: SparkSession, d: str) -> DataFrame:
    s = Store(spark)
    s.load_series(samples(spark, d))
    return s.run("TS.RANGE click - + AGGREGATION avg 86400000").withColumn("value", F.round("value", 6))


@query("SELECT 4095 AS total")
def stored_procedure(spark: SparkSession, d: str) -> DataFrame:
    p = ProcedureCatalog(spark)
    p.register("sum_to", ["n"], "WITH RECURSIVE t(i, s) AS (SELECT 0, 0 UNION ALL SELECT i + 1, s + i + 1 FROM t WHERE i < :n) SELECT max(s) AS total FROM t")
    return p.call("sum_to", n=90)


@query()
def information_schema(spark: SparkSession, d: str) -> DataFrame:
    load_views(spark, d)
    catalog.declare("orders", "PRIMARY KEY", ["o_orderkey"])
    return catalog.columns(spark)


@query("SELECT n_nationkey, n_name, 1 AS version FROM nation UNION ALL SELECT n_nationkey, n_name, 2 FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name, 2 FROM region")
def time_travel(spark: SparkSession, d: str) -> DataFrame:
    t = VersionedTable(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}")
    first = t.write(load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"))
    t.append(load(spark, d, "region").select((F.col("r_regionkey") + 1000).alias("n_nationkey"), F.col("r_name").alias("n_name")))
    return t.read(snapshot=first).withColumn("version", F.lit(1)).unionByName(t.read().withColumn("version", F.lit(2)))


@query("SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-29' THEN 'hot' WHEN ts >= TIMESTAMP '2024-01-01' THEN 'warm' ELSE 'cold' END AS tier FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def tiered_scan(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    e = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    utc = spark.sql("SELECT timestamp'2024-01-31 00:00:00' AS now, timestamp'2024-01-10 00:00:00' AS start").first()
    assert isinstance(utc["now"], datetime)
    return files.tiered_scan(e, e, e, "ts", utc["now"], start=utc["start"]).select("event_id", "tier")


@query(f"""SELECT user_id, event_id, round(sqrt(pow(x - px, 2) + pow(y - py, 2)), 6) AS move FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT event_id, user_id, value * 30 AS x, CAST(event_id % 90 AS DOUBLE) AS y FROM {S} s) a WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) b WHERE sqrt(pow(x - px, 2) + pow(y - py, 2)) > 1000""")
def sp_movement(spark: SparkSession, d: str) -> DataFrame:
    e = samples(spark, d).select("event_id", "user_id", (F.col("value") * 30).alias("x"), (F.col("event_id") % 90).cast("double").alias("y"))
    got = changes.movement_alerts(e, "user_id", "event_id", "x", "y", max_speed=1e12)
    return got.select("user_id", "event_id", F.round("move", 6).alias("move"))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT DISTINCT x, y, id FROM {PTS} z), n AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON b.x BETWEEN a.x - 4 AND a.x + 4 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4),
core AS MATERIALIZED (SELECT a AS id FROM n GROUP BY a HAVING count(*) >= 3)
SELECT p.id, (p.id IN (SELECT id FROM core) OR p.id IN (SELECT n.a FROM n WHERE n.b IN (SELECT id FROM core))) AS clustered FROM p""")
def sp_dbscan(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dbscan(points(spark, d), 4.0, 3).select("id", F.col("cluster").isNotNull().alias("clustered"))


@query()
def sp_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return spatial.kmeans(points(spark, d), 5)


@query(r"SELECT count(DISTINCT t) AS entities, 1 AS types FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{3,}')) AS t FROM documents) x")
def rag_stats(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, edges = knowledge.build_knowledge(load(spark, d, "documents"), "doc_id", "text", {"number": "[0-9]{3,}"})
    return knowledge.stats(nodes, edges).select("entities", "types")


@query()
def rag_query(spark: SparkSession, d: str) -> DataFrame:
    known = spark.sql("SELECT * FROM VALUES ('idiot', 'insult'), ('clown', 'insult'), ('moron', 'insult') AS t(keyword, type)")
    entities, nodes, edges = knowledge.build_knowledge(load(spark, d, "documents"), "doc_id", "text", {"number": "[0-9]{6,}"}, known)
    return knowledge.rag_query(entities, nodes, edges, "doc_id", ["clown"])


@query(f"SELECT id, CASE WHEN id < 100 THEN 0 WHEN id < 1000 THEN 1 ELSE 2 END AS depth FROM (SELECT src AS id FROM {EDGES} a UNION SELECT dst FROM {EDGES} b) x")
def g_levels(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = place_graph(spark, d)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.bfs(nodes.where("id < 100"), turned).select(F.col("node").alias("id"), "depth").join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")
