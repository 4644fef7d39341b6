"""Queries for what the other modules leave out: lookups, versions, statements, commands, features, rules and front ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import keyed, user, vector_index, vectors
from tessera.operators import dml, features, graph, text
from tessera.operators.triggers import Database, Trigger
from tessera.plans import aql, multimodel, transactions
from tessera.plans.commands import Store
from tessera.plans.graphrag import KnowledgeBases
from tessera.plans.procedures import ProcedureCatalog
from tessera.plans.session import Session
from tessera.queries.base import query
from tessera.queries.fronts import labelled_graph
from tessera.queries.models import BOUGHT, DAY, EDGES, HOUR, S, TRADE, W, place_graph, samples, trade_graph
from tessera.session import TABLES, load, load_views
from tessera.sources import catalog, files
from tessera.sources.rounds import shared_folder
from tessera.sources.versions import VersionedTable
from tessera.streaming import changes, windows


def _versions(spark: SparkSession, df: DataFrame) -> VersionedTable:
    t = VersionedTable(spark, f"{shared_folder(spark)}/surface-{uuid.uuid4().hex}")
    t.write(df)
    return t


# scans, versions, sinks


@query("SELECT * FROM customer WHERE c_custkey = 7")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return files.point_lookup(load(spark, d, "customer"), "c_custkey", 7)


@query("SELECT n_nationkey AS k, 'first' AS which FROM nation UNION ALL SELECT n_nationkey, 'tag' FROM nation UNION ALL SELECT k, 'head' FROM (SELECT n_nationkey AS k FROM nation UNION ALL SELECT 1000 + r_regionkey FROM region) h UNION ALL SELECT 2000, 'dev' UNION ALL SELECT n_nationkey, 'dev' FROM nation UNION ALL SELECT n_nationkey, 'back' FROM nation")
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """By snapshot id, tag and branch, and a branch moved back."""
    keys = load(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    t = _versions(spark, keys)
    t.tag("v1", 1)
    t.append(load(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("int").alias("k")))
    t.branch("dev", 1)
    t.append(spark.createDataFrame([(2000,)], "k int"), "dev")
    out = None
    for which, read in (("first", {"snapshot": 1}), ("tag", {"tag": "v1"}), ("head", {}), ("dev", {"branch": "dev"})):
        rows = t.read(**read).withColumn("which", F.lit(which))
        out = rows if out is None else out.unionByName(rows)
    t.branch("main", 1)
    return out.unionByName(t.read().withColumn("which", F.lit("back")))


@query("SELECT * FROM (VALUES (1, 'main', NULL), (2, 'main', 1), (3, 'dev', 1)) t(snapshot, branch, parent)")
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    t = _versions(spark, load(spark, d, "region"))
    t.append(load(spark, d, "region"))
    t.branch("dev", 1)
    t.append(load(spark, d, "region"), "dev")
    return t.snapshots().select(F.col("snapshot").cast("int").alias("snapshot"), "branch", F.col("parent").cast("int").alias("parent"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus")
def partitioned_files(spark: SparkSession, d: str) -> DataFrame:
    """A sink partitioned by a column, read with a filter that prunes its folders."""
    path = f"{shared_folder(spark)}/by-status-{uuid.uuid4().hex}"
    files.write(load(spark, d, "orders"), path, partition_by=["o_orderstatus"])
    return files.read(spark, path, where="o_orderstatus IN ('F', 'O')").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT series, t_ms // {DAY} AS day, count(*) AS n FROM {S} s GROUP BY 1, 2")
def series_files(spark: SparkSession, d: str) -> DataFrame:
    """A series sink partitioned by series and day."""
    path = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    files.write(samples(spark, d).withColumn("day", F.floor(F.col("t_ms") / DAY)), path, partition_by=["series", "day"])
    return files.read(spark, path).groupBy("series", F.col("day").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'nation:' || n_nationkey AS key, n_name AS name FROM nation")
def change_messages(spark: SparkSession, d: str) -> DataFrame:
    """What change sinks send."""
    return changes.to_topic(load(spark, d, "nation"), "nation", "n_nationkey").select("key", F.get_json_object("value", "$.n_name").alias("name"))


@query("SELECT table_name, column_name, ordinal_position FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def schema_columns(spark: SparkSession, d: str) -> DataFrame:
    load_views(spark, d)
    return catalog.columns(spark).where(F.col("table_name").isin(*TABLES)).select("table_name", "column_name", "ordinal_position")


@query("SELECT 'orders_o_orderkey_primary' AS constraint_name, 'orders' AS table_name, 'o_orderkey' AS column_name, 1 AS ordinal_position")
def schema_keys(spark: SparkSession, d: str) -> DataFrame:
    catalog.declare("orders", "PRIMARY KEY", ["o_orderkey"])
    return catalog.key_column_usage(spark).where("table_name = 'orders'").distinct()


@query("SELECT true AS near FROM lineitem LIMIT 1")
def approx_distinct_bound(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's count against the exact one."""
    one = load(spark, d, "lineitem").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.count_distinct("l_orderkey").alias("b"))
    return one.select((F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("near"))


# statements


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN round(s_acctbal * 2, 2) ELSE s_acctbal END AS s_acctbal, CASE WHEN s_nationkey = 3 THEN ['x', 'z'] ELSE ['x', 'y'] END AS tags FROM supplier")
def update_operators(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.array(F.lit("x"), F.lit("y")).alias("tags"))
    here = F.col("s_nationkey") == 3
    s = dml.apply_operators(s, {"s_acctbal": ("*=", F.lit(2)), "tags": ("append", F.lit("z"))}, here)
    s = dml.apply_operators(s, {"tags": ("remove", F.lit("y"))}, here)
    return s.select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"), "tags")


@query("SELECT n_nationkey AS id, 'insert' AS how FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'update' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, 'delete' FROM nation WHERE n_regionkey = 3 UNION ALL SELECT n_nationkey, 'upsert' FROM nation WHERE n_regionkey = 0")
def returning(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "nation").createOrReplaceTempView("surface_nation")
    s = Session(spark, {"t": _versions(spark, load(spark, d, "nation").where("n_regionkey <> 1"))})
    out = [
        s.execute("INSERT INTO t SELECT * FROM surface_nation WHERE n_regionkey = 1 RETURNING n_nationkey AS id, 'insert' AS how"),
        s.execute("UPDATE t SET n_name = upper(n_name) WHERE n_regionkey = 2 RETURNING n_nationkey AS id, 'update' AS how"),
        s.execute("DELETE FROM t WHERE n_regionkey = 3 RETURNING n_nationkey AS id, 'delete' AS how"),
        s.execute("INSERT INTO t SELECT * FROM surface_nation WHERE n_regionkey = 0 ON CONFLICT (n_nationkey) DO UPDATE SET n_name = EXCLUDED.n_name RETURNING n_nationkey AS id, 'upsert' AS how"),
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT r_regionkey AS k, CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END AS name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 9, 'nine'")
def transaction_savepoints(spark: SparkSession, d: str) -> DataFrame:
    t = _versions(spark, load(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("name")))
    s = Session(spark, {"t": t})
    for statement in ("BEGIN ISOLATION LEVEL SERIALIZABLE", "UPDATE t SET name = 'one' WHERE k = 1", "SAVEPOINT a", "DELETE FROM t", "ROLLBACK TO a", "DELETE FROM t WHERE k = 4", "RELEASE a", "INSERT INTO t VALUES (9, 'nine')", "COMMIT", "BEGIN", "DELETE FROM t", "ROLLBACK"):
        s.execute(statement)
    return t.read()


@query("SELECT n_nationkey AS id, n_name AS was, upper(n_name) AS now FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 3")
def triggers(spark: SparkSession, d: str) -> DataFrame:
    """A BEFORE trigger that rewrites, one that keeps a row, and an AFTER trigger that logs old and new."""
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    db = Database({"nation": n, "log": n.limit(0).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("was"), F.col("n_name").alias("now"))})
    db.create(Trigger("rewrite", "nation", "update", "before", assign={"n_name": "upper(new.n_name)"}))
    db.create(Trigger("keep", "nation", "update", "before", when="old.n_nationkey = 3", skip=True))
    db.create(Trigger("log", "nation", "update", into="log", values={"id": "new.n_nationkey", "was": "old.n_name", "now": "new.n_name"}))
    db.update("nation", {"n_regionkey": F.col("n_regionkey") + 10}, F.col("n_regionkey") == 1)
    return db.tables["log"]


@query("SELECT * FROM (VALUES (1), (2), (3), (4)) t(transaction)")
def deadlocks(spark: SparkSession, d: str) -> DataFrame:
    """A circle of two, one of two more, a waiter between none, and one that waits for a circle."""
    waits = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 3), (5, 1), (6, 7)], "waiter int, holder int")
    return transactions.deadlocked(waits)


# front ends


@query("SELECT 100 + n_nationkey AS id FROM nation ORDER BY id DESC LIMIT 5 OFFSET 2")
def cypher_order(spark: SparkSession, d: str) -> DataFrame:
    return labelled_graph(spark, d).query("MATCH (n:Nation) RETURN n.id AS id ORDER BY n.id DESC SKIP 2 LIMIT 5")


@query("SELECT 103 AS id, 1 AS n")
def cypher_properties(spark: SparkSession, d: str) -> DataFrame:
    return labelled_graph(spark, d).query("MATCH (n:Nation {id: 103}) RETURN n.id AS id, count(*) AS n")


@query("SELECT 100 + n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 'far' END AS tag FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 9001, 'new'")
def cypher_changes(spark: SparkSession, d: str) -> DataFrame:
    """CREATE, SET and DETACH DELETE."""
    g = labelled_graph(spark, d)
    g = g.execute("CREATE (n:Nation {id: 9001})").execute("MATCH (n:Nation {id: 9001}) SET n.tag = 'new'")
    g = g.execute("MATCH (n:Nation)-[:in_region]->(r:Region {id: 2}) SET n.tag = 'far'").execute("MATCH (n:Nation)-[:in_region]->(r:Region {id: 1}) DETACH DELETE n")
    return g.query("MATCH (n:Nation) RETURN n.id AS id, n.tag AS tag")


@query("SELECT n_nationkey AS k FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 4 OFFSET 3")
def aql_sort(spark: SparkSession, d: str) -> DataFrame:
    return aql.run(spark, "FOR n IN nation SORT n.n_regionkey DESC, n.n_nationkey LIMIT 3, 4 RETURN {k: n.n_nationkey}", {"nation": load(spark, d, "nation")})


@query(f"SELECT event_id, row_number() OVER (PARTITION BY series ORDER BY t_ms, event_id) AS n FROM {S} s ORDER BY t_ms DESC, event_id LIMIT 20")
def mm_window_sort(spark: SparkSession, d: str) -> DataFrame:
    text_ = "SELECT event_id, row_number() OVER (PARTITION BY series ORDER BY t_ms, event_id) AS n FROM metrics ORDER BY t_ms DESC, event_id LIMIT 20"
    return multimodel.Engine(spark, {"metrics": samples(spark, d)}).query(text_)


@query("SELECT * FROM (VALUES ('1h', 3600000), ('250ms', 250), ('2d', 172800000), ('1w', 604800000)) t(duration, ms)")
def durations(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(t, multimodel.duration_ms(t)) for t in ("1h", "250ms", "2d", "1w")], "duration string, ms int")


@query("SELECT true AS same_day, true AS ordered")
def clock(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT to_date(current_timestamp()) = current_date() AS same_day, now() >= current_timestamp() - INTERVAL 1 DAY AS ordered")


@query("SELECT 'add' AS name, 5 AS total UNION ALL SELECT 'left', 1")
def procedure_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = ProcedureCatalog(spark)
    p.register("add", ["a", "b"], "SELECT :a + :b AS total")
    p.register("gone", [], "SELECT 0 AS total")
    p.drop("gone")
    return p.call("add", a=2, b=3).select(F.lit("add").alias("name"), "total").unionByName(spark.createDataFrame([("left", len(p.list()))], "name string, total int"))


@query("SELECT n_nationkey, n_nationkey * 2 + 1 AS twice, CAST(range AS INT) AS step FROM nation, range(2)")
def user_functions(spark: SparkSession, d: str) -> DataFrame:
    """A SQL function and a table function, by name in SQL."""
    user.register_sql(spark, "twice_and_one", "x BIGINT", "BIGINT", "x * 2 + 1")
    user.register_table(spark, "steps_to", lambda n: ((k,) for k in range(n)), "step int")
    load(spark, d, "nation").createOrReplaceTempView("surface_nation")
    return spark.sql("SELECT n_nationkey, twice_and_one(n_nationkey) AS twice, step FROM surface_nation, LATERAL steps_to(2)")


@query("SELECT c_mktsegment, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_mktsegment")
def user_aggregate(spark: SparkSession, d: str) -> DataFrame:
    user.register_aggregate(spark, "spread_of", lambda v: float(v.max() - v.min()), "double")
    load(spark, d, "customer").createOrReplaceTempView("surface_customer")
    return spark.sql("SELECT c_mktsegment, round(spread_of(c_acctbal), 2) AS spread FROM surface_customer GROUP BY c_mktsegment")


# commands


@query(f"SELECT t_ms, value FROM {S} s WHERE series = 'click' ORDER BY t_ms DESC LIMIT 7")
def command_ts_revrange(spark: SparkSession, d: str) -> DataFrame:
    s = Store(spark)
    s.load_series(samples(spark, d))
    return s.run("TS.REVRANGE click - + COUNT 7").select("t_ms", "value")


@query(f"SELECT series, t_ms // {DAY} * {DAY} AS t_ms, CAST(max(value) AS DOUBLE) AS value FROM {S} s WHERE series IN ('click', 'view') GROUP BY 1, 2")
def command_ts_mrange(spark: SparkSession, d: str) -> DataFrame:
    s = Store(spark)
    s.load_series(samples(spark, d))
    for key in ("click", "view"):
        s.run(f"TS.ALTER {key} LABELS kind web")
    s.run("TS.ALTER purchase LABELS kind shop")
    return s.run(f"TS.MRANGE - + AGGREGATION max {DAY} FILTER kind=web")


@query("SELECT * FROM (VALUES (10, 1.5), (20, 4.0), (30, 3.0)) t(t_ms, value)")
def command_ts_changes(spark: SparkSession, d: str) -> DataFrame:
    s = Store(spark)
    for line in ("TS.CREATE a", "TS.ADD a 10 1.5", "TS.INCRBY a 2.5 20", "TS.DECRBY a 1 30", "TS.MADD a 40 9 a 50 9", "TS.DEL a 40 60"):
        s.run(line)
    return s.run("TS.RANGE a - +").select(F.col("t_ms").cast("int").alias("t_ms"), "value")


COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round({COSINE}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {COSINE} DESC, id LIMIT 5")
def command_vectors(spark: SparkSession, d: str) -> DataFrame:
    """FT.CREATE and a filtered FT.SEARCH."""
    e, s = load(spark, d, "embeddings"), Store(spark)
    first = e.where("vec_id = 0").select("embedding").first()[0]
    s.run(f"FT.CREATE idx ON HASH SCHEMA v VECTOR FLAT 6 TYPE FLOAT32 DIM {len(first)} DISTANCE_METRIC COSINE")
    s.load_vectors("idx", e.select(F.col("vec_id").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata")))
    found = s.run(f"FT.SEARCH idx '@label:{{3}}=>[KNN 5 @v $q]' PARAMS 2 q {','.join(map(str, first))}")
    return found.withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))), 5) AS l2, round(1 / (1 + list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), lambda p: abs(p[1] - p[2])))), 5) AS l1 FROM embeddings")
def vec_scores(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    q = F.array(*[F.lit(float(v)) for v in e.where("vec_id = 0").select("embedding").first()[0]])
    v = F.col("embedding")
    return e.select("vec_id", F.round(vectors.score("l2", v, q), 5).alias("l2"), F.round(vectors.score("l1", v, q), 5).alias("l1"))


@query("SELECT true AS enough, count(*) AS indexed FROM embeddings WHERE embedding IS NOT NULL")
def vec_index(spark: SparkSession, d: str) -> DataFrame:
    """Recall at ten of the inverted-file index, for every vector whose id is divisible by 100, against brute force; and how many rows it has."""
    e = load(spark, d, "embeddings")
    index = vector_index.build(e)
    q = e.where("vec_id % 100 = 0")
    probes = vector_index.probes_for(e, index, q, 10)
    share = vector_index.recall(vector_index.search_many(e, index, q, 10, probes), vectors.knn_join(e, q, 10))
    return spark.read.parquet(index.path).agg(F.count(F.lit(1)).alias("indexed")).select(F.lit(share >= 0.9).alias("enough"), "indexed")


@query("SELECT 10 + n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def command_graph(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.cypher import Graph

    s, n = Store(spark), load(spark, d, "nation")
    nodes = n.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.array(F.lit("Nation")).alias("labels")).unionByName(n.select((F.col("n_regionkey") + 10).cast("long").alias("id"), F.array(F.lit("Region")).alias("labels")).distinct())
    s.load_graph("g", Graph(nodes, n.select((F.col("n_nationkey") + 100).cast("long").alias("src"), (F.col("n_regionkey") + 10).cast("long").alias("dst"), F.lit("in").alias("type"))))
    return s.run("GRAPH.QUERY g 'MATCH (n:Nation)-[:in]->(r:Region) RETURN r.id AS region, count(*) AS n'")


@query("SELECT count(*) AS documents, (SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{3,}')) AS t FROM documents) x) AS entities FROM documents")
def graphrag_stats(spark: SparkSession, d: str) -> DataFrame:
    kb = KnowledgeBases(spark, {"number": "[0-9]{3,}"})
    kb.add("kb", load(spark, d, "documents").select("doc_id", "text"))
    return kb.execute("SELECT * FROM GRAPHRAG_STATS('kb')").select("documents", "entities")


@query("SELECT * FROM (VALUES ('Ada', 2), ('Acme', 2), ('Oslo', 1)) t(text, documents)")
def graphrag_entities(spark: SparkSession, d: str) -> DataFrame:
    s = Store(spark)
    s.run("GRAPHRAG.BUILD kb d1 'we met Ada at Acme'")
    s.run("GRAPHRAG.BUILD kb d2 'then Ada left Acme for Oslo'")
    found = aql.run(spark, "FOR e IN GRAPHRAG_ENTITIES('kb', 'name', 10) RETURN {text: e.text, documents: e.documents}", {}, s.knowledge)
    return found.select("text", F.col("documents").cast("int").alias("documents"))


# keyed stores


SCORES = "(SELECT event_type, user_id, sum(value) AS score FROM events GROUP BY event_type, user_id)"


@query(f"SELECT a.event_type, count(*) AS rank FROM {SCORES} a JOIN {SCORES} b ON a.event_type = b.event_type AND b.user_id = 7 WHERE (a.score < b.score OR (a.score = b.score AND a.user_id < 7)) GROUP BY a.event_type UNION ALL SELECT event_type, 0 FROM {SCORES} b WHERE user_id = 7 AND NOT EXISTS (SELECT 1 FROM {SCORES} a WHERE a.event_type = b.event_type AND (a.score < b.score OR (a.score = b.score AND a.user_id < 7)))")
def kv_zrank(spark: SparkSession, d: str) -> DataFrame:
    z = keyed.zset(load(spark, d, "events").select("event_type", "user_id", F.col("value").alias("score")), "event_type", "user_id", "score")
    return keyed.zrank(z, "event_type", "user_id", "score", 7)


@query(f"SELECT event_type, count(*) FILTER (WHERE score BETWEEN 50 AND 500) AS n FROM {SCORES} s GROUP BY event_type")
def kv_zcount(spark: SparkSession, d: str) -> DataFrame:
    z = keyed.zset(load(spark, d, "events").select("event_type", "user_id", F.col("value").alias("score")), "event_type", "user_id", "score")
    return keyed.zcount(z, "event_type", "score", 50, 500)


@query(f"SELECT event_type, user_id FROM {SCORES} s WHERE score BETWEEN 50 AND 500")
def kv_zrangebyscore(spark: SparkSession, d: str) -> DataFrame:
    z = keyed.zset(load(spark, d, "events").select("event_type", "user_id", F.col("value").alias("score")), "event_type", "user_id", "score")
    return keyed.zrange_by_score(z, "score", 50, 500).select("event_type", "user_id")


# streams


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS window_start, count(value) AS count FROM events GROUP BY 1, 2")
def stream_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of a watermarked window: every event counts, as none is later than the bound."""
    return windows.tumbling(load(spark, d, "events"), "ts", "6 hours", ["event_type"], "value", ["count"], late="10 days").select("event_type", "window_start", "count")


@query("SELECT CAST(n_nationkey // 10 AS INT) AS batch, count(*) AS n FROM nation GROUP BY 1")
def row_batches(spark: SparkSession, d: str) -> DataFrame:
    found = changes.rows_in_batches(load(spark, d, "nation").select("n_nationkey").coalesce(1).sortWithinPartitions("n_nationkey"), 10)
    return spark.createDataFrame([(k, len(b)) for k, b in enumerate(found)], "batch int, n long")


# graphs with circles and several shortest paths


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {TRADE} x UNION SELECT DISTINCT dst, src FROM {TRADE} y), r(id, low) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.low FROM r JOIN e ON r.id = e.src AND r.low < e.dst AND r.low IN (SELECT min(src) FROM e)) SELECT id, min(low) AS component FROM r GROUP BY id")
def g_components_trade(spark: SparkSession, d: str) -> DataFrame:
    edges = trade_graph(spark, d)
    return graph.connected_components(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)


RING = "(SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 5 = 0)"


def ring(spark: SparkSession, d: str) -> DataFrame:
    """A circle of the nations with a chord from every fifth: circles, several shortest paths, no end."""
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    a = n.withColumn("dst", (F.col("src") + 1) % 25)
    return a.unionByName(n.where("src % 5 = 0").withColumn("dst", (F.col("src") + 5) % 25))


FAR = f"e AS MATERIALIZED (SELECT src, dst FROM {RING} x UNION SELECT dst, src FROM {RING} y), w(a, b, h) AS (SELECT DISTINCT src, src, 0 FROM e UNION SELECT w.a, e.dst, h + 1 FROM w JOIN e ON w.b = e.src WHERE h < 13), d AS MATERIALIZED (SELECT a, b, min(h) AS h FROM w GROUP BY a, b)"


@query(f"WITH RECURSIVE {FAR} SELECT a AS id, round(count(*) FILTER (WHERE h > 0) / sum(h), 9) AS closeness FROM d GROUP BY a")
def g_closeness_ring(spark: SparkSession, d: str) -> DataFrame:
    edges = ring(spark, d)
    return graph.closeness(edges.select(F.col("src").alias("id")).distinct(), edges).withColumn("closeness", F.round("closeness", 9))


@query(f"""WITH RECURSIVE {FAR}, p(a, b, h, n) AS (SELECT DISTINCT src, src, 0, CAST(1 AS DOUBLE) FROM e UNION ALL SELECT x.a, x.b, x.h, sum(x.n) FROM (SELECT p.a, e.dst AS b, p.h + 1 AS h, p.n FROM p JOIN e ON p.b = e.src JOIN d ON d.a = p.a AND d.b = e.dst AND d.h = p.h + 1) x GROUP BY x.a, x.b, x.h)
SELECT v.a AS id, round(sum(x.n * y.n / z.n) / 2, 6) AS betweenness FROM (SELECT DISTINCT a FROM d) v JOIN p x ON x.b = v.a AND x.a <> v.a JOIN p y ON y.a = v.a AND y.b <> v.a AND y.b <> x.a JOIN p z ON z.a = x.a AND z.b = y.b AND z.h = x.h + y.h GROUP BY v.a""")
def g_betweenness_ring(spark: SparkSession, d: str) -> DataFrame:
    edges = ring(spark, d)
    return graph.betweenness(edges.select(F.col("src").alias("id")).distinct(), edges).select("id", F.round("betweenness", 6).alias("betweenness"))


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS k FROM {RING} x),
r(i, id, rank) AS (SELECT 0, n_nationkey, 1.0::DOUBLE / 25 FROM nation UNION ALL SELECT x.i, x.id, 0.15 / 25 + 0.85 * sum(x.part) FROM (SELECT r.i + 1 AS i, o.dst AS id, r.rank / o.k AS part FROM r JOIN o ON o.src = r.id WHERE r.i < 20) x GROUP BY x.i, x.id)
SELECT id, round(rank, 9) AS rank FROM r WHERE i = 20""")
def g_pagerank_ring(spark: SparkSession, d: str) -> DataFrame:
    """Twenty rounds, as surveyed; every node has edges in and out."""
    edges = ring(spark, d)
    return graph.pagerank(edges.select(F.col("src").alias("id")).distinct(), edges, iterations=20, tolerance=0.0).select("id", F.round("rank", 9).alias("rank"))


# features, series models, rules


@query("SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS code, (dense_rank() OVER (ORDER BY c_mktsegment) - 1) & 1 AS bit0, ((dense_rank() OVER (ORDER BY c_mktsegment) - 1) >> 2) & 1 AS bit2, round(avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS mean FROM customer")
def encoders(spark: SparkSession, d: str) -> DataFrame:
    c = features.label_encode(load(spark, d, "customer"), "c_mktsegment", "code")
    c = features.target_encode(features.binary_encode(c, "c_mktsegment", 3), "c_mktsegment", "c_acctbal")
    return c.select("c_custkey", "code", F.col("c_mktsegment_bit0").alias("bit0"), F.col("c_mktsegment_bit2").alias("bit2"), F.round("c_mktsegment_target", 6).alias("mean"))


@query(f"SELECT series, CAST(last + k * {HOUR} AS BIGINT) AS t_ms, round(a * (last + k * {HOUR} - m) + v, 4) AS forecast FROM (SELECT series, max(t_ms) AS last, avg(t_ms) AS m, avg(value) AS v, regr_slope(value, t_ms - 1704067200000) AS a FROM {S} s GROUP BY series) f, range(1, 4) t(k)")
def ts_forecast(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("t_ms", F.col("t_ms") - 1704067200000)
    got = features.forecast(s, ["series"], "t_ms", "value", HOUR, 3)
    return got.select("series", (F.col("t_ms") + 1704067200000).alias("t_ms"), F.round("forecast", 4).alias("forecast"))


@query(f"""WITH f AS (SELECT series, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM (SELECT *, t_ms - 1704067200000 AS t FROM {S} s) x GROUP BY series),
r AS (SELECT event_id, series, value, a * t + b AS trend, t % {DAY} // {HOUR} AS phase FROM (SELECT *, (t_ms - 1704067200000) // {HOUR} * {HOUR} AS t, t_ms - 1704067200000 AS at FROM {S} s) x JOIN (SELECT series AS s2, regr_slope(value, t) AS a, regr_intercept(value, t) AS b FROM (SELECT *, (t_ms - 1704067200000) // {HOUR} * {HOUR} AS t FROM {S} s) y GROUP BY series) f ON series = s2)
SELECT event_id, round(trend, 5) AS trend, round(avg(value - trend) OVER (PARTITION BY series, phase), 5) AS seasonal FROM r""")
def ts_seasons(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d).withColumn("t", F.floor((F.col("t_ms") - 1704067200000) / HOUR) * HOUR)
    got = features.decompose(s, ["series"], "t", "value", DAY)
    return got.select("event_id", F.round("trend", 5).alias("trend"), F.round("seasonal", 5).alias("seasonal"))


@query(f"""WITH r AS (SELECT series, t_ms, sum(value) OVER {W} AS s, count(value) OVER {W} AS n, sum(value) OVER (PARTITION BY series) AS t, count(value) OVER (PARTITION BY series) AS m FROM {S} x),
g AS (SELECT series, t_ms, (t - s) / (m - n) - s / n AS shift, round(n * (m - n) / m * ((t - s) / (m - n) - s / n) * ((t - s) / (m - n) - s / n), 9) AS gain FROM r WHERE n < m)
SELECT series, t_ms, round(shift, 6) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY gain DESC, t_ms) AS k FROM g) y WHERE k = 1""")
def ts_change_points(spark: SparkSession, d: str) -> DataFrame:
    return features.change_points(samples(spark, d), ["series"], "t_ms", "value").withColumn("shift", F.round("shift", 6))


@query("SELECT p_partkey, 'LOCATED_IN' AS type, 'part' AS source, lower(split_part(p_name, ' ', 1)) AS target FROM part")
def entity_relations(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").withColumn("line", F.concat(F.lit("the part is located in "), F.lower(F.split("p_name", " ")[0])))
    return text.extract_relations(p, "p_partkey", "line").select("p_partkey", "type", "source", "target")


@query("SELECT doc_id, k AS text, instr(lower(text), k) - 1 AS position FROM documents, (VALUES ('er'), ('qua'), ('the ')) t(k) WHERE contains(lower(text), k)")
def entity_contained(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("er", "x"), ("qua", "x"), ("the ", "y")], "keyword string, type string")
    return text.extract_contained(load(spark, d, "documents"), "doc_id", "text", words).select("doc_id", "text", F.col("position").cast("long").alias("position"))


@query("SELECT c_custkey, 0 AS position, round(1 - CAST(levenshtein('customer#000000', lower(substr(c_name, 1, 15))) AS DOUBLE) / 15, 6) AS confidence FROM customer")
def entity_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    words = spark.createDataFrame([("Customer#000000", "name")], "keyword string, type string")
    found = text.extract_fuzzy(load(spark, d, "customer"), "c_custkey", "c_name", words)
    return found.select("c_custkey", "position", F.round("confidence", 6).alias("confidence"))


# tables in chunks, views, models, matrices


@query(f"SELECT series, count(*) AS n FROM {S} s WHERE t_ms BETWEEN 1704500000000 AND 1705500000000 GROUP BY series")
def hypertable(spark: SparkSession, d: str) -> DataFrame:
    """Written in chunks of a day, old chunks dropped, a range read."""
    path = f"{shared_folder(spark)}/hyper-{uuid.uuid4().hex}"
    files.write_hypertable(samples(spark, d), path, "t_ms", DAY, ["series"])
    files.drop_chunks(spark, path, 1704400000000, DAY)
    return files.read_hypertable(spark, path, "t_ms", DAY, 1704500000000, 1705500000000).groupBy("series").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST(t_ms // {DAY} * {DAY} AS BIGINT) AS chunk, count(*) AS rows FROM {S} s WHERE t_ms // {DAY} * {DAY} + {DAY} > 1704500000000 GROUP BY 1")
def hypertable_chunks(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/hyper-{uuid.uuid4().hex}"
    files.write_hypertable(samples(spark, d), path, "t_ms", DAY)
    files.drop_chunks(spark, path, 1704500000000, DAY)
    return files.chunks(spark, path)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def materialized_view(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.statements import execute

    load(spark, d, "orders").limit(0).createOrReplaceTempView("surface_orders")
    execute(spark, "CREATE OR REPLACE MATERIALIZED VIEW surface_status AS SELECT o_orderstatus, count(*) AS n FROM surface_orders GROUP BY o_orderstatus")
    load(spark, d, "orders").createOrReplaceTempView("surface_orders")
    execute(spark, "REFRESH MATERIALIZED VIEW surface_status")
    return execute(spark, "SELECT * FROM surface_status")


@query("SELECT count(*) AS rows FROM orders WHERE o_totalprice > 100000")
def explain_analyze(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.statements import execute

    load(spark, d, "orders").createOrReplaceTempView("surface_orders")
    return execute(spark, "EXPLAIN (ANALYZE, COSTS) SELECT * FROM surface_orders WHERE o_totalprice > 100000").select("rows")


@query("SELECT * FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) t(col_name)")
def describe(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.statements import execute

    load(spark, d, "nation").createOrReplaceTempView("surface_nation")
    return execute(spark, "DESCRIBE surface_nation").select("col_name")


@query("SELECT * FROM (VALUES ('guest', 't', 'select'), ('admin', 't', 'delete')) t(role, object, privilege)")
def privileges(spark: SparkSession, d: str) -> DataFrame:
    p = transactions.Privileges()
    s = Session(spark, {}, p)
    for statement in ("GRANT SELECT, INSERT ON t TO guest", "GRANT DELETE ON TABLE t TO admin", "REVOKE INSERT ON t FROM guest"):
        s.execute(statement)
    return p.held(spark)


@query("SELECT * FROM (VALUES (1, 'b', 20), (3, 'c', NULL)) t(id, name, age)")
def cql_batch(spark: SparkSession, d: str) -> DataFrame:
    from tessera.plans.cql import Keyspace

    k = Keyspace(spark, {})
    k.execute("CREATE TABLE people (id int PRIMARY KEY, name text, tags set<text>)")
    k.execute("BEGIN BATCH INSERT INTO people (id, name) VALUES (1, 'a'); INSERT INTO people (id, name) VALUES (1, 'b'); INSERT INTO people (id, name) VALUES (2, 'x'); INSERT INTO people (id, name) VALUES (3, 'c'); DELETE FROM people WHERE id = 2; APPLY BATCH")
    k.execute("ALTER TABLE people ADD age int")
    k.execute("UPDATE people SET age = 20 WHERE id = 1")
    return k.execute("SELECT id, name, age FROM people")


@query(f"SELECT series, CAST(t_ms // {DAY} * {DAY} AS BIGINT) AS bucket, max(value) AS max FROM {S} s WHERE t_ms BETWEEN 1704500000000 AND 1705500000000 AND value > 10 GROUP BY 1, 2 ORDER BY bucket DESC, series LIMIT 6 OFFSET 2")
def mm_range_builder(spark: SparkSession, d: str) -> DataFrame:
    text_ = "SELECT * FROM metrics RANGE 1704500000000 TO 1705500000000 WHERE value > 10 BY series BUCKET 1d max value ORDER DESC LIMIT 6 OFFSET 2"
    return multimodel.Engine(spark, {"metrics": samples(spark, d)}).query(text_)


@query("SELECT n_nationkey FROM nation")
def mm_timeout(spark: SparkSession, d: str) -> DataFrame:
    e = multimodel.Engine(spark, {"nation": load(spark, d, "nation")})
    return spark.createDataFrame(e.rows("SELECT n_nationkey FROM nation TIMEOUT 10m"))


@query(f"SELECT vec_id, round({COSINE}, 6) AS score FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 5")
def mm_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """An index search that probes all lists: as exact as the scan."""
    e = load(spark, d, "embeddings")
    m = multimodel.Engine(spark, {"docs": e})
    m.query("CREATE INDEX i ON docs USING ivfflat (embedding vector_cosine_ops) WITH (lists = 8)")
    first = e.where("vec_id = 0").select("embedding").first()[0]
    return m.query(f"NEAREST 5 TO [{', '.join(map(str, first))}] FROM docs BY cosine PROBES 1000").select("vec_id", F.round("score", 6).alias("score"))


@query("SELECT c_custkey, round(regr_intercept(c_acctbal, c_nationkey) OVER () + regr_slope(c_acctbal, c_nationkey) OVER () * c_nationkey, 3) AS prediction FROM customer")
def mm_model(spark: SparkSession, d: str) -> DataFrame:
    m = multimodel.Engine(spark, {"customer": load(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")})
    m.query("TRAIN MODEL balance USING linear_regression FEATURES c_nationkey TARGET c_acctbal FROM customer")
    out = m.query("PREDICT balance FROM customer").select("c_custkey", F.round("prediction", 3).alias("prediction"))
    m.query("DROP MODEL balance")
    return out


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS n, CAST(floor(avg(2 * value + 1) + 1e-6) AS DOUBLE) AS prediction FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def stream_inference(spark: SparkSession, d: str) -> DataFrame:
    """The batch twin of scoring a stream by windows."""
    from tessera.operators import ml

    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(10)], "value double, y double")
    ml.train("surface_line", "linear_regression", line, ["value"], "y")
    out = ml.score_stream("surface_line", load(spark, d, "events").where("value is not null"), "ts", "1 day", ["event_type"])
    return out.select("event_type", "window_start", "n", F.floor(F.col("prediction") + 1e-6).cast("double").alias("prediction"))


@query("SELECT n_nationkey, CAST([[n_nationkey + 6, n_nationkey * 2 + 8]] AS DOUBLE[][]) AS product, CAST([[n_nationkey], [2]] AS DOUBLE[][]) AS turned, CAST([[n_nationkey * 0.5, 1]] AS DOUBLE[][]) AS half FROM nation")
def matrices(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions import matrices as m

    row = lambda *v: F.array(*[(x if not isinstance(x, (int, float)) else F.lit(x)).cast("double") for x in v])
    a, b = F.array(row(F.col("n_nationkey"), 2)), F.array(row(1, 2), row(3, 4))
    return load(spark, d, "nation").select("n_nationkey", m.matmul(a, b).alias("product"), m.transpose(a).alias("turned"), m.scale(a, 0.5).alias("half"))


@query(f"SELECT count(DISTINCT id) AS nodes, 16 AS size FROM (SELECT src AS id FROM {RING} x UNION SELECT dst FROM {RING} y) z")
def g_embeddings(spark: SparkSession, d: str) -> DataFrame:
    edges = ring(spark, d)
    found = graph.node_embeddings(edges.select(F.col("src").alias("id")).distinct(), edges, 16)
    return found.agg(F.count_distinct("id").alias("nodes"), F.max(F.size("embedding")).alias("size"))


@query(f"WITH e AS (SELECT src, dst FROM {RING} x UNION SELECT dst, src FROM {RING} y) SELECT n_nationkey AS id, round((n_nationkey + (SELECT avg(dst) FROM e WHERE src = n_nationkey)) / 2, 9) AS feature FROM nation")
def g_neighbourhoods(spark: SparkSession, d: str) -> DataFrame:
    edges = ring(spark, d)
    nodes = load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.array(F.col("n_nationkey").cast("double")).alias("features"))
    return graph.neighbourhood_means(nodes, edges, rounds_=1).select("id", F.round(F.col("features")[0], 9).alias("feature"))
