"""Sessions, triggers, transactions, privileges, indexes, knowledge bases and sinks beyond what the registered queries show."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.functions import user, vector_index, vectors
from tessera.operators import features, ml, text
from tessera.operators.triggers import Database, Trigger
from tessera.plans import aql
from tessera.plans.commands import Store
from tessera.plans.graphrag import KnowledgeBases
from tessera.plans.session import Session
from tessera.plans.transactions import Conflict, Privileges, Transaction, deadlocked
from tessera.sources.versions import VersionedTable
from tessera.streaming import changes


@pytest.fixture
def table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.write(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string"))
    return t


def test_statements_return_what_they_touch(spark, table):
    s = Session(spark, {"t": table})
    assert rows(s.execute("INSERT INTO t (v, k) VALUES ('x', 9), ('y', 10) RETURNING k + 1 AS n, v")) == [(10, "x"), (11, "y")]
    assert rows(s.execute("UPDATE t SET v = concat(v, '!'), k = k * 10 WHERE k > 8 RETURNING *")) == [(100, "y!"), (90, "x!")]
    assert rows(s.execute("INSERT INTO t VALUES (1, 'new'), (50, 'z') ON CONFLICT (k) DO NOTHING RETURNING k")) == [(50,)]
    assert rows(s.execute("INSERT INTO t SELECT k, upper(v) FROM t WHERE k < 3 ON CONFLICT (k) DO UPDATE SET v = EXCLUDED.v RETURNING k, v")) == [(1, "A"), (2, "B")]
    assert rows(s.execute("DELETE FROM t WHERE v IS NULL RETURNING k")) == [(3,)]
    assert rows(s.execute("SELECT a.k, b.v FROM t a JOIN t AS b ON a.k = b.k WHERE a.k < 60")) == [(1, "A"), (2, "B"), (50, "z")]
    s.execute("TRUNCATE t")
    assert table.read().count() == 0 and table.read(snapshot=1).count() == 3


def test_transactions(spark, table):
    a, b = (Transaction({"t": table}, "serializable") for _ in range(2))
    a.write("t", a.read("t").where("k <> 1"))
    assert b.read("t").count() == 3
    b.write("t", b.read("t").where("k <> 2"))
    assert a.commit() == {"t": 2}
    with pytest.raises(Conflict):
        b.commit()
    with pytest.raises(RuntimeError):
        b.read("t")
    repeatable, committed = Transaction({"t": table}, "repeatable read"), Transaction({"t": table})
    assert repeatable.read("t").count() == committed.read("t").count() == 2
    table.write(table.read().limit(0))
    assert repeatable.read("t").count() == 2 and committed.read("t").count() == 0
    s = Transaction({"t": table})
    s.write("t", spark.createDataFrame([(1, "x")], "k int, v string"))
    s.savepoint("one")
    s.write("t", s.read("t").limit(0))
    s.savepoint("two")
    s.rollback("one")
    assert s.read("t").count() == 1
    with pytest.raises(ValueError):
        s.rollback("two")
    s.rollback()
    assert table.read().count() == 0
    waits = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (1, 9), (7, 7)], "waiter int, holder int")
    assert rows(deadlocked(waits)) == [(1,), (2,), (3,), (7,)]


def test_privileges(spark, table):
    s = Session(spark, {"t": table}, Privileges(), "admin")
    s.execute("GRANT ALL ON t TO admin")
    s.execute("GRANT SELECT, INSERT ON TABLE t TO guest")
    s.execute("SET ROLE guest")
    assert s.execute("SELECT * FROM t").count() == 3 and s.execute("INSERT INTO t VALUES (4, 'd') RETURNING k").count() == 1
    for statement in ("DELETE FROM t", "UPDATE t SET v = 'x'", "TRUNCATE t", "INSERT INTO t VALUES (4, 'e') ON CONFLICT (k) DO UPDATE SET v = EXCLUDED.v"):
        with pytest.raises(PermissionError):
            s.execute(statement)
    s.execute("REVOKE SELECT ON t FROM guest")
    with pytest.raises(PermissionError):
        s.execute("SELECT count(*) FROM t")
    p = Privileges()
    p.grant("select", "a", "r")
    spark.range(3).createOrReplaceTempView("a")
    assert p.read_as("r", spark, "WITH b AS (SELECT * FROM a) SELECT * FROM b").count() == 3
    with pytest.raises(PermissionError):
        p.read_as("r", spark, "SELECT * FROM a x JOIN other y ON x.id = y.id")
    assert p.held(spark).count() == 1
    with pytest.raises(ValueError):
        p.grant("fly", "a", "r")


def test_triggers(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id int, v double")
    log = spark.createDataFrame([], "id int, what string")
    db, seen = Database({"t": t, "log": log, "log2": log}), []
    db.create(Trigger("cap", "t", "insert", "before", when="new.v > 100", assign={"v": "100.0D"}))
    db.create(Trigger("refuse", "t", "insert", "before", when="new.v < 0", skip=True))
    db.create(Trigger("note", "t", "insert", into="log", values={"id": "new.id", "what": "concat('in ', new.v)"}))
    db.create(Trigger("more", "log", "insert", into="log2", values={"id": "new.id", "what": "new.what"}))
    db.create(Trigger("keep", "t", "delete", "before", when="old.id = 1", skip=True))
    db.create(Trigger("each", "t", "delete", "after", "statement", action=lambda d: seen.append(d.tables["t"].count())))
    db.insert("t", spark.createDataFrame([(3, 500.0), (4, -1.0), (5, 7.0)], "id int, v double"))
    assert rows(db.tables["t"]) == [(1, 10.0), (2, 20.0), (3, 100.0), (5, 7.0)]
    assert rows(db.tables["log"]) == rows(db.tables["log2"]) == [(3, "in 100.0"), (5, "in 7.0")]
    db.delete("t", F.col("id") < 5)
    assert rows(db.tables["t"]) == [(1, 10.0), (5, 7.0)] and seen == [2]
    assert db.drop("keep") and not db.drop("keep")
    db.truncate("t")
    assert db.tables["t"].count() == 0
    loop = Database({"t": t}, max_depth=3)
    loop.create(Trigger("again", "t", "insert", into="t", values={"id": "new.id + 1", "v": "new.v"}))
    with pytest.raises(RecursionError):
        loop.insert("t", t.limit(1))


def test_vector_index(spark):
    rng = random.Random(4)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(20)]
    data = [(k, [c + rng.gauss(0, 0.05) for c in centres[k % 20]], "m") for k in range(2000)] + [(5000, None, "m"), (5001, [0.0] * 8, "z")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, tag string").repartition(5)
    index = vector_index.build(df, lists=20)
    assert spark.read.parquet(index.path).count() == 2001
    q = df.where("vec_id % 100 = 0 and embedding is not null and tag = 'm'")
    exact = vectors.knn_join(df, q, 10)
    assert vector_index.recall(vector_index.search_many(df, index, q, 10, 6), exact) >= 0.9
    assert vector_index.recall(vector_index.search_many(df, index, q, 10, len(index.centroids)), exact) == 1.0
    n = vector_index.probes_for(df, index, q, 10)
    assert vector_index.recall(vector_index.search_many(df, index, q, 10, n), exact) >= 0.9
    one = vector_index.search(df, index, data[7][1], 3, 4).collect()
    assert one[0]["vec_id"] == 7 and len(one) == 3 and "tag" in one[0].asDict()


def test_commands(spark):
    s = Store(spark)
    s.run("FT.CREATE i ON HASH SCHEMA v VECTOR FLAT 6 TYPE FLOAT32 DIM 2 DISTANCE_METRIC L2")
    s.run("FT.ADD i a 1,0 kind x")
    s.run("FT.ADD i b 0,1 kind y")
    s.run("FT.ADD i c 0.9,0.1 kind x")
    with pytest.raises(ValueError):
        s.run("FT.ADD i d 1,2,3")
    assert [r["id"] for r in s.run("FT.SEARCH i '*=>[KNN 3 @v $q]' PARAMS 2 q 1,0").collect()] == ["a", "c", "b"]
    assert [r["id"] for r in s.run("FT.SEARCH i '@kind:{y}=>[KNN 3 @v $q]' PARAMS 2 q 1,0 LIMIT 0 1").collect()] == ["b"]
    assert s.run("FT.INFO i").first().asDict() == {"vectors": 3, "dims": 2, "metric": "l2", "dim": 2} and s.run("VECTOR.COUNT i") == 3
    assert rows(s.run("VECTOR.LIST i")) == [("a",), ("b",), ("c",)] and s.run("FT.DROPINDEX i") == 1
    s.run("GRAPH.QUERY g \"CREATE (a {id: 1, name: 'x'})\"")
    s.run("GRAPH.QUERY g \"CREATE (a {id: 2, name: 'y'})\"")
    assert rows(s.run("GRAPH.QUERY g 'MATCH (n) RETURN n.id AS id'")) == [(1,), (2,)]
    assert "Scan" in s.run("GRAPH.EXPLAIN g 'MATCH (n) RETURN n.id AS id'") and s.run("GRAPH.PROFILE g 'MATCH (n) RETURN n.id AS id'").first()["rows"] == 2
    assert s.run("GRAPH.CONFIG SET QUERY_TIMEOUT 60000") == "OK" and rows(s.run("GRAPH.CONFIG GET QUERY_TIMEOUT")) == [("QUERY_TIMEOUT", "60000")]
    assert s.run("GRAPH.SLOWLOG g").count() == 3 and rows(s.run("GRAPH.LIST")) == [("g",)] and s.run("GRAPH.DELETE g") == "OK" and s.run("GRAPH.LIST").count() == 0
    s.run("GEO.POLYGON.ADD zones one 'POLYGON((0 0,4 0,4 4,0 4,0 0))'")
    s.run("GEO.LINESTRING.ADD zones two 'LINESTRING(9 9,10 10)'")
    assert rows(s.run("GEO.INTERSECTS zones 'POINT(1 1)'")) == [("one",)] and s.run("GEO.GEOMETRY.GET zones two").count() == 1
    s.run("GEO.FENCE.ADD home 'POLYGON((0 0,4 0,4 4,0 4,0 0))' ENTER")
    assert rows(s.run("GEO.FENCE.CHECK me 1 1")) == [("home",)] and s.run("GEO.FENCE.CHECK me 9 1").count() == 0
    for k in range(300):
        s.run(f"TS.ADD t {k} {k}.5")
    s.compact()
    assert s.run("TS.INFO t").first()["samples"] == 300


def test_knowledge_bases(spark):
    kb = KnowledgeBases(spark)
    assert tuple(kb.build("k", "1", "Ada works for Acme")) and kb.build("k", "2", "Acme is located in Oslo with Bob").first().asDict() == {"doc_id": "2", "entities": 3, "relationships": 3}
    assert kb.execute("SELECT * FROM GRAPHRAG_STATS('k')").first().asDict() == {"documents": 2, "entities": 4, "types": 1, "relationships": 4, "queries": 0}
    path = kb.execute("SELECT * FROM GRAPHRAG_REASON('k', 'Ada', 'Oslo', 3)").first()
    assert path["entities"] == ["Ada", "Acme", "Oslo"] and path["hops"] == 2
    assert rows(kb.relations("k").select("source", "target", "type")) == [("Ada", "Acme", "WORKS_FOR"), ("Acme", "Oslo", "LOCATED_IN")] or kb.relations("k").count() == 2
    assert [r["doc_id"] for r in kb.execute("SELECT * FROM GRAPHRAG_QUERY('k', 'who is Ada?', 1, 5)").collect()] == ["1", "2"]
    assert rows(kb.execute("SELECT * FROM GRAPHRAG_SIMILAR('k', 'Oslo', 1)").select("text")) == [("Ada",)]
    assert kb.execute("SELECT * FROM GRAPHRAG_EXTRACT('k', '3', 'It''s Eve')").count() == 2
    with pytest.raises(ValueError):
        kb.execute("SELECT * FROM GRAPHRAG_NOTHING('k')")
    got = aql.run(spark, "FOR a IN GRAPHRAG_ENTITIES('k') FOR b IN others FILTER a.text == b.name RETURN {n: b.n}", {"others": spark.createDataFrame([("Ada", 1), ("Zoe", 2)], "name string, n int")}, kb)
    assert rows(got) == [(1,)] and "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_deduplication_misses_none(spark):
    rng = random.Random(5)
    base = ["kathryn", "cathryn", "jonathan smith", "jonathon smith", "acme corp", "acme corporation", "a", "b", "ab", "Straße", "strasse", "", "ekathryn"]
    base += ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    data = sorted({(rng.choice("xy"), t, rng.choice([0.5, 0.7, 0.9])) for t in base})
    best = {}
    for kind, t, c in data:
        best[kind, t] = max(best.get((kind, t), 0), c)
    near = lambda a, b: 1 - text.edit_distance(a.lower(), b.lower()) / max(len(a), len(b), 1) >= 0.8 - 1e-9
    want = sorted((k, t, c) for (k, t), c in best.items() if not t or not any(k == k2 and t2 and t2 != t and (c2 > c or (c2 == c and t2 < t)) and near(t, t2) for (k2, t2), c2 in best.items()))
    assert sorted(tuple(r) for r in text.dedupe_fuzzy(spark.createDataFrame(data, "type string, text string, confidence double")).collect()) == want


def test_fuzzy_keywords_equal_all_windows():
    rng = random.Random(6)
    for _ in range(300):
        body, word = ("".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(2))
        word = word[: rng.randrange(1, 12)]
        size = max(len(word), 3)
        found = sorted(((1 - text.edit_distance(word, body[i : i + size]) / size, i) for i in range(len(body) - size + 1)), key=lambda f: (-f[0], f[1]))
        want = []
        for score, i in found:
            if score >= 0.8 - 1e-9 and all(i + size <= j or j + size <= i for j, *_ in want):
                want.append((i, body[i : i + size], score))
        assert text.fuzzy_matches(body, word) == want


def test_features_and_models(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 7), 2.0 * i + 1, i % 2) for i in range(60)], "a double, b double, y double, c int")
    assert features.select_features(df, ["a", "b"], "y", 1) == ["a"]
    assert rows(features.robust_scale(df, "a").where("a = 29").select("scaled"))[0][0] == 0.0
    line = features.forecast(df.withColumn("t", F.col("a").cast("long")), [], "t", "y", 1, 2)
    assert [(a, round(b, 6)) for a, b in rows(line)] == [(60, 121.0), (61, 123.0)]
    steps = spark.createDataFrame([("s", t, 1.0 if t < 30 else 5.0) for t in range(50)], "k string, t long, v double")
    assert rows(features.change_points(steps, ["k"], "t", "v", 7)) == [("s", 29, 4.0)]
    e = features.embed_text(F.lit("To be, or not to be"), 32)
    assert abs(sum(v * v for v in spark.range(1).select(e).first()[0]) - 1) < 1e-9
    ml.train("line", "linear_regression", df, ["a"], "y")
    before = rows(ml.predict("line", df.limit(3)).select("a", F.round("prediction", 6)))
    ml.save("line", str(tmp_path / "m"))
    ml.drop_model("line")
    assert ml.load(str(tmp_path / "m"), "again") == "again" and rows(ml.predict("again", df.limit(3)).select("a", F.round("prediction", 6))) == before
    assert ml.model_info("again")["kind"] == "linear_regression" and ml.drop_model("again")
    ml.train("net", "neural_network", df, ["a", "b"], "c", layers=[2, 4, 2], maxIter=5)
    assert ml.predict("net", df).select("prediction").count() == 60 and ml.drop_model("net")


def test_user_functions(spark):
    user.register_scalar(spark, "plus_two", lambda a: a + 2, "long")
    user.register_scalar(spark, "times", lambda a, b: a * b, "long", 2)
    assert rows(spark.sql("SELECT plus_two(id) a, times(id, id) b FROM range(3)")) == [(2, 0), (3, 1), (4, 4)]


def test_webhook(spark):
    got = []

    class Sink(BaseHTTPRequestHandler):
        def do_POST(self):
            got.extend(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Sink)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k int, v string").repartition(2)
    changes.post_rows(changes.to_topic(df, "t", "k"), f"http://127.0.0.1:{server.server_port}/", batch=2)
    server.shutdown()
    assert sorted((g["key"], g["value"]["v"]) for g in got) == [(f"t:{k}", f"v{k}") for k in range(7)]
