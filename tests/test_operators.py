"""Operators on small literal fixtures: nulls, ties, empty inputs, known results."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tessera.functions import json_ops, keyed, scalar, spatial, vectors
from tessera.operators import aggregates, dml, graph, ml, relational, text
from tessera.operators import timeseries as ts
from tessera.streaming import changes, windows


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_limit_with_ties_and_nulls(spark):
    df = frame(spark, [(1, 5), (2, 5), (3, 7), (4, None), (5, None)], "id int, v int")
    assert rows(relational.limit_with_ties(df, 2, [("v", True)]).select("id")) == [(1,), (2,), (3,)]
    assert rows(relational.limit_with_ties(df, 4, [("v", False)]).select("id")) == [(1,), (2,), (3,), (4,), (5,)]
    assert rows(relational.limit_with_ties(df.limit(0), 4, [("v", False)])) == []


def test_asof_and_interval(spark):
    a = frame(spark, [("k", 5), ("k", 1), ("z", 9), (None, 4)], "key string, t long")
    b = frame(spark, [("k", 2, 20.0), ("k", 5, 50.0), (None, 1, 1.0)], "key string, t long, v double")
    got = relational.asof_join(a, b, ["key"], "t", "t", "v")
    assert {(r["key"], r["t"]): r["asof_v"] for r in got.collect() if r["key"]} == {("k", 5): 50.0, ("k", 1): None, ("z", 9): None}
    strict = relational.asof_join(a, b, ["key"], "t", "t", "v", strict=True)
    assert {(r["key"], r["t"]): r["asof_v"] for r in strict.collect() if r["key"]}["k", 5] == 20.0
    got = relational.interval_join(a, b.select("key", F.col("t").alias("s")), ["key"], "t", "s", 3)
    assert rows(got.select("key", "t", "s")) == [("k", 5, 5)]


def test_percentile_and_histogram(spark):
    df = frame(spark, [("a", float(x)) for x in range(11)] + [("b", 3.0), ("b", None)], "g string, v double")
    assert rows(aggregates.percentile_nearest(df, ["g"], "v", 90)) == [("a", 9.0), ("b", 3.0)]
    assert rows(aggregates.percentile_nearest(df, [], "v", 50))[0][0] == 5.0
    assert rows(aggregates.histogram(df.where("g = 'b'"), "v", 4).select("upper_bound", "n")) == [(3.0, 1)]
    assert sum(r["n"] for r in aggregates.histogram(df, "v", 4).collect()) == 12


def test_dml(spark):
    t = frame(spark, [(1, "a"), (2, "b"), (3, None)], "id int, v string")
    new = frame(spark, [(2, "B"), (4, "D")], "id int, v string")
    assert rows(dml.upsert_do_nothing(t, new, ["id"])) == [(1, "a"), (2, "b"), (3, None), (4, "D")]
    assert rows(dml.upsert_do_update(t, new, ["id"], ["v"])) == [(1, "a"), (2, "B"), (3, None), (4, "D")]
    assert rows(dml.update(t, {"v": F.lit("x")}, F.col("v") == "a")) == [(1, "x"), (2, "b"), (3, None)]
    assert rows(dml.delete(t, F.col("v") == "a")) == [(2, "b"), (3, None)]
    assert rows(dml.delete_using(t, new, ["id"])) == [(1, "a"), (3, None)]
    assert rows(dml.truncate(t)) == []
    ops = dml.apply_operators(frame(spark, [(1, 10.0, [1])], "id int, n double, l array<int>"), {"n": ("/=", F.lit(4)), "l": ("append", F.lit(7))}, F.lit(True))
    assert rows(ops) == [(1, 2.5, [1, 7])]
    v = frame(spark, [("k", 1, 5, "old"), ("k", 5, None, "new"), ("j", 9, None, "later")], "key string, xmin int, xmax int, v string")
    assert rows(dml.mvcc_snapshot(v, ["key"], 4).select("v")) == [("old",)]
    assert rows(dml.mvcc_snapshot(v, ["key"], 9, active=[9]).select("v")) == [("new",)]


def test_masking(spark):
    df = frame(spark, [("secret1234",), (None,)], "s string")
    assert rows(dml.mask_column(df, "s", "partial")) == [("******1234",), (None,)]
    assert rows(dml.row_security(df, [])) == []


def test_time_series(spark):
    s = frame(spark, [("a", 1000, 10.0), ("a", 2000, 20.0), ("a", 3000, 15.0), ("a", 4000, 25.0), ("b", 1000, None)], "series string, t long, v double")
    got = ts.bucket_aggregate(s, ["series"], "t", "v", 2000, ["avg", "last", "range", "std.p"])
    assert rows(got.where("bucket = 2000").select("avg", "last", "range", "std_p")) == [(17.5, 15.0, 5.0, 2.5)]
    assert rows(ts.exponential_average(s, ["series"], "t", "v", 0.5).select("t", "ema")) == [(1000, 10.0), (2000, 15.0), (3000, 15.0), (4000, 20.0)]
    assert rows(ts.rate(s, ["series"], "t", "v").where("series = 'a'").select("t", "rate"))[:3] == [(1000, None), (2000, 10.0), (3000, -5.0)]
    two = frame(spark, [("a", 1, 100.0, 1), ("a", 1, 200.0, 2)], "series string, t long, v double, n int")
    assert [ts.deduplicate(two, ["series"], "t", "v", p, "n").first()["v"] for p in ("last", "first", "sum", "max")] == [200.0, 100.0, 300.0, 200.0]
    with pytest.raises(Exception, match="duplicate sample"):
        ts.deduplicate(two, ["series"], "t", "v", "block", "n").collect()
    assert rows(ts.time_weighted_average(s.where("series = 'a'"), ["series"], "t", "v"))[0][1] == 15.0


def test_vectors(spark):
    v = frame(spark, [("doc1", [1.0, 0.0, 0.0]), ("doc2", [0.0, 1.0, 0.0]), ("doc3", [0.9, 0.1, 0.0]), ("zero", [0.0, 0.0, 0.0]), ("null", None)], "vec_id string, embedding array<float>")
    assert [r["vec_id"] for r in vectors.search(v, [1.0, 0.0, 0.0], 2).collect()] == ["doc1", "doc3"]
    e = F.col("embedding")
    zero = v.where("vec_id = 'zero'").select(vectors.cosine_similarity(e, F.array(*[F.lit(1.0)] * 3)), vectors.l2(e, F.array(F.lit(1.0))))
    assert rows(zero) == [(0.0, None)]
    n = frame(spark, [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["score"] for r in vectors.knn_join(n, n.where("vec_id < 3"), 4, "l2").collect()}
    for q in range(3):
        ref = sorted((((i % 7 - q % 7) ** 2 + (i % 5 - q % 5) ** 2) ** 0.5 for i in range(60) if i != q))[:4]
        assert [round(got[q, r + 1], 9) for r in range(4)] == [round(1 / (1 + d), 9) for d in ref]
    assert vectors.knn_join(n, n.limit(0), 4).count() == 0


def test_graph(spark):
    nodes = frame(spark, [(i,) for i in range(1, 7)], "id long")
    edges = frame(spark, [(1, 2), (1, 3), (2, 3), (3, 4), (5, 5)], "src long, dst long")
    assert rows(graph.triangles(nodes, edges)) == [(1, 1), (2, 1), (3, 1), (4, 0), (5, 0), (6, 0)]
    assert rows(graph.connected_components(nodes, edges)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)]
    assert rows(graph.communities(nodes, edges)) == [(1, 4)]
    assert rows(graph.bfs(nodes.where("id = 1"), edges, 5).select("node", "depth")) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert rows(graph.shortest_path(4, edges)) == [(1, 2.0), (2, 2.0), (3, 1.0), (4, 0.0)]
    assert rows(graph.betweenness(nodes, edges)) == [(1, 0.0), (2, 0.0), (3, 2.0), (4, 0.0), (5, 0.0), (6, 0.0)]
    assert dict(rows(graph.closeness(nodes, edges)))[3] == 1.0
    assert graph.depth_first(1, edges) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    ranks = dict(rows(graph.pagerank(nodes, edges)))
    assert ranks[4] > ranks[1] and sum(ranks.values()) < 1
    chain = frame(spark, [(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert graph.variable_length(nodes.where("id = 1"), chain, 1, 3).count() == 3
    left, e = graph.detach_delete(nodes, edges, nodes.where("id = 3"))
    assert left.count() == 5 and rows(e) == [(1, 2), (5, 5)]


def test_long_chain_components(spark):
    n = 60
    edges = frame(spark, [(i, i + 1) for i in range(n)], "src long, dst long")
    nodes = frame(spark, [(i,) for i in range(n + 1)], "id long")
    assert {c for _, c in rows(graph.connected_components(nodes, edges))} == {0}


def test_spatial(spark):
    one = spark.range(1)
    hole, outer = spatial.ring([(2, 2), (4, 2), (4, 4), (2, 4)]), spatial.ring([(0, 0), (10, 0), (10, 10), (0, 10)])
    p = lambda x, y: spatial.in_polygon(F.lit(x), F.lit(y), outer, [hole])
    assert tuple(one.select(p(1.0, 1.0), p(3.0, 3.0), p(11.0, 1.0)).first()) == (True, False, False)
    m = spatial.to_mercator(F.lit(13.4), F.lit(52.5))
    back = spatial.from_mercator(m["x"], m["y"])
    assert [round(v, 9) for v in one.select(back["x"], back["y"]).first()] == [13.4, 52.5]
    assert one.select(spatial.parse_points(F.lit("LINESTRING(0 1, -2.5 3e1)"))).first()[0] == [(0.0, 1.0), (-2.5, 30.0)]
    assert tuple(one.select(spatial.centroid(outer)).first()[0]) == (5.0, 5.0)
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 1.0, 1.0), (1, 1.0, 0.2), (2, 5.0, 5.0)], "g int, x double, y double")
    assert {r["g"]: len(r["hull"]) for r in spatial.group_hull(df, ["g"], "x", "y").collect()} == {1: 3, 2: 1}


def test_scalars(spark):
    one = spark.range(1)
    s = F.lit("hello")
    assert tuple(one.select(scalar.substring(s, -3, 2), scalar.substring(s, 2), scalar.substring(s, 9)).first()) == ("he", "ello", "")
    assert tuple(one.select(scalar.int_div(F.lit(-7), F.lit(2)), scalar.int_div(F.lit(7), F.lit(0))).first()) == (-3, None)
    assert tuple(one.select(scalar.similar_to(s, "h(e|a)%"), scalar.similar_to(s, "h_"), scalar.similar_to(F.lit("a.c"), "a.c")).first()) == (True, False, True)
    assert tuple(one.select(scalar.similarity(F.lit(""), F.lit("")), scalar.element(F.array(F.lit(1)), 2)).first()) == (1.0, None)


def test_json(spark):
    d = spark.createDataFrame([('{"a": {"b": [1, 2]}, "c": "x"}',), ("nonsense",), (None,)], "j string")
    j = F.col("j")
    assert [r[0] for r in d.select(json_ops.contains(j, F.lit('{"a": {"b": [2]}}'))).collect()] == [True, False, None]
    assert [r[0] for r in d.select(json_ops.path(j, "a.b[1]")).collect()] == ["2", None, None]
    assert [r[0] for r in d.select(json_ops.valid(j, {"type": "object", "required": ["z"]})).collect()] == [False, False, None]
    assert [r[0] for r in d.select(json_ops.kind(j, "a.b")).collect()] == ["array", None, None]


def test_keyed(spark):
    p = spark.createDataFrame([("k", i, i) for i in range(5)], "key string, v int, at int")
    items = keyed.lists(p, "key", "v", "at", left=True).first()["items"]
    assert items == [4, 3, 2, 1, 0]
    one = spark.createDataFrame([(items,)], "l array<int>")
    assert tuple(one.select(keyed.lrange(F.col("l"), -2, -1), keyed.lrange(F.col("l"), 3, 1), keyed.lindex(F.col("l"), -1), keyed.lset(F.col("l"), 0, F.lit(9))).first()) == ([1, 0], [], 0, [9, 3, 2, 1, 0])


def test_entities(spark):
    docs = spark.createDataFrame([(1, "Mail a.b@c.de and call 12345"), (2, None), (3, "")], "id int, text string")
    found = text.extract_patterns(docs, "id", "text", {"email": r"[\w.]+@[\w.]+", "number": r"\d+"})
    assert rows(found.select("id", "type", "text")) == [(1, "email", "a.b@c.de"), (1, "number", "12345")]
    e = spark.createDataFrame([("p", "Jonathan", 0.9), ("p", "Jonathon", 0.8), ("p", "Mary", 0.8), ("q", "Jonathon", 0.8)], "type string, text string, confidence double")
    assert rows(text.dedupe_fuzzy(e).select("type", "text")) == [("p", "Jonathan"), ("p", "Mary"), ("q", "Jonathon")]


def test_ml(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1, 1.0) for x in range(1, 6)], "x double, y double, c double")
    r = ml.linear_regression(df, "y", "x").first()
    assert (round(r["slope"], 9), round(r["intercept"], 9)) == (2.0, 1.0)
    assert [round(v, 9) for v in df.agg(ml.correlation(F.col("x"), F.col("y")), ml.correlation(F.col("x"), F.col("c"))).first()] == [1.0, 0.0]
    z = [q["zscore"] for q in ml.standardize(df, "x").collect()]
    assert abs(sum(z)) < 1e-9
    ml.train("m", "linear_regression", df, ["x"], "y")
    assert ml.evaluate("m", df)["rmse"] < 1e-6 and ml.list_models() == [("m", "linear_regression")] and ml.drop_model("m")


def test_streams_equal_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def collected(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.table(name))

    for name, f in {"tumble": lambda d: windows.tumbling(d, "ts", "6 hours", ["event_type"], "value", ["count", "max"]), "slide": lambda d: windows.sliding(d, "ts", "3 hours", "1 hour", [], "value", ["count"])}.items():
        assert collected(f(stream), name, "complete") == rows(f(e))
    counted = collected(windows.count_windows_stream(stream, "user_id", 5, "value"), "counted", "append")
    assert len(counted) == sum(n // 5 for _, n in rows(e.groupBy("user_id").count()))
    seen = []
    q = changes.on_batch(stream, lambda d: d.where("event_type = 'error'"), lambda d, n: seen.append(d.count()), str(tmp_path / "trigger"))
    q.awaitTermination()
    assert sum(seen) == e.where("event_type = 'error'").count()


def test_knowledge(spark):
    from tessera.operators import knowledge

    docs = spark.createDataFrame([(1, "a1 b2 c3"), (2, "a1 b2"), (3, "c3 d4"), (4, None), (5, "zz")], "id int, text string")
    entities, nodes, edges = knowledge.build_knowledge(docs, "id", "text", {"code": r"[a-z]\d"})
    assert tuple(knowledge.stats(nodes, edges).select("entities", "relationships").first()) == (4, 4)
    assert rows(knowledge.list_entities(nodes, "code").select("text", "documents")) == [("a1", 2), ("b2", 2), ("c3", 2), ("d4", 1)]
    assert [r["hops"] for r in knowledge.find_paths(nodes, edges, "a1", "d4").collect()] == [2]  # the longer one falls below 0.2
    assert rows(knowledge.find_similar(nodes, edges, "a1", 1).select("text")) == [("d4",)] or rows(knowledge.find_similar(nodes, edges, "a1", 1).select("text")) == [("b2",)]
    got = knowledge.rag_query(entities, nodes, edges, "id", ["D4"]).collect()
    assert [r["id"] for r in got][0] == 3 and {r["id"] for r in got} == {1, 3}


def test_dbscan_and_utm(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, 1.9, 0.0), (5, 9.0, 9.0), (6, 9.0, 9.0)], "id int, x double, y double")
    assert rows(spatial.dbscan(pts, 1.0, 3)) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, None), (6, None)]
    z = spark.range(1).select(spatial.to_utm(F.lit(9.0), F.lit(48.0)).alias("u")).select("u.*").first()
    assert (z["zone"], round(z["easting"], 3), round(z["northing"])) == (32, 500000.0, 5316300)


def test_movement_and_store(spark):
    m = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1000, 50.0, 0.0), ("a", 2000, 250.0, 0.0), ("a", 9000, 5000.0, 0.0)], "e string, t long, x double, y double")
    assert rows(changes.movement_alerts(m, "e", "t", "x", "y").select("t", "alert")) == [(2000, "speed"), (9000, "move")]
    store = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y")], "key string, version long, what string")
    new = spark.createDataFrame([("k", 1, "z"), ("j", 1, "w")], "key string, version long, what string")
    assert rows(changes.append_events(store, new, ["key"])) == [("j", 1, "w"), ("k", 1, "x"), ("k", 2, "y"), ("k", 3, "z")]
    assert [len(b) for b in changes.rows_in_batches(spark.range(7), 3)] == [3, 3, 1]


def test_geofence_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 6.0), ("a", 1.0), ("b", 1.0)], "e string, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("e string, x double").parquet(str(tmp_path / "in"))
    q = changes.geofence_stream(s, "e", F.col("x") > 3).writeStream.format("memory").queryName("fence").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("fence").collect()] == [("a", "enter"), ("a", "exit")]


def test_json_paths():
    doc = {"a": [{"x": 1, "t": "p"}, {"x": 5, "t": "q"}, {"t": "r"}], "b": {"x": 9}}
    go = lambda p: json_ops.follow(doc, json_ops.parse_path(p))
    assert go("$.a[?(@.x > 1)].t") == ["q"] and go("$.a[?(@.t == 'r')]") == [{"t": "r"}] and go("$.a[?(@.x)].x") == [1, 5]
    assert go("$..x") == [1, 5, 9] and go("$.a[-1].t") == ["r"] and go("$.a[0:2].x") == [1, 5] and go("$.*.x") == [9] and go("$['b'].x") == [9] and go("$.no") == []
    with pytest.raises(ValueError, match="path"):
        go("$.a[")


def test_spatial_accessors(spark):
    r = spatial.ring([(0, 0), (4, 0), (4, 3)])
    got = spark.range(1).select(spatial.n_points(r), spatial.end_point(r)["y"], spatial.is_closed(r), spatial.point_n(r, 9), spatial.line_text(r, "POLYGON")).first()
    assert tuple(got) == (3, 3.0, False, None, "POLYGON((0.0 0.0, 4.0 0.0, 4.0 3.0, 0.0 0.0))")


def test_keywords_of_several_words(spark):
    docs = spark.createDataFrame([(1, "In New York, new  YORK city; yorkshire"), (2, "a new one, york"), (3, None), (4, ""), (5, "city")], "id long, body string")
    keywords = spark.createDataFrame([("New York", "place"), ("New York City", "place"), ("city", "thing"), ("C++", "thing"), ("a b c d e f", "long")], "keyword string, type string")
    got = rows(text.extract_keywords(docs, "id", "body", keywords))
    assert got == [(1, "place", "New York City", 0.9), (1, "place", "New York", 0.9), (1, "thing", "city", 0.9), (5, "thing", "city", 0.9)]
    assert rows(text.extract_keywords(docs, "id", "body", keywords.limit(0))) == []


def test_json_inside_the_jvm(spark):
    """Constant containment and schemas: the expressions against the plain recursion."""
    docs = ['{"a":1,"b":{"c":"x","d":null},"e":[1,2]}', '{"a":1.0,"b":{"c":"y"}}', '{"a":"1"}', '{"a":true,"b":[]}', '{"a":12345678901234567890}', '{"a":1.5,"k":"abcd"}', "[1,2]", '"x"', "5", "null", "{bad", "", None, '{"a":{"a":{"a":1}}}', '{"a":false,"b":{}}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    parts = ['{"a":1}', '{"a":1.5}', '{"b":{"c":"x"}}', '{"b":{}}', "{}", '{"a":true}', '{"b":{"d":null}}', '"x"', "5", '{"a":{"a":{"a":1}}}', '{"e":[2]}', "null"]
    for part in parts:
        got = {r[0]: r[1] for r in df.select("i", json_ops.contains(F.col("d"), part)).collect()}
        want = {i: None if d is None else json_ops._within(json_ops.json.loads(part), json_ops._loads(d)) for i, d in enumerate(docs)}
        if part == "null":
            want = {i: w and docs[i] == "null" if w is not None else None for i, w in want.items()}
        assert got == want, part
    schemas = [
        {"type": "object"}, {"type": "object", "required": ["a"]}, {"properties": {"a": {"type": "integer", "minimum": 1, "maximum": 9}}}, {"type": "object", "additionalProperties": False, "properties": {"a": {}, "b": {}}},
        {"properties": {"b": {"type": "object", "required": ["c"]}, "k": {"type": "string", "maxLength": 3}}}, {"type": "array", "minItems": 2, "maxItems": 2}, {"type": "string", "minLength": 1}, {"type": "number"}, {"properties": {"a": {"type": "boolean"}}}, {"properties": {"e": {"items": {"type": "integer"}}}},
    ]
    for schema in schemas:
        got = {r[0]: r[1] for r in df.select("i", json_ops.valid(F.col("d"), schema)).collect()}
        want = {i: None if d is None else (v := json_ops._loads(d)) is not None and json_ops._check(v, schema) for i, d in enumerate(docs)}
        assert got == want, schema
