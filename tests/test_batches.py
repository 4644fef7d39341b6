"""What works on many rows at once gives what the plain kernels give row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import shapes as s
from tessera.functions import keyed, spatial
from tessera.operators import graph
from tessera.operators import timeseries as ts
from tessera.plans import spatial_names


def rectangles(seed, n=150):
    """Boxes on few whole coordinates, so that sides often coincide, and some off them."""
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 6, (n, 2)).astype(float)
    low[: n // 4] += rng.random((n // 4, 2)).round(2)
    return np.concatenate([low, low + rng.integers(1, 5, (n, 2))], 1)


def box(b):
    return s.Shape("POLYGON", [[np.array([b[[0, 1]], b[[2, 1]], b[[2, 3]], b[[0, 3]], b[[0, 1]]])]])


def same(a, b):
    return a.kind == b.kind and [[len(r) for r in part] for part in a.parts] == [[len(r) for r in part] for part in b.parts] and np.allclose(a.points, b.points, atol=1e-7)


def test_relations_of_boxes(spark, monkeypatch):
    a, b = rectangles(1), rectangles(2)
    bits, ok = s.relate_boxes(a, b)
    assert ok.all() and bits.tolist() == [s.relate(box(x), box(y)) for x, y in zip(a, b)]
    near = a.copy()
    near[:, 0] += 1e-7  # too near to tell by order
    assert not s.relate_boxes(a, near)[1].any()
    texts = [("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))"), ("POINT(1 1)", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), (None, "POINT(1 1)"), ("POLYGON EMPTY", "POINT(1 1)"), ("POLYGON((0 0, 4 0, 0 4, 0 0))", "POLYGON((1 1, 2 1, 1 2, 1 1))")]
    rows = spark.createDataFrame(texts, "a string, b string").coalesce(1).select(g.relation(g.from_wkt(F.col("a")), g.from_wkt(F.col("b"))).alias("bits")).collect()
    assert [r[0] for r in rows] == [None if x is None else s.relate(s.from_wkt(x), s.from_wkt(y)) for x, y in texts]


def test_trees_are_folded(spark):
    """A circle of five with a tree on one node and a leaf on another, a tree beside it, and a lone node."""
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (0, 5), (5, 6), (5, 7), (7, 8), (2, 9), (20, 21), (21, 22), (21, 23), (23, 24), (30, 31)]
    ids = sorted({x for e in edges for x in e}) + [40]
    near = {k: sorted({b for a, b in edges if a == k} | {a for a, b in edges if b == k}) for k in ids}
    far, paths = {}, {}
    for a in ids:
        far[a, a], paths[a, a], todo = 0, 1, [a]
        for x in todo:
            for y in near[x]:
                if (a, y) not in far:
                    far[a, y], paths[a, y] = far[a, x] + 1, 0
                    todo.append(y)
                paths[a, y] += paths[a, x] if far[a, y] == far[a, x] + 1 else 0
    nodes, e = spark.createDataFrame([(k,) for k in ids], "id long"), spark.createDataFrame(edges, "src long, dst long")
    f = graph._fold(*graph._adjacency(nodes, graph.undirected(e)))
    assert f.ids[f.core].tolist() == [0, 1, 2, 3, 4] and sorted(set(f.ids[f.root])) == [0, 1, 2, 3, 4, *sorted(set(f.ids[f.root]) - {0, 1, 2, 3, 4})] and len(set(f.root)) == 8
    met = {a: [far[a, b] for b in ids if b != a and (a, b) in far] for a in ids}
    assert {r["id"]: round(r["closeness"], 9) for r in graph.closeness(nodes, e).collect()} == {a: round(len(x) / sum(x), 9) if x else 0.0 for a, x in met.items()}
    on = lambda v, a, b: v not in (a, b) and (a, v) in far and (a, b) in far and far[a, v] + far[v, b] == far[a, b]
    want = {v: round(sum(paths[a, v] * paths[v, b] / paths[a, b] for a in ids for b in ids if a < b and on(v, a, b)), 9) for v in ids}
    assert {r["id"]: round(r["betweenness"], 9) for r in graph.betweenness(nodes, e).collect()} == want
    tree = spark.range(1, 50_000).select("id", (F.col("id") / 10).cast("long").alias("up"))
    found = graph.betweenness(spark.range(50_000), tree.select(F.col("id").alias("src"), F.col("up").alias("dst")))  # 50,000 searches otherwise
    assert found.where("id = 49999").first()["betweenness"] == 0 and found.count() == 50_000


def test_copies_are_not_paired(spark):
    """30,000 copies of a spot are as many neighbours, not their square of pairs."""
    at = lambda k, x: spark.range(k, k + 1).select("id", F.lit(x).alias("x"), F.lit(0.0).alias("y"))
    many = spark.range(10, 30_010).select("id", F.lit(5.0).alias("x"), F.lit(0.0).alias("y"))
    rows = many.unionByName(at(1, 6.0)).unionByName(at(2, 7.5)).unionByName(at(3, 20.0)).unionByName(spark.range(4, 5).select("id", F.lit(None).cast("double").alias("x"), F.lit(0.0).alias("y")))
    found = spatial.dbscan(rows, 1.5, 30_000)
    assert {r["id"]: r["cluster"] for r in found.where("id < 12").collect()} == {1: 1, 2: 1, 3: None, 4: None, 10: 1, 11: 1}
    assert found.where("cluster = 1").count() == 30_002 and spatial.dbscan(rows, 1.0, 30_002).where("cluster is not null").count() == 0


def test_long_windows(spark):
    """150,000 samples in one window: a sample costs a logarithm of them. What isn't a number stays in its own windows."""
    v = F.when(F.col("t") % 7 != 0, (F.col("t") % 100).cast("double"))
    rows = spark.range(150_000).select((F.col("id") - F.col("id") % 3).alias("t"), F.lit("a").alias("k")).withColumn("v", v).unionByName(spark.createDataFrame([(None, "a", 2.0), (None, "a", 4.0)], "t long, k string, v double"))
    got = {(r["t"], r["moving_avg"]) for r in ts.moving_average(rows.repartition(3), ["k"], "t", "v", 90_000).where("t is null or t % 14997 = 0").collect()}
    x = [(t - t % 3) for t in range(150_000)]
    values = [(t, float(t % 100)) for t in x if t % 7 != 0]
    want = {(None, 3.0)}
    for t in range(0, 150_000, 14_997):
        some = [b for a, b in values if t - 90_000 <= a <= t]
        want.add((t, sum(some) / len(some) if some else None))
    assert len(got) == len(want) and all(any(a == c and (b == d or abs(b - d) < 1e-9) for c, d in want) for a, b in got)
    dense = np.random.default_rng(1).random(1001)
    low, high = np.arange(1000) // 2, np.arange(1000)
    assert np.allclose(ts._range_sums(dense, low, high), [dense[a:b].sum() for a, b in zip(low, high)], rtol=1e-13)
    dense[600] = np.nan
    assert np.isnan(ts._range_sums(dense, np.array([0, 601, 500]), np.array([600, 1001, 601]))).tolist() == [False, False, True]


def test_scores_do_not_depend_on_order(spark):
    """The sums of two members are equal if their changes are, in whatever order; equal scores go by name."""
    one = [("k", 3, 0.1), ("k", 3, 0.2), ("k", 3, 0.3), ("k", 9, 0.3), ("k", 9, 0.2), ("k", 9, 0.1), ("k", 7, 0.6), ("k", 1, 0.7), ("k", 2, 1e300), ("k", 4, None)]
    z = keyed.zset(spark.createDataFrame(one, "k string, m long, s double").coalesce(1), "k", "m", "s")
    assert {r["m"]: r["s"] for r in z.collect()} == {3: 0.6, 9: 0.6, 7: 0.6, 1: 0.7, 2: 1e300, 4: None}
    assert [keyed.zrank(z, "k", "m", "s", m).first()["rank"] for m in (3, 7, 9)] == [0, 1, 2]
    assert {r["m"] for r in keyed.zrange_by_score(z, "s", 0.6, 0.65).collect()} == {3, 7, 9}


def test_buffers_together(spark):
    rng = np.random.default_rng(7)
    p, q = rng.integers(-5, 5, (20, 2)).astype(float), rng.integers(5, 9, (20, 2)).astype(float)
    circles = s.buffer_points(p, 2.0, 8)
    assert all(same(s.Shape("POLYGON", [[c]]), s.buffer(s.Shape("POINT", [[x[None]]]), 2.0)) for c, x in zip(circles, p))
    found, ok = s.buffer_segments(p, q, 2.0, 8)
    assert ok.sum() > 15 and all(same(s.Shape("POLYGON", [[c]]), s.buffer(s.Shape("LINESTRING", [[np.stack([p[k], q[k]])]]), 2.0)) for k, c in zip(np.flatnonzero(ok), found))
    boxes = rectangles(8, 40)
    found, some, ok = s.shrink_boxes(boxes, 1.0)
    left = iter(found)
    for k in np.flatnonzero(ok):
        want = s.buffer(box(boxes[k]), -1.0)
        assert same(s.Shape("POLYGON", [[next(left)]]), want) if some[k] else not want.parts
    texts = ["POINT(1 2)", "POINT(3 2)", "POINT(1 7)", "POINT(4 4)", "POINT EMPTY", "LINESTRING(0 0, 1 0, 1 1)", "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0))", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    for d in (2.0, -2.0):
        got = {r["k"]: r["w"] for r in rows.select("k", g.to_wkt(g.buffer(g.from_wkt(F.col("t")), d)).alias("w")).collect()}
        assert got == {k: None if t is None else s.to_wkt(s.buffer(s.from_wkt(t), d)) for k, t in enumerate(texts)}


def test_formats_together(spark):
    """Sure validity is validity; bytes of many forms, either order and empty ones in one batch."""
    rng = np.random.default_rng(9)
    sure = 0
    for sizes in ([5], [4, 4], [6]) * 60:
        rings = [rng.integers(0, 7 if k == 0 else 4, (n - 1, 2)).astype(float) for k, n in enumerate(sizes)]
        rings = [np.concatenate([r, r[:1]]) for r in rings]
        found = bool(s.surely_valid(np.concatenate(rings)[None], sizes)[0])
        sure += found
        assert not found or s.is_valid(s.Shape("POLYGON", [rings]))
    assert sure > 9 and s.surely_valid(s.from_wkt("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))").points[None], [5, 5])[0]
    kinds = ["POINT(1 2)", "POINT(3 4)", "POINT EMPTY", "LINESTRING(0 0, 1 1)", "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))", "MULTIPOINT((1 2), (3 4))", "POLYGON((0 0, 9 9, 9 0, 0 9, 0 0))", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"]
    texts = [t for t in kinds for _ in range(5)] + [None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).withColumn("g", g.from_wkt(F.col("t")))
    got = {r["k"]: r for r in rows.select("k", g.to_wkb(F.col("g")).alias("raw"), g.to_wkt(g.from_wkb(g.to_wkb(F.col("g")))).alias("w"), g.is_valid(F.col("g")).alias("v"), g.is_simple(F.col("g")).alias("s")).collect()}
    for k, t in enumerate(texts):
        x = None if t is None else s.from_wkt(t)
        assert tuple(got[k])[1:] == ((None,) * 4 if x is None else (s.to_wkb(x), t, s.is_valid(x), s.is_simple(x))), t


def test_texts_together(spark):
    """Texts are read and written together as they are one by one inside the JVM, and plain ones are not left to it."""
    plain = ["POINT(1 -2)", "LINESTRING (0 0, 1.5 1)", "MULTIPOINT(1 2, 3 4)", "MULTIPOINT((1 2), (3 4))", "POLYGON((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTILINESTRING((0 0, 1 1), (2 2, 3e1 3))", "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"]
    hard = ["point(1 2)", "SRID=4326;POINT(1 2)", "POINT Z (1 2 3)", "POINT EMPTY", "garbage", "", "POLYGON((1 2, 3 4), 5 6)", "LINESTRING((1 2, 3 4))", "POINT(01 +2)", "POINT(-0 .5)", "POINT(1e400 1)", "POINT(1 2)x", None]
    numbers = ["1e-5", "0.001", "123456.123456", "1234567.5", "1e15", "-1e16", "0.1234567891", "0.30000000000000004", "99999999999999999999", "-3.25"]
    texts = [t for t in (*plain, *hard, *(f"POINT({v} 7)" for v in numbers)) for _ in range(5)]
    assert s.from_texts([t for t in plain for _ in range(5)], s.from_plain_wkt)[1] == []
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    both = rows.select("t", g.read_wkt(F.col("t")).alias("a"), g.from_wkt(F.col("t")).alias("b"))
    for r in both.select("t", "a", "b", g.write_wkt(F.col("a")).alias("c"), g.to_wkt(F.col("b")).alias("d")).collect():
        assert repr(r["a"]) == repr(r["b"]) and r["c"] == r["d"], r
    json = ['{"type":"Point","coordinates":[1,-2.5]}', '{"coordinates": [[1, 2], [3, 4e0]], "type": "LineString"}', '{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}', '{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[1,1],[0,0]]]}', '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}']
    assert s.from_texts([t for t in json for _ in range(5)], s.from_plain_geojson)[1] == []
    json += ['{"type":"Point","coordinates":[-0,-0.0]}', '{"type":"Point","coordinates":[1,2,3]}', '{"type":"Point","coordinates":[1,2],"id":7}', '{"type":"Polygon","coordinates":[]}', '{"type":"Other","coordinates":[1,2]}', '{"type":["Point"],"coordinates":[1,2]}', "[1,2]", "7", "", None]
    rows = spark.createDataFrame([(t,) for t in json for _ in range(5)], "t string").coalesce(1)
    for r in rows.select("t", g.read_geojson(F.col("t")).alias("a"), g.from_geojson(F.col("t")).alias("b")).collect():
        assert repr(r["a"]) == repr(r["b"]), r


def test_numbers_in_bytes():
    rng = np.random.default_rng(3)
    texts = [repr(v) for v in (rng.normal(size=2000) * 10.0 ** rng.integers(-30, 30, 2000)).tolist()] + [f"{v:.{k % 10}f}" for k, v in enumerate((rng.normal(size=2000) * 1e4).tolist())] + ["0", "-0", "1E5", "2e-320", "9" * 30, "0.5"]
    assert s._numbers(np.frombuffer(",".join(texts).encode(), np.uint8))[2].tobytes() == np.array([*map(float, texts)]).tobytes()
    assert np.isnan(s._numbers(np.frombuffer(b"+1 01 1. .5 1-2 --1 - 1E+ 1.2.3 00 -01", np.uint8))[2]).all()


def test_overlays_of_boxes():
    a, b = rectangles(3), rectangles(4)
    for how in s.KEEP:
        blocks, ok = s.combine_boxes(a, b, how)
        found = {r: (kind, sizes, p) for rows, kind, sizes, xy in blocks for r, p in zip(rows.tolist(), xy)}
        assert ok.all() and len(found) == len(a)
        for k, (kind, sizes, p) in found.items():
            want = s.combine(box(a[k]), box(b[k]), how)
            assert kind == want.kind and sizes == [[len(r) for r in part] for part in want.parts] and (not len(p) or np.allclose(p, want.points))


def test_overlay_columns(spark):
    texts = ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON((0 0, 4 0, 0 4, 0 0))", None, "POLYGON((9 9, 12 9, 12 12, 9 12, 9 9))", "POLYGON((-1 2, 1 2, 1 3, -1 3, -1 2))"]
    other = "POLYGON((0 0, 3 0, 3 3, 0 3, 0 0))"
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).withColumn("g", g.from_wkt(F.col("t")))
    for how in s.KEEP:
        got = {r["k"]: r["w"] for r in rows.select("k", g.to_wkt(g.combine(F.col("g"), g.from_wkt(F.lit(other)), how)).alias("w")).collect()}
        assert got == {k: None if t is None else s.to_wkt(s.combine(s.from_wkt(t), s.from_wkt(other), how)) for k, t in enumerate(texts)}


def test_texts_in_batches(spark):
    spatial_names.register(spark)
    a, b = rectangles(5, 40), rectangles(6, 40)
    rows = [(k, s.to_wkt(box(x)), s.to_wkt(box(y))) for k, (x, y) in enumerate(zip(a, b))] + [(40, None, "POINT(1 1)"), (41, "POINT(1 1)", "POLYGON((0 0, 4 0, 0 4, 0 0))")]
    spark.createDataFrame(rows, "k int, a string, b string").coalesce(1).createOrReplaceTempView("texts")
    got = {r["k"]: r for r in spark.sql("SELECT k, st_within(a, b) w, st_disjoint(a, b) d, st_symdifference(a, b) x FROM texts WHERE k < 40 UNION ALL SELECT k, st_within(a, b), st_disjoint(a, b), NULL FROM texts WHERE k > 39").collect()}
    for k, x, y in rows:
        bits = None if x is None else s.relate(s.from_wkt(x), s.from_wkt(y))
        assert (got[k]["w"], got[k]["d"]) == ((None, None) if bits is None else (bool(bits & s.WITHIN), bits == 0))
        assert k > 39 or got[k]["x"] == s.to_wkt(s.combine(s.from_wkt(x), s.from_wkt(y), "symdifference"))


def test_unions_and_joins(spark):
    """Equal boxes count once, boxes apart are never cut at each other; boxes that meet are paired inside the JVM, others exactly."""
    rng = np.random.default_rng(10)
    at = [(int(x), int(y)) for x, y in rng.integers(0, 60, (1500, 2))] * 2
    rows = spark.createDataFrame([(k, 1, float(x), float(y)) for k, (x, y) in enumerate(at)], "k int, one int, x double, y double")
    boxes = rows.select("k", "one", g.make_box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("geometry"))
    got = g.union_aggregate(boxes, ["one"], "geometry").select(F.round(g.area(F.col("geometry")), 6).alias("a")).first()
    assert got["a"] == len(set(at))
    others = spark.createDataFrame([(0, "POLYGON((10 10, 12 10, 12 12, 10 12, 10 10))"), (1, "POLYGON((20 20, 30 20, 20 30, 20 20))")], "n int, t string").select("n", g.from_wkt(F.col("t")).alias("geometry"))
    pairs = {(r["k"], r["other_n"]) for r in g.spatial_join(boxes, others, 8.0).collect()}
    hit = lambda x, y, n: x <= 12 and x + 1 >= 10 and y <= 12 and y + 1 >= 10 if n == 0 else x + 1 >= 20 and y + 1 >= 20 and max(x, 20) + max(y, 20) <= 50
    assert pairs == {(k, n) for k, (x, y) in enumerate(at) for n in (0, 1) if hit(x, y, n)}


def test_overlay_areas(spark):
    """All four areas in one pass: boxes together, other shapes exactly; every order of two boxes' sides as the general overlay has it."""
    texts = ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON((0 0, 4 0, 0 4, 0 0))", None, "POLYGON((9 9, 12 9, 12 12, 9 12, 9 9))", "POLYGON EMPTY"]
    other = "POLYGON((0 0, 3 0, 3 3, 0 3, 0 0))"
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).withColumn("a", g.overlay_areas(g.from_wkt(F.col("t")), g.from_wkt(F.lit(other))))
    got = {r["k"]: r["a"] for r in rows.collect()}
    for k, t in enumerate(texts):
        for how in s.KEEP:
            assert got[k][how] == (None if t is None else pytest.approx(s.area(s.combine(s.from_wkt(t), s.from_wkt(other), how))))
    sides = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    pairs = np.array([(a, c, b, d) for a, b in sides for c, d in sides], float)
    a, b = (x.reshape(-1, 4) for x in np.broadcast_arrays(pairs[:, None], pairs[None]))
    bits, ok = s.relate_boxes(a, b)
    assert ok.all()
    for how in s.KEEP:
        for at, kind, sizes, xy in s.combine_boxes(a, b, how)[0]:
            k = int(at[0])
            want = s.combine(box(a[k]), box(b[k]), how)
            assert bits[k] == s.relate(box(a[k]), box(b[k]))
            assert kind == want.kind and sizes == [[len(r) for r in part] for part in want.parts] and np.allclose(xy[0], want.points)
            assert s.areas(sizes, xy[:1])[0] == pytest.approx(s.area(want))


def test_bounds_of_joins_are_made_once(spark):
    """The cells, and the comparison of a pair, read plain bounds; no envelope is made for them again."""
    rows = spark.range(40).select("id", g.make_box(F.col("id") % 7 * 1.5, F.col("id") % 5 * 1.5, F.col("id") % 7 * 1.5 + 3, F.col("id") % 5 * 1.5 + 2).alias("geometry"))
    joined = g.spatial_join(rows, rows, 4.0).select("id", "other_id")
    plan = joined._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cells, pairs = [x for x in plan if "explode(sequence" in x], [x for x in plan if "Join Inner" in x]
    assert cells and pairs and not any("array_min" in x or "transform" in x for x in cells + pairs)
    at = [(k, k % 7 * 1.5, k % 5 * 1.5) for k in range(40)]
    assert sorted(tuple(r) for r in joined.collect()) == [(a, b) for a, x, y in at for b, u, v in at if abs(x - u) <= 3 and abs(y - v) <= 2]


def test_points_are_collected_as_such(spark):
    """A group's points as one multi-point hold what collecting their geometries gives, nulls left out."""
    rows = spark.createDataFrame([(1, 0.5, 2.0), (1, 4.5, -1.0), (1, None, 3.0), (1, 0.5, 2.0), (2, None, None)], "k int, x double, y double")
    x, y = F.col("x"), F.col("y")
    both = rows.groupBy("k").agg(g.collect_points(x, y).alias("a"), g.collect(F.collect_list(g.make_point(x, y))).alias("b"))
    got = {r["k"]: r for r in both.select("k", g.n_geometries(F.col("a")).alias("n"), g.envelope(F.col("a")).alias("e"), g.centroid(F.col("a")).alias("c"), F.col("a").alias("a"), F.col("b").alias("b")).collect()}
    assert got[1]["n"] == 3 and tuple(got[1]["e"]) == (0.5, -1.0, 4.5, 2.0) and tuple(got[1]["c"]) == pytest.approx((5.5 / 3, 1.0))
    assert got[1]["a"]["kind"] == got[1]["b"]["kind"] == "MULTIPOINT" and sorted(got[1]["a"]["parts"]) == sorted(got[1]["b"]["parts"]) and got[2]["a"] is None


def test_texts_of_one_form(spark):
    """Texts that differ in their numbers only are read, measured and written together, as one by one; a filter on made shapes stays behind the dealing."""
    kinds = ["POLYGON((0 0, {0} 0, {0} {1}, 0 {1}, 0 0))", "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 1 {0}, 2 {0}, 1 1))", "SRID=4326;POINT({0} -{1}e-1)", "POINT Z({0} {1} 7)", "LINESTRING(0 0, {0} {1})", "MULTIPOLYGON(((0 0, 1 0, 1 {0}, 0 0)), ((5 5, 6 5, 6 {1}, 5 5)))", "POINT EMPTY"]
    texts = [t.format(a, b) for t in kinds for a, b in [(1, 2.5), (3, 4), (5.25, 6), (7, 8), (2, 2)]]
    blocks, rest = s.from_texts(texts)
    found = {k: x for rows, *block in blocks for k, x in zip(rows.tolist(), s.shapes_of(*block))}
    written = {k: t for rows, *block in blocks for k, t in zip(rows.tolist(), s.to_texts(*block))}
    assert len(found) >= 20 and sorted([*found, *rest]) == list(range(len(texts)))
    for k, x in found.items():
        assert same(x, s.from_wkt(texts[k])) and written[k] == s.to_wkt(s.from_wkt(texts[k]))
    spatial_names.register(spark)
    spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").coalesce(1).createOrReplaceTempView("forms")
    got = {r["k"]: r["a"] for r in spark.sql("SELECT k, st_area(t) a FROM forms").collect()}
    assert got == {k: None if t is None else pytest.approx(s.area(s.from_wkt(t))) for k, t in enumerate([*texts, None])}
    with pytest.raises(ValueError):
        s.from_wkt("POINT(+1 2)")
    assert s.from_texts(["POINT(+1 2)"] * 5) == ([], [0, 1, 2, 3, 4])


def test_made_shapes_are_filtered_on_all_cores(spark):
    from tessera.queries import shapes as queries

    plan = queries.cypher_spatial(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("st_within") < plan.index("Repartition")
