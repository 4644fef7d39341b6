"""Geometry kernels by identities that hold for any shapes, and columns against them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import shapes as s
from tessera.plans import spatial_names

KINDS = [
    "POINT(1 2)", "MULTIPOINT((1 2), (3 4))", "LINESTRING(0 0, 1.5 1)", "MULTILINESTRING((0 0, 1 1), (2 2, 3 3))", "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))",
    "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.5 5.2, 5.8 5.2, 5.8 5.5, 5.5 5.2)))", "POLYGON EMPTY", "MULTIPOINT EMPTY",
]


def star(rng):
    turn, at = sorted(rng.uniform(0, 6.283) for _ in range(rng.randrange(3, 9))), (rng.uniform(0, 6), rng.uniform(0, 6))
    corners = np.round(np.array([[at[0] + rng.uniform(1, 5) * np.cos(t), at[1] + rng.uniform(1, 5) * np.sin(t)] for t in turn]), 1)
    return s.make_valid(s.Shape("POLYGON", [[corners]]))


def test_overlays_add_up():
    rng = random.Random(3)
    for _ in range(60):
        a, b = star(rng), star(rng)
        if not a.parts or not b.parts:
            continue
        i, u, d, x = (s.area(s.combine(a, b, how)) for how in ("intersection", "union", "difference", "symdifference"))
        assert abs(i + u - s.area(a) - s.area(b)) < 1e-6 and abs(d + i - s.area(a)) < 1e-6 and abs(x - u + i) < 1e-6
        bits = s.relate(a, b)
        assert bool(bits & s.INTERSECTS) == (s.distance(a, b) == 0) and (i > 1e-9) <= bool(bits & s.INTERSECTS)
        assert s.relate(s.combine(a, b, "intersection"), a) & s.WITHIN if i > 1e-3 else True


@pytest.mark.parametrize("text", KINDS)
def test_formats(spark, text):
    assert s.to_wkt(s.from_wkt(text)) == text and s.to_wkt(s.from_wkb(s.to_wkb(s.from_wkt(text)))) == text
    row = spark.createDataFrame([(f"SRID=4326;{text}",)], "t string").select(g.from_wkt(F.col("t")).alias("g")).select(
        g.to_wkt(F.col("g")), g.to_wkt(g.from_geojson(g.to_geojson(F.col("g")))), g.to_wkt(g.from_wkb(g.to_wkb(F.col("g")))), g.area(F.col("g"))
    ).first()
    assert row[0] == row[2] == text and abs(row[3] - s.area(s.from_wkt(text))) < 1e-9
    assert row[1] == text or "EMPTY" in text


def test_relations_by_hand():
    box, w = s.from_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))"), s.from_wkt
    cases = [
        ("POINT(5 5)", {"intersects", "within"}), ("POINT(0 5)", {"intersects", "touches"}), ("POINT(11 5)", set()), ("MULTIPOINT((5 5), (20 20))", {"intersects", "crosses"}),
        ("LINESTRING(-1 5, 5 5)", {"intersects", "crosses"}), ("LINESTRING(0 0, 10 0)", {"intersects", "touches"}), ("LINESTRING(1 1, 2 2)", {"intersects", "within"}), ("LINESTRING(11 0, 12 5)", set()),
        ("POLYGON((10 0, 20 0, 20 10, 10 10, 10 0))", {"intersects", "touches"}), ("POLYGON((5 5, 15 5, 15 15, 5 15, 5 5))", {"intersects", "overlaps"}), ("POLYGON((1 1, 2 1, 2 2, 1 1))", {"intersects", "within"}),
        ("POLYGON((-1 -1, 11 -1, 11 11, -1 11, -1 -1))", {"intersects", "contains"}), ("POLYGON((0 0, 0 10, 10 10, 10 0, 0 0))", {"intersects", "within", "contains", "equals"}),
    ]
    for text, want in cases:
        got = s.relate(w(text), box)
        assert {n for n, bit in s.NAMES.items() if got & bit} == want, text
        back = s.relate(box, w(text))
        assert bool(back & s.CONTAINS) == ("within" in want) and bool(back & s.TOUCHES) == ("touches" in want)
    assert s.relate(w("LINESTRING(0 0, 10 10)"), w("LINESTRING(0 10, 10 0)")) == s.INTERSECTS | s.CROSSES
    assert s.relate(w("LINESTRING(0 0, 10 0)"), w("LINESTRING(5 0, 15 0)")) == s.INTERSECTS | s.OVERLAPS


def test_triangles_and_cells():
    p = np.random.default_rng(1).random((50, 2)) * 10
    triangles = s.delaunay(p)
    for t in triangles:
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        m = np.array([[bx - ax, by - ay], [cx - ax, cy - ay]])
        centre = np.linalg.solve(m, ((m**2).sum(1)) / 2) + p[t[0]]
        assert (((p - centre) ** 2).sum(1) >= ((p[t[0]] - centre) ** 2).sum() - 1e-9).all()
    cells = s.voronoi(p, (0, 0, 10, 10))
    assert abs(sum(abs(s.ring_area(c)) for c in cells) - 100) < 1e-9
    assert all(s.inside(p[k : k + 1], np.concatenate([c, np.roll(c, -1, 0)], 1))[0] for k, c in enumerate(cells))


def test_validity_and_buffers():
    bow = s.from_wkt("POLYGON((0 0, 10 10, 10 0, 0 10, 0 0))")
    assert not s.is_valid(bow) and s.is_valid(s.make_valid(bow)) and s.area(s.make_valid(bow)) == 50
    assert not s.is_simple(s.from_wkt("LINESTRING(0 0, 10 10, 10 0, 0 10)")) and s.is_simple(s.from_wkt("LINESTRING(0 0, 1 1, 2 0)"))
    box = s.from_wkt("POLYGON((0 0, 10 0, 10 10, 0 10, 0 0))")
    assert abs(s.area(s.buffer(box, 2)) - (100 + 80 + 4 * 8 * 2 * np.sin(np.pi / 16) * 1)) < 0.01 and s.area(s.buffer(box, -2)) == 36
    assert not s.buffer(box, -6).parts


def test_names_in_sql(spark):
    spatial_names.register(spark)
    row = spark.sql("SELECT st_union('POLYGON((0 0,2 0,2 2,0 2,0 0))', 'POLYGON((1 0,3 0,3 2,1 2,1 0))') u, st_astext(null) n, st_pointn('LINESTRING(0 0,1 1)', 2) p, st_centroid('LINESTRING(0 0,4 0)') c").first()
    assert tuple(row) == ("POLYGON((0 0, 3 0, 3 2, 0 2, 0 0))", None, "POINT(1 1)", "POINT(2 0)")
    assert s.to_wkt(s.combine(s.from_wkt("LINESTRING(-5 1, 5 1)"), s.from_wkt("POLYGON((0 0, 2 0, 2 2, 0 2, 0 0))"), "intersection")) == "MULTILINESTRING((0 1, 2 1))"
