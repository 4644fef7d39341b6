"""Geometries of every kind: boxes and lines laid around the customers' and suppliers' points, whose relations SQL can compute by their bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry, shapes
from tessera.plans import aql, spatial_names
from tessera.plans.commands import Store
from tessera.plans.cypher import Graph
from tessera.queries.base import query
from tessera.queries.models import PTS, points
from tessera.session import load, spread

BOXES = f"(SELECT id, x AS x1, y AS y1, x + 3 + id % 80 AS x2, y + 3 + id % 60 AS y2 FROM {PTS} p)"
FIXED = (-20.0, -15.0, 30.0, 25.0)
FIXED_TEXT = "POLYGON((-20 -15, 30 -15, 30 25, -20 25, -20 -15))"
MEET, DEEP = "x1 <= 30 AND x2 >= -20 AND y1 <= 25 AND y2 >= -15", "x1 < 30 AND x2 > -20 AND y1 < 25 AND y2 > -15"
IN, OUT = "x1 >= -20 AND x2 <= 30 AND y1 >= -15 AND y2 <= 25", "x1 <= -20 AND x2 >= 30 AND y1 <= -15 AND y2 >= 25"
COMMON = "greatest(0, least(x2, 30) - greatest(x1, -20)) * greatest(0, least(y2, 25) - greatest(y1, -15))"
OWN = "(x2 - x1) * (y2 - y1)"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(id, geometry): a box from every customer's point."""
    x, y, k = F.col("x"), F.col("y"), F.col("id")
    return spread(points(spark, d)).select("id", geometry.make_box(x, y, x + 3 + k % 80, y + 3 + k % 60).alias("geometry"))


def fixed() -> Column:
    return geometry.make_box(*map(F.lit, FIXED))


@query(f"""SELECT id, {MEET} AS intersects, NOT ({MEET}) AS disjoint, {IN} AS within, {OUT} AS contains, ({MEET}) AND NOT ({DEEP}) AS touches,
({DEEP}) AND NOT ({IN}) AND NOT ({OUT}) AS overlaps, false AS crosses, ({IN}) AND ({OUT}) AS equals FROM {BOXES} b""")
def sp_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d).withColumn("bits", geometry.relation(F.col("geometry"), fixed()))
    return rows.select("id", *[geometry.has(F.col("bits"), n).alias(n) for n in (*shapes.NAMES, "disjoint")])


LINES = f"(SELECT id, x AS x1, y AS y1, x + 9 AS x2, y AS y2 FROM {PTS} p)"


@query(f"""SELECT id, {MEET} AS intersects, ({DEEP}) AND ({IN}) AS within, ({DEEP}) AND NOT ({IN}) AS crosses, ({MEET}) AND NOT ({DEEP}) AS touches,
round(sqrt(pow(greatest(0, -20 - x2, x1 - 30), 2) + pow(greatest(0, -15 - y2, y1 - 25), 2)), 9) AS distance FROM {LINES} l""")
def sp_lines(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    line = geometry.make_line(F.array(F.struct(x, y), F.struct((x + 9).alias("x"), y)))
    rows = points(spark, d).select("id", geometry.relation(line, fixed()).alias("bits"), F.round(geometry.distance(line, fixed()), 9).alias("distance"))
    return rows.select("id", *[geometry.has(F.col("bits"), n).alias(n) for n in ("intersects", "within", "crosses", "touches")], "distance")


@query(f"""SELECT id, round(CAST({COMMON} AS DOUBLE), 6) AS intersection, round(CAST({OWN} + 2000 - {COMMON} AS DOUBLE), 6) AS "union", round(CAST({OWN} - {COMMON} AS DOUBLE), 6) AS difference,
round(CAST({OWN} + 2000 - 2 * {COMMON} AS DOUBLE), 6) AS symdifference FROM {BOXES} b""")
def sp_overlay(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes(spark, d).withColumn("areas", geometry.overlay_areas(F.col("geometry"), fixed()))
    return rows.select("id", *[F.round(F.col("areas")[how], 6).alias(how) for how in shapes.KEEP])


@query(f"SELECT id, round(64 * sin(pi() / 16), 6) AS area, round(x - 2, 6) AS min_x, round(y + 2, 6) AS max_y, round(40 + 64 * sin(pi() / 16), 6) AS along, 0.0 AS less FROM {PTS} p")
def sp_buffer(spark: SparkSession, d: str) -> DataFrame:
    """A point's circle, a line's capsule of length 10, and a box of side 4 taken in by 2 on every side."""
    x, y = F.col("x"), F.col("y")
    circle = geometry.buffer(geometry.make_point(x, y), 2.0)
    capsule = geometry.buffer(geometry.make_line(F.array(F.struct(x, y), F.struct((x + 10).alias("x"), y))), 2.0)
    box = geometry.buffer(geometry.make_box(x, y, x + 4, y + 4), -2.0)
    e = geometry.envelope(circle)
    return spread(points(spark, d)).select(
        "id", F.round(geometry.area(circle), 6).alias("area"), F.round(e["min_x"], 6).alias("min_x"), F.round(e["max_y"], 6).alias("max_y"), F.round(geometry.area(capsule), 6).alias("along"), F.round(geometry.area(box), 6).alias("less")
    )


TEXT = "'POLYGON((' || {0} || ' ' || {1} || ', ' || ({0} + 9) || ' ' || {1} || ', ' || ({0} + 9) || ' ' || ({1} + 9) || ', ' || {0} || ' ' || ({1} + 9) || ', ' || {0} || ' ' || {1} || '), (' || ({0} + 1) || ' ' || ({1} + 1) || ', ' || ({0} + 1) || ' ' || ({1} + 3) || ', ' || ({0} + 3) || ' ' || ({1} + 3) || ', ' || ({0} + 3) || ' ' || ({1} + 1) || ', ' || ({0} + 1) || ' ' || ({1} + 1) || '))'"
IX, IY = "CAST(x AS INT)", "CAST(y AS INT)"


def _holed(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, wkt, g): a square of side 9 with a hole of side 2, read from text."""
    rows = spread(points(spark, d)).withColumn("wkt", F.expr(TEXT.format("int(x)", "int(y)")))
    return rows.withColumn("g", geometry.read_wkt(F.col("wkt")))


@query(f"""SELECT id, 10 AS points, 1 AS members, 1 AS holes, 77.0 AS area, 44.0 AS perimeter, round((81 * (x + 4.5) - 4 * (x + 2)) / 77, 9) AS cx, round((81 * (y + 4.5) - 4 * (y + 2)) / 77, 9) AS cy,
x AS min_x, y + 9 AS max_y, true AS closed, false AS empty, 'POLYGON' AS kind, x + 1 AS hole_x, 2 AS rims FROM {PTS} p""")
def sp_accessors(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("g")
    c, e = geometry.centroid(g), geometry.envelope(g)
    hole = geometry.coordinates(geometry.interior_ring_n(g, 1))
    return _holed(spark, d).select(
        "id", F.size(geometry.coordinates(g)).alias("points"), geometry.n_geometries(g).alias("members"), geometry.n_interior_rings(g).alias("holes"), geometry.area(g).alias("area"), geometry.length(g).alias("perimeter"),
        F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"), e["min_x"].alias("min_x"), e["max_y"].alias("max_y"), geometry.is_closed(g).alias("closed"), geometry.is_empty(g).alias("empty"), g["kind"].alias("kind"),
        hole[0]["x"].alias("hole_x"), geometry.n_geometries(geometry.boundary(g)).alias("rims"),
    )


@query(f"""SELECT id, {TEXT.format(IX, IY)} AS wkt, 177 AS n_bytes, {TEXT.format(IX, IY)} AS from_bytes,
'{{"type":"Point","coordinates":[' || {IX} || ',' || {IY} || ']}}' AS json, 'POINT(' || {IX} || ' ' || {IY} || ')' AS from_json, true AS valid, true AS simple, 4326 AS srid FROM {PTS} p""")
def sp_formats(spark: SparkSession, d: str) -> DataFrame:
    g, raw, json = F.col("g"), geometry.to_wkb(F.col("g")), F.col("json")
    rows = _holed(spark, d).withColumn("json", geometry.to_geojson(geometry.make_point(F.col("x"), F.col("y"))))
    return rows.select(
        "id", geometry.write_wkt(g).alias("wkt"), F.octet_length(raw).alias("n_bytes"), geometry.write_wkt(geometry.from_wkb(raw)).alias("from_bytes"), "json", geometry.write_wkt(geometry.read_geojson(json)).alias("from_json"),
        geometry.is_valid(g).alias("valid"), geometry.is_simple(g).alias("simple"), geometry.srid(geometry.set_srid(F.col("wkt"), 4326)).alias("srid"),
    )


@query(f"""SELECT m.*, u.covered FROM (SELECT id % 5 AS g, count(*) AS members, min(x) AS min_x, max(y) AS max_y, round(avg(x), 9) AS cx FROM {PTS} p GROUP BY 1) m
JOIN (SELECT g, CAST(count(*) AS DOUBLE) AS covered FROM (SELECT DISTINCT id % 5 AS g, x, y FROM {PTS} q) x GROUP BY g) u USING (g)""")
def sp_collect(spark: SparkSession, d: str) -> DataFrame:
    """Collected points, and the union of unit boxes at them."""
    x, y = F.col("x"), F.col("y")
    rows = spread(points(spark, d)).withColumn("g", F.col("id") % 5)
    m = F.col("m")
    many = rows.groupBy("g").agg(geometry.collect_points(x, y).alias("m")).select("g", geometry.n_geometries(m).cast("long").alias("members"), geometry.envelope(m).alias("e"), geometry.centroid(m).alias("c"))
    one = geometry.union_aggregate(rows.select("g", geometry.make_box(x, y, x + 1, y + 1).alias("box")), ["g"], "box").select("g", F.round(geometry.area(F.col("box")), 6).alias("covered"))
    return many.select("g", "members", F.col("e.min_x").alias("min_x"), F.col("e.max_y").alias("max_y"), F.round(F.col("c.x"), 9).alias("cx")).join(one, "g")


STORES = "(SELECT 1000 + s_suppkey AS id, CAST(s_suppkey * 53 % 360 - 180 AS DOUBLE) AS x1, CAST(s_suppkey * 29 % 170 - 85 AS DOUBLE) AS y1 FROM supplier)"


@query(f"SELECT b.id, s.id AS other_id FROM {BOXES} b JOIN {STORES} s ON b.x1 <= s.x1 + 6 AND b.x2 >= s.x1 AND b.y1 <= s.y1 + 4 AND b.y2 >= s.y1")
def sp_join(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k * 53 % 360 - 180).cast("double"), (k * 29 % 170 - 85).cast("double")
    stores = load(spark, d, "supplier").select((k + 1000).alias("id"), geometry.make_box(x, y, x + 6, y + 4).alias("geometry"))
    return geometry.spatial_join(boxes(spark, d), stores, 40.0).select("id", "other_id")


@query(f"SELECT id % 50 AS g, 61200.0 AS cells FROM {PTS} p GROUP BY id % 50")
def sp_voronoi(spark: SparkSession, d: str) -> DataFrame:
    """Cells of every group's points, which fill the box."""
    rows = points(spark, d).groupBy((F.col("id") % 50).alias("g")).agg(geometry.collect(F.collect_list(geometry.make_point(F.col("x"), F.col("y")))).alias("m"))
    return rows.select("g", F.round(geometry.area(geometry.voronoi(F.col("m"), (-180.0, -85.0, 180.0, 85.0))), 3).alias("cells"))


@query(f"SELECT id, 6.0 AS area, 12.0 AS perimeter, 7.0 AS line, 'POINT(' || {IX} || ' ' || {IY} || ')' AS wkt FROM {PTS} p")
def sp_area(spark: SparkSession, d: str) -> DataFrame:
    """A right triangle at every point, with the two sides that meet in its right angle as a line."""
    x, y = F.col("x"), F.col("y")
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    corners = F.array(at(x, y), at(x + 4, y), at(x + 4, y + 3))
    g = geometry.make_polygon(F.concat(corners, F.array(corners[0])))
    return points(spark, d).select("id", geometry.area(g).alias("area"), geometry.length(g).alias("perimeter"), geometry.length(geometry.make_line(corners)).alias("line"), geometry.to_wkt(geometry.make_point(x, y)).alias("wkt"))


_LON, _LAT = "least(31, CAST(floor((x + 180) / 360 * 32) AS INT))", "least(31, CAST(floor((y + 90) / 180 * 32) AS INT))"
_BITS = " + ".join(f"((({_LON}) >> {4 - k}) & 1) * {1 << (9 - 2 * k)} + ((({_LAT}) >> {4 - k}) & 1) * {1 << (8 - 2 * k)}" for k in range(5))


@query(f"SELECT id, substr('0123456789bcdefghjkmnpqrstuvwxyz', (bits // 32) + 1, 1) || substr('0123456789bcdefghjkmnpqrstuvwxyz', (bits % 32) + 1, 1) AS hash FROM (SELECT id, {_BITS} AS bits FROM {PTS} p) b")
def sp_geohash(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions import spatial

    return points(spark, d).select("id", spatial.geohash(F.col("x"), F.col("y"), 2).alias("hash"))


# front ends


def _placed(spark: SparkSession, d: str) -> Graph:
    x, y, k = F.col("x").cast("int"), F.col("y").cast("int"), F.col("id")
    at = [(x, y), (x + 3 + k % 80, y), (x + 3 + k % 80, y + 3 + k % 60), (x, y + 3 + k % 60), (x, y)]
    text = F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *[F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in at]), F.lit("))"))
    # a generator's text is made once a row, and a filter on it isn't moved in front of the dealing to all cores
    nodes = spread(points(spark, d)).select("id", F.array(F.lit("Place")).alias("labels"), "x", "y", F.explode(F.array(text)).alias("shape"))
    return Graph(nodes, spark.createDataFrame([], "src long, dst long, type string"))


@query(f"SELECT id, round(sqrt((x1 - 10) * (x1 - 10) + (y1 - 20) * (y1 - 20)), 9) AS far, x1 = x1 AS named FROM {BOXES} b WHERE {IN}")
def cypher_spatial(spark: SparkSession, d: str) -> DataFrame:
    text = f"MATCH (p:Place) WHERE within(p.shape, '{FIXED_TEXT}') RETURN p.id AS id, round(distance(point({{x: p.x, y: p.y}}), point({{x: 10, y: 20}})), 9) AS far, st_geometrytype(bbox(p.shape)) = 'POLYGON' AS named"
    return _placed(spark, d).query(text)


@query(f"SELECT id FROM {PTS} p WHERE sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) <= 25")
def cypher_within_distance(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).query("CALL spatial.withindistance({x: 10, y: 20, distance: 25}) YIELD id")


HAVERSINE = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(20 - y) / 2), 2) + cos(radians(y)) * cos(radians(20)) * pow(sin(radians(10 - x) / 2), 2))))"


@query(f"SELECT id, round({HAVERSINE}, 3) AS metres, sqrt((x - 10) * (x - 10) + (y - 20) * (y - 20)) >= 0 AND x > -20 AND x < 30 AND y > -15 AND y < 25 AS inside FROM {PTS} p WHERE {HAVERSINE} BETWEEN 0 AND 4000000")
def aql_spatial(spark: SparkSession, d: str) -> DataFrame:
    text = f"FOR p IN places LET at = GEO_POINT(p.x, p.y) FILTER GEO_IN_RANGE(at, GEO_POINT(10, 20), 0, 4000000) RETURN {{id: p.id, metres: ROUND(GEO_DISTANCE(at, GEO_POINT(10, 20)), 3), inside: GEO_CONTAINS(GEO_POLYGON([[-20, -15], [30, -15], [30, 25], [-20, 25], [-20, -15]]), at)}}"
    return aql.run(spark, text, {"places": points(spark, d)})


@query(f"SELECT id FROM {PTS} p WHERE y BETWEEN -15 AND 25 AND x BETWEEN -20 AND 30")
def aql_rectangle(spark: SparkSession, d: str) -> DataFrame:
    places = points(spark, d).select("id", F.col("y").alias("latitude"), F.col("x").alias("longitude"))
    return aql.run(spark, "FOR p IN WITHIN_RECTANGLE(places, -15, -20, 25, 30) RETURN {id: p.id}", {"places": places})


@query(f"SELECT CAST(id AS VARCHAR) AS name, how FROM {BOXES} b, (VALUES ('within'), ('contains'), ('overlaps')) t(how) WHERE (how = 'within' AND {IN}) OR (how = 'contains' AND {OUT}) OR (how = 'overlaps' AND ({DEEP}) AND NOT ({IN}) AND NOT ({OUT}))")
def command_geo_relations(spark: SparkSession, d: str) -> DataFrame:
    s = Store(spark)
    s.load_shapes("boxes", _placed(spark, d).nodes.select(F.col("id").cast("string").alias("name"), F.col("shape").alias("wkt")))
    out = None
    for how in ("within", "contains", "overlaps"):
        rows = s.run(f"GEO.{how.upper()} boxes '{FIXED_TEXT}'").withColumn("how", F.lit(how))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT id, {MEET} AS meets, CAST({COMMON} AS DOUBLE) AS common FROM {BOXES} b")
def sql_spatial(spark: SparkSession, d: str) -> DataFrame:
    """ST_* functions by name in SQL text."""
    spatial_names.register(spark)
    _placed(spark, d).nodes.createOrReplaceTempView("placed_shapes")
    return spark.sql(f"SELECT id, st_intersects(shape, '{FIXED_TEXT}') AS meets, round(st_area(st_intersection(shape, '{FIXED_TEXT}')), 6) AS common FROM placed_shapes")
