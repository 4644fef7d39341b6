"""Spatial functions on plain columns: points are two doubles, rings are arrays of struct<x,y>, WKT is text.

Planar unless the name says otherwise; the sphere's radius is 6371 km. Nulls propagate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
MERCATOR = 6_378_137.0  # fixed value: the radius that Web Mercator uses


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def dwithin(x1: Column, y1: Column, x2: Column, y2: Column, d: float) -> Column:
    return distance(x1, y1, x2, y2) <= d


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees from north, 0 to 360."""
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def project(lon: Column, lat: Column, bearing_deg: Column, metres: Column) -> Column:
    """The point reached from (lon, lat) along a bearing."""
    d, b, la = metres / EARTH_M, F.radians(bearing_deg), F.radians(lat)
    lat2 = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lat2))
    return point(F.degrees(lon2), F.degrees(lat2))


def to_mercator(lon: Column, lat: Column) -> Column:
    """WGS84 degrees to Web Mercator metres."""
    return point(F.radians(lon) * MERCATOR, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR)


def from_mercator(x: Column, y: Column) -> Column:
    return point(F.degrees(x / MERCATOR), F.degrees(2 * F.atan(F.exp(y / MERCATOR)) - math.pi / 2))


def in_ring(x: Column, y: Column, r: Column) -> Column:
    """Ray casting: whether the point is inside the closed or open ring."""
    n = F.size(r)
    edges = F.sequence(F.lit(0), n - 1)

    def flips(acc: Column, i: Column) -> Column:
        a, b = F.get(r, i), F.get(r, F.pmod(i + 1, n))
        cross = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return acc != F.coalesce(cross, F.lit(False))

    return F.when(x.isNotNull() & y.isNotNull(), F.aggregate(edges, F.lit(False), flips))


def in_polygon(x: Column, y: Column, exterior: Column, holes: list[Column] | None = None) -> Column:
    """Inside the exterior ring and in none of the holes."""
    out = in_ring(x, y, exterior)
    for h in holes or []:
        out = out & ~in_ring(x, y, h)
    return out


def _steps(r: Column, f) -> Column:
    n = F.size(r)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + f(F.get(r, i), F.get(r, F.pmod(i + 1, n)), i))


def area(r: Column) -> Column:
    """Shoelace area of a ring."""
    return F.abs(_steps(r, lambda a, b, i: a["x"] * b["y"] - b["x"] * a["y"])) / 2


def perimeter(r: Column) -> Column:
    return _steps(r, lambda a, b, i: distance(a["x"], a["y"], b["x"], b["y"]))


def length(line: Column) -> Column:
    """Length of an open line."""
    n = F.size(line)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.when(i + 1 < n, distance(F.get(line, i)["x"], F.get(line, i)["y"], F.get(line, i + 1)["x"], F.get(line, i + 1)["y"])).otherwise(0.0))


def centroid(points: Column) -> Column:
    """The mean of the points."""
    total = F.aggregate(points, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y")))
    return F.when(F.size(points) > 0, point(total["x"] / F.size(points), total["y"] / F.size(points)))


def envelope(points: Column) -> Column:
    """struct<min_x, min_y, max_x, max_y>."""
    xs, ys = points["x"], points["y"]
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def extent(x: Column, y: Column) -> Column:
    """Aggregate: the bounding box of a group's points."""
    return F.struct(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def points_equal(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (F.abs(x1 - x2) < 1e-9) & (F.abs(y1 - y2) < 1e-9)


def parse_points(wkt: Column) -> Column:
    """array<struct<x,y>> of all coordinates in a WKT text (POINT, LINESTRING, a POLYGON's rings in order)."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?\s+-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"))
    return F.transform(pairs, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))


def point_text(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def point_geojson(x: Column, y: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x.cast("double"), y.cast("double")).alias("coordinates")))


def within_join(points: DataFrame, others: DataFrame, d: float, x: str = "x", y: str = "y") -> DataFrame:
    """All pairs at most d apart, by an equi-join on grid cells of side d: each left point looks into nine cells.

    Columns of others get the prefix other_.
    """
    a = points.withColumn("_cx", F.floor(F.col(x) / d)).withColumn("_cy", F.floor(F.col(y) / d))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = a.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near)).withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy"))
    b = others.select(*[F.col(c).alias(f"other_{c}") for c in others.columns]).withColumn("_cx", F.floor(F.col(f"other_{x}") / d)).withColumn("_cy", F.floor(F.col(f"other_{y}") / d))
    pairs = a.join(b, ["_cx", "_cy"]).where(distance(F.col(x), F.col(y), F.col(f"other_{x}"), F.col(f"other_{y}")) <= d)
    return pairs.drop("_cx", "_cy", "_dx", "_dy")


def geohash(lon: Column, lat: Column, length_: int = 6) -> Column:
    """The geohash text: longitude and latitude bits interleaved, five to a character."""
    letters = "0123456789bcdefghjkmnpqrstuvwxyz"  # fixed value: the geohash alphabet
    bits = 5 * length_
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    cell = lambda v, low, span, n: F.least(F.floor((v - low) / span * float(1 << n)), F.lit((1 << n) - 1)).cast("long")
    lo, la = cell(lon, -180.0, 360.0, lon_bits), cell(lat, -90.0, 180.0, lat_bits)
    parts = []
    for k in range(length_):
        value = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):
            source, n, at = (lo, lon_bits, b // 2) if b % 2 == 0 else (la, lat_bits, b // 2)
            value = F.shiftleft(value, 1).bitwiseOR(F.shiftright(source, n - 1 - at).bitwiseAND(F.lit(1)))
        parts.append(F.substring(F.lit(letters), value.cast("int") + 1, F.lit(1)))
    return F.concat(*parts)


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the hull, counter-clockwise (monotone chain), of points that fit into memory."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def group_hull(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, hull array<struct<x,y>>): the hull of every group, from the hulls of its parts in each task: no group is gathered."""
    import pandas as pd

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partial(parts):
        for part in parts:
            rows = []
            for key, g in part.groupby(keys, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                rows += [(*key, *p) for p in convex_hull(list(zip(g[x], g[y])))]
            yield pd.DataFrame(rows, columns=[*keys, x, y])

    corners = df.select(*keys, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).dropna(subset=[x, y]).mapInPandas(partial, f"{kinds}, `{x}` double, `{y}` double")

    def whole(g):
        hull = convex_hull(list(zip(g[x], g[y])))
        first = g[keys].iloc[0].to_dict()
        return pd.DataFrame([{**first, "hull": [{"x": a, "y": b} for a, b in hull]}])

    return corners.distinct().groupBy(*keys).applyInPandas(whole, f"{kinds}, hull array<struct<x: double, y: double>>")


def to_utm(lon: Column, lat: Column) -> Column:
    """WGS84 degrees to UTM on the northern hemisphere: struct<zone int, easting double, northing double>.

    The usual series of the transverse Mercator projection, good to a millimetre inside a zone.
    """
    a, f, k0 = MERCATOR, 1 / 298.257223563, 0.9996  # fixed values: the ellipsoid's axis and flattening, the central scale
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n = a / F.sqrt(1 - e2 * s * s)
    tt, cc = t * t, ep2 * c * c
    al = F.radians(lon - (zone * 6 - 183)) * c
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    power = lambda k: F.pow(al, F.lit(float(k)))
    easting = k0 * n * (al + (1 - tt + cc) * power(3) / 6 + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep2) * power(5) / 120) + 500_000
    northing = k0 * (m + n * t * (al * al / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * power(4) / 24 + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep2) * power(6) / 720))
    return F.struct(zone.alias("zone"), easting.alias("easting"), northing.alias("northing"))


def dbscan(df: DataFrame, d: float, min_points: int, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(id, cluster): density clusters named by their least core id, null for noise. A border point goes to its least core's cluster.

    Points of equal coordinates are one spot, which weighs as many, so that copies are never paired.
    Neighbouring spots come from the grid join, clusters from the components of neighbouring core spots.
    """
    from tessera.operators.graph import connected_components
    from tessera.sources.rounds import keep_round

    pts = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(y).alias("y"))
    spots = keep_round(pts.where("x is not null and y is not null").groupBy("x", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "spots")
    near = keep_round(within_join(spots, spots, d).select("id", "other_id", "other_n"), "near")
    core = near.groupBy("id").agg(F.sum("other_n").alias("_n")).where(F.col("_n") >= min_points).select("id")
    links = near.join(core, "id").join(core.withColumnRenamed("id", "other_id"), "other_id")
    label = connected_components(core, links.select(F.col("id").alias("src"), F.col("other_id").alias("dst")))
    border = near.join(label.withColumnRenamed("id", "other_id"), "other_id").groupBy("id").agg(F.min_by("component", "other_id").alias("_border"))
    named = spots.join(label, "id", "left").join(border, "id", "left").select("x", "y", F.coalesce("component", "_border").alias("cluster"))
    return pts.join(named, ["x", "y"], "left").select(F.col("id").alias(id_col), "cluster")


def kmeans(df: DataFrame, k: int, x: str = "x", y: str = "y", seed: int = 1) -> DataFrame:
    """df with `cluster`, by Spark's distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[x, y], outputCol="_features").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(rows).transform(rows).drop("_features")


def n_points(points: Column) -> Column:
    return F.size(points)


def point_n(points: Column, n: int) -> Column:
    """1-based; negative from the end; null out of range."""
    return F.try_element_at(points, F.lit(n))


def start_point(points: Column) -> Column:
    return point_n(points, 1)


def end_point(points: Column) -> Column:
    return point_n(points, -1)


def is_closed(points: Column) -> Column:
    a, b = start_point(points), end_point(points)
    return (F.size(points) > 2) & points_equal(a["x"], a["y"], b["x"], b["y"])


def is_empty(points: Column) -> Column:
    return F.size(points) == 0


def line_text(points: Column, kind: str = "LINESTRING") -> Column:
    """WKT of a line, or with kind POLYGON of a ring, closed."""
    pairs = F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string")))
    inner = F.array_join(pairs, ", ")
    if kind == "POLYGON":
        closed = F.when(is_closed(points), inner).otherwise(F.concat(inner, F.lit(", "), pairs[0]))
        return F.concat(F.lit("POLYGON(("), closed, F.lit("))"))
    return F.concat(F.lit(f"{kind}("), inner, F.lit(")"))
