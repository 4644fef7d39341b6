"""Geometries of every kind as columns: struct<kind, parts>, where a part is a polygon's rings, one line or one point.

Reading and writing text and GeoJSON, accessors and measures are expressions inside the JVM (`read_wkt`,
`write_wkt` and `read_geojson` give the same on Arrow batches, for many rows of few forms). What
compares or builds shapes edge by edge (predicates, distance, overlays, buffers, WKB) runs on Arrow
batches in `tessera.functions.shapes`. Planar. Nulls propagate, and a text that isn't a geometry is null.
Joins of two tables go by grid cells (`spatial_join`), never over all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import shapes, spatial
from tessera.functions.shapes import Shape

POINTS = "array<struct<x: double, y: double>>"
GEOMETRY = f"struct<kind: string, parts: array<array<{POINTS}>>>"
_XY = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))


def _once(f: Callable[..., Column]) -> Callable[..., Column]:
    """f with its first argument evaluated once, however often f names it: expressions that are nested don't multiply."""

    @wraps(f)
    def bound(first: Column, *rest: object) -> Column:
        return F.get(F.transform(F.array(first), lambda x: f(x, *rest)), F.lit(0))

    return bound


def geometry(kind: Column | str, parts: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), parts.alias("parts")).cast(GEOMETRY)


def make_point(x: Column, y: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), geometry("POINT", F.array(F.array(F.array(spatial.point(x, y))))))


def make_line(points: Column) -> Column:
    return geometry("LINESTRING", F.array(F.array(points)))


def make_polygon(ring: Column, *holes: Column) -> Column:
    return geometry("POLYGON", F.array(F.array(ring, *holes)))


def make_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return make_polygon(F.array(spatial.point(x1, y1), spatial.point(x2, y1), spatial.point(x2, y2), spatial.point(x1, y2), spatial.point(x1, y1)))


# text


@_once
def from_wkt(text: Column) -> Column:
    """Any of the six kinds, with or without SRID; ordinates beyond the second are left out; EMPTY has no parts."""
    body = F.trim(F.regexp_replace(text, r"(?i)^\s*SRID=\d+;", ""))
    kind = F.upper(F.regexp_extract(body, r"^([A-Za-z]+)", 1))
    inner = F.regexp_extract(body, r"(?s)^[A-Za-z]+\s*(?:ZM|Z|M|zm|z|m)?\s*\((.*)\)\s*$", 1)
    number = lambda p, k: F.element_at(F.split(F.trim(p), r"\s+"), k).cast("double")
    points = lambda t: F.transform(F.split(F.regexp_replace(t, r"[()]", " "), ","), lambda p: F.struct(number(p, 1).alias("x"), number(p, 2).alias("y")))
    rings = lambda t: F.transform(F.split(t, r"\)\s*,\s*\("), points)
    parts = (
        F.when(kind.isin("POINT", "LINESTRING"), F.array(F.array(points(inner))))
        .when(kind == "MULTIPOINT", F.transform(points(inner), lambda p: F.array(F.array(p))))
        .when(kind == "MULTILINESTRING", F.transform(rings(inner), lambda r: F.array(r)))
        .when(kind == "POLYGON", F.array(rings(inner)))
        .when(kind == "MULTIPOLYGON", F.transform(F.split(inner, r"\)\s*\)\s*,\s*\(\s*\("), rings))
    )
    empty = F.lower(body).rlike(r"\bempty$")
    known = kind.isin(*shapes.DIMENSION) & (empty | (inner != ""))
    return F.when(known, geometry(kind, F.when(empty, F.array().cast(f"array<array<{POINTS}>>")).otherwise(parts)))


@_once
def _text_number(v: Column) -> Column:
    v = F.round(v, shapes.DIGITS) + F.lit(0.0)
    return F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("long").cast("string")).otherwise(v.cast("string"))


@_once
def to_wkt(g: Column) -> Column:
    line = lambda r: F.array_join(F.transform(r, lambda p: F.concat(_text_number(p["x"]), F.lit(" "), _text_number(p["y"]))), ", ")
    wrapped = lambda t: F.concat(F.lit("("), t, F.lit(")"))
    area = lambda part: wrapped(F.array_join(F.transform(part, lambda r: wrapped(line(r))), ", "))
    parts = g["parts"]
    body = (
        F.when(g["kind"].isin("POINT", "LINESTRING"), wrapped(line(parts[0][0])))
        .when(g["kind"].isin("MULTIPOINT", "MULTILINESTRING"), wrapped(F.array_join(F.transform(parts, lambda part: wrapped(line(part[0]))), ", ")))
        .when(g["kind"] == "POLYGON", area(parts[0]))
        .otherwise(wrapped(F.array_join(F.transform(parts, area), ", ")))
    )
    return F.when(F.size(parts) == 0, F.concat(g["kind"], F.lit(" EMPTY"))).otherwise(F.concat(g["kind"], body))


_JSON = shapes.GEOJSON


@_once
def from_geojson(text: Column) -> Column:
    kind, raw = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates")
    read = lambda depth: F.from_json(raw, "array<" * depth + "double" + ">" * depth)
    point = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    run = lambda r: F.transform(r, point)
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(point(read(1))))))
        .when(kind == "LineString", F.array(F.array(run(read(2)))))
        .when(kind == "MultiPoint", F.transform(read(2), lambda c: F.array(F.array(point(c)))))
        .when(kind == "Polygon", F.array(F.transform(read(3), run)))
        .when(kind == "MultiLineString", F.transform(read(3), lambda r: F.array(run(r))))
        .when(kind == "MultiPolygon", F.transform(read(4), lambda part: F.transform(part, run)))
    )
    return F.when(kind.isin(*_JSON), geometry(F.upper(kind), parts))


@_once
def to_geojson(g: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in _JSON.items() for x in kv[::-1]])
    pair = lambda p: F.concat(F.lit("["), _text_number(p["x"]), F.lit(","), _text_number(p["y"]), F.lit("]"))
    listed = lambda items: F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    run = lambda r: listed(F.transform(r, pair))
    area = lambda part: listed(F.transform(part, run))
    parts = g["parts"]
    body = (
        F.when(F.size(parts) == 0, F.lit("[]"))
        .when(g["kind"] == "POINT", pair(parts[0][0][0]))
        .when(g["kind"] == "LINESTRING", run(parts[0][0]))
        .when(g["kind"] == "MULTIPOINT", listed(F.transform(parts, lambda part: pair(part[0][0]))))
        .when(g["kind"] == "MULTILINESTRING", listed(F.transform(parts, lambda part: run(part[0]))))
        .when(g["kind"] == "POLYGON", area(parts[0]))
        .otherwise(listed(F.transform(parts, area)))
    )
    return F.concat(F.lit('{"type":"'), names[g["kind"]], F.lit('","coordinates":'), body, F.lit("}"))


def srid(text: Column) -> Column:
    """The SRID that a text names, else 0."""
    return F.coalesce(F.regexp_extract(text, r"(?i)^\s*SRID=(\d+);", 1).try_cast("int"), F.lit(0))


def set_srid(text: Column, n: int) -> Column:
    return F.concat(F.lit(f"SRID={n};"), F.regexp_replace(text, r"(?i)^\s*SRID=\d+;", ""))


def ordinate(text: Column, k: int) -> Column:
    """The k-th number of a point's text: 1 and 2 are x and y, 3 is z (or m of a POINT M), 4 is m."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)(?=[\s)])")), F.lit(k)).try_cast("double")


# accessors


def coordinates(g: Column) -> Column:
    """All points in order, closing ones included."""
    return F.flatten(F.flatten(g["parts"]))


def n_geometries(g: Column) -> Column:
    return F.size(g["parts"])


@_once
def geometry_n(g: Column, n: int) -> Column:
    """The n-th member, from 1; null out of range."""
    part = F.try_element_at(g["parts"], F.lit(n))
    return F.when(part.isNotNull(), geometry(F.regexp_replace(g["kind"], "^MULTI", ""), F.array(part)))


@_once
def exterior_ring(g: Column) -> Column:
    return F.when((g["kind"] == "POLYGON") & (F.size(g["parts"]) > 0), make_line(F.get(F.get(g["parts"], F.lit(0)), F.lit(0))))


@_once
def n_interior_rings(g: Column) -> Column:
    return F.when((g["kind"] == "POLYGON") & (F.size(g["parts"]) > 0), F.size(F.get(g["parts"], F.lit(0))) - 1)


@_once
def interior_ring_n(g: Column, n: int) -> Column:
    """The n-th hole, from 1; null out of range."""
    ring = F.try_element_at(F.get(g["parts"], F.lit(0)), F.lit(n + 1))
    return F.when((g["kind"] == "POLYGON") & ring.isNotNull(), make_line(ring))


def is_empty(g: Column) -> Column:
    return F.size(g["parts"]) == 0


@_once
def is_closed(g: Column) -> Column:
    """Whether all lines end where they begin; points are closed."""
    each = F.forall(F.flatten(g["parts"]), lambda r: spatial.points_equal(r[0]["x"], r[0]["y"], F.element_at(r, -1)["x"], F.element_at(r, -1)["y"]))
    return F.when(g["kind"].isin("POINT", "MULTIPOINT"), F.lit(True)).otherwise(each)


@_once
def boundary(g: Column) -> Column:
    """Rings of areas as lines; ends of open lines; nothing for points."""
    none = F.array().cast(f"array<array<{POINTS}>>")
    rings = F.transform(F.flatten(g["parts"]), lambda r: F.array(r))
    opened = F.filter(F.flatten(g["parts"]), lambda r: ~spatial.points_equal(r[0]["x"], r[0]["y"], F.element_at(r, -1)["x"], F.element_at(r, -1)["y"]))
    ends = F.flatten(F.transform(opened, lambda r: F.array(F.array(F.array(r[0])), F.array(F.array(F.element_at(r, -1))))))
    return F.when(g["kind"].isin("POLYGON", "MULTIPOLYGON"), geometry("MULTILINESTRING", rings)).otherwise(geometry("MULTIPOINT", F.when(g["kind"].isin("LINESTRING", "MULTILINESTRING"), ends).otherwise(none)))


@_once
def collect(geometries: Column) -> Column:
    """An array of geometries of one family (points, lines, areas) as one multi-geometry; null for none or mixed ones."""
    family = F.array_distinct(F.transform(F.array_distinct(geometries["kind"]), lambda kind: F.regexp_replace(kind, "^MULTI", "")))
    return F.when(F.size(family) == 1, geometry(F.concat(F.lit("MULTI"), F.get(family, F.lit(0))), F.flatten(geometries["parts"])))


def collect_points(x: Column, y: Column) -> Column:
    """Aggregate: a group's points as one multi-point, as `collect` of them; null for none. Only two numbers a point are gathered."""
    found = F.collect_list(F.when(x.isNotNull() & y.isNotNull(), spatial.point(x, y)))
    return F.when(F.size(found) > 0, geometry("MULTIPOINT", F.transform(found, lambda p: F.array(F.array(p)))))


# measures


def _ring_sum(r: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), F.lit(0.0), lambda s, i: s + F.when(i + 1 < F.size(r), f(F.get(r, i), F.get(r, i + 1))).otherwise(0.0))


def _is_area(g: Column) -> Column:
    return g["kind"].isin("POLYGON", "MULTIPOLYGON")


@_once
def area(g: Column) -> Column:
    """Outer rings less their holes; 0 for points and lines. Rings are closed."""
    ring = lambda r: F.abs(_ring_sum(r, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])) / 2
    part = lambda p: F.aggregate(p, F.lit(0.0), lambda s, r: s - ring(r)) + 2 * ring(p[0])
    return F.when(_is_area(g), F.aggregate(g["parts"], F.lit(0.0), lambda s, p: s + part(p))).when(g.isNotNull(), 0.0)


def length(g: Column) -> Column:
    """Of lines; of the rings of areas it is their perimeter."""
    run = lambda r: _ring_sum(r, lambda a, b: spatial.distance(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(F.flatten(g["parts"]), F.lit(0.0), lambda s, r: s + run(r))


def envelope(g: Column) -> Column:
    """struct<min_x, min_y, max_x, max_y>."""
    return _once(spatial.envelope)(coordinates(g))


@_once
def is_box(g: Column) -> Column:
    """Whether an area is one axis-parallel box, which is its own envelope."""
    ring = F.get(F.get(g["parts"], F.lit(0)), F.lit(0))
    same = lambda i, j, c: F.get(ring, F.lit(i))[c] == F.get(ring, F.lit(j))[c]
    flat = same(0, 1, "x") & same(1, 2, "y") & same(2, 3, "x") & same(3, 0, "y")
    steep = same(0, 1, "y") & same(1, 2, "x") & same(2, 3, "y") & same(3, 0, "x")
    one = (F.size(g["parts"]) == 1) & (F.size(F.get(g["parts"], F.lit(0))) == 1) & (F.size(ring) == 5)
    apart = ~same(0, 2, "x") & ~same(0, 2, "y")
    return F.coalesce(_is_area(g) & one & apart & same(0, 4, "x") & same(0, 4, "y") & (flat | steep), F.lit(False))


@_once
def envelope_shape(g: Column) -> Column:
    e = envelope(g)
    return F.when(F.size(g["parts"]) > 0, make_box(e["min_x"], e["min_y"], e["max_x"], e["max_y"]))


@_once
def centroid(g: Column) -> Column:
    """struct<x, y>: by area, by length, or of points."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda s, w, x, y: F.struct((s["w"] + w).alias("w"), (s["x"] + w * x).alias("x"), (s["y"] + w * y).alias("y"))

    def run(s: Column, r: Column, weigh: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(r) - 1), s, lambda t, i: F.when(i + 1 < F.size(r), add(t, *weigh(F.get(r, i), F.get(r, i + 1)))).otherwise(t))

    def by_area(s: Column, part: Column) -> Column:
        cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
        for_ring = lambda r: run(zero, r, lambda a, b: (cross(a, b), (a["x"] + b["x"]) / 3, (a["y"] + b["y"]) / 3))

        def fold(t: Column, i: Column) -> Column:
            c = for_ring(F.get(part, i))
            sign = F.signum(c["w"]) * F.when(i == 0, 1.0).otherwise(-1.0)
            return F.struct((t["w"] + sign * c["w"]).alias("w"), (t["x"] + sign * c["x"]).alias("x"), (t["y"] + sign * c["y"]).alias("y"))

        return F.aggregate(F.sequence(F.lit(0), F.size(part) - 1), s, fold)

    areas = F.aggregate(g["parts"], zero, by_area)
    middle = lambda a, b: (spatial.distance(a["x"], a["y"], b["x"], b["y"]), (a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)
    lines = F.aggregate(F.flatten(g["parts"]), zero, lambda s, r: run(s, r, middle))
    total = lambda c: F.aggregate(coordinates(g)[c], F.lit(0.0), lambda s, v: s + v)
    points = F.struct(F.size(coordinates(g)).cast("double").alias("w"), total("x").alias("x"), total("y").alias("y"))
    t = F.when(_is_area(g), areas).when(g["kind"].isin("LINESTRING", "MULTILINESTRING"), lines).otherwise(points)
    return _once(lambda t: F.when(t["w"] != 0, F.struct((t["x"] / t["w"]).alias("x"), (t["y"] / t["w"]).alias("y"))))(t)


# on Arrow batches


class _Batch:
    """The geometries of an Arrow column: shapes one by one, or the points of all that have the same form at once."""

    def __init__(self, column: pa.StructArray) -> None:
        parts = column.field("parts")
        rings = parts.values
        runs = rings.values
        kind = column.field("kind").dictionary_encode()
        self.names = np.array([*kind.dictionary.to_pylist(), None], object)
        self.codes = kind.indices.fill_null(len(self.names) - 1).to_numpy(zero_copy_only=False)
        self.known = np.asarray(column.is_valid()) & np.asarray(parts.is_valid()) & (self.codes < len(self.names) - 1)
        self.parts, self.rings, self.runs = (np.asarray(x.offsets, np.int64) for x in (parts, rings, runs))
        at = lambda name: runs.values.field(name).to_numpy(zero_copy_only=False)
        self.xy = np.stack([at("x"), at("y")], 1) if len(runs.values) else np.zeros((0, 2))

    def __len__(self) -> int:
        return len(self.codes)

    def of_kind(self, kinds: tuple[str, ...]) -> np.ndarray:
        return np.array([k in kinds for k in self.names], bool)[self.codes]

    def __getitem__(self, k: int) -> Shape | None:
        if not self.known[k]:
            return None
        ring = lambda r: self.xy[self.runs[r] : self.runs[r + 1]]
        return Shape(self.names[self.codes[k]], [[ring(r) for r in range(self.rings[p], self.rings[p + 1])] for p in range(self.parts[k], self.parts[k + 1])])

    def shapes(self) -> list[Shape | None]:
        return [self[k] for k in range(len(self))]

    def of_one_part(self, kinds: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of these kinds that have one part, and its number of rings."""
        rows = np.flatnonzero(self.known & self.of_kind(kinds) & (np.diff(self.parts) == 1))
        return rows, np.diff(self.rings)[self.parts[rows]]

    def forms(self, *kinds: str) -> Iterator[tuple[str, list[int], np.ndarray, np.ndarray]]:
        """(kind, sizes of the rings, rows, their points) of the rows that have one part, by form; forms of few rows are left out."""
        rows, n = self.of_one_part(kinds)
        for rings in np.unique(n):
            some = rows[n == rings]
            first = self.rings[self.parts[some]]
            sizes = np.diff(self.runs)[first[:, None] + np.arange(rings)]
            alike = len(some) and (sizes == sizes[0]).all()
            forms, back, count = (sizes[:1], np.zeros(len(some), int), np.array([len(some)])) if alike else np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
            for k in np.flatnonzero(count > 3):
                mine = np.ravel(back) == k
                for kind in kinds:
                    here = some[mine & self.of_kind((kind,))[some]]
                    if len(here):
                        yield kind, [int(x) for x in forms[k]], here, self.xy[self.runs[self.rings[self.parts[here]]][:, None] + np.arange(forms[k].sum())]

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """As shapes.boxed."""
        ok, bounds = np.zeros(len(self), bool), np.zeros((len(self), 4))
        rows, n = self.of_one_part(("POLYGON", "MULTIPOLYGON"))
        rows = rows[n == 1]
        first = self.rings[self.parts[rows]]
        five = np.diff(self.runs)[first] == 5 if len(rows) else np.zeros(0, bool)
        rows, first = rows[five], first[five]
        if len(rows):
            ok[rows], bounds[rows] = shapes.boxes(self.xy[self.runs[first][:, None] + np.arange(5)])
        return ok, bounds


_TYPE = pa.struct([("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))])


def _nested(kinds: pa.Array, parts: np.ndarray, rings: np.ndarray, runs: np.ndarray, xy: np.ndarray, gone: np.ndarray | None = None) -> pa.StructArray:
    """An Arrow column from the numbers of parts, of rings of each part and of points of each ring."""
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], names=["x", "y"])
    nested = points
    for n in (runs, rings, parts):
        nested = pa.ListArray.from_arrays(ends(n), nested)
    return pa.StructArray.from_arrays([kinds, nested], fields=list(_TYPE), mask=None if gone is None else pa.array(gone))


def _column(n: int, blocks: list[shapes.Block], others: dict[int, Shape | None]) -> pa.StructArray:
    """Rows 0 to n - 1 as an Arrow column, from blocks and from single shapes."""
    made, rows = [], []
    for at, kind, sizes, xy in blocks:
        flat = [k for part in sizes for k in part]
        kinds = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), np.int32)), pa.array([kind])).dictionary_decode()
        made.append(_nested(kinds, np.full(len(at), len(sizes)), np.tile([len(part) for part in sizes], len(at)).astype(int), np.tile(flat, len(at)).astype(int), (xy + 0.0).reshape(-1, 2)))
        rows.append(at)
    if others:
        found = [s or Shape(None, []) for s in others.values()]
        xy = np.concatenate([np.zeros((0, 2)), *[r for s in found for part in s.parts for r in part]]) + 0.0
        kinds = pa.array([s.kind for s in found], pa.string())
        made.append(_nested(kinds, np.array([len(s.parts) for s in found], int), np.array([len(part) for s in found for part in s.parts], int), np.array([len(r) for s in found for part in s.parts for r in part], int), xy, np.array([s.kind is None for s in found], bool)))
        rows.append(np.fromiter(others, int))
    if not made:
        return pa.array([], _TYPE)
    order = np.empty(n, np.int64)
    order[np.concatenate(rows)] = np.arange(n)
    return pa.concat_arrays(made).take(pa.array(order))


def _each(f: Callable[[Shape], object], a: _Batch, rows: np.ndarray) -> dict[int, object]:
    return {int(k): None if (x := a[k]) is None else f(x) for k in rows}


def _each_pair(f: Callable[[Shape, Shape], object], a: _Batch, b: _Batch, rows: np.ndarray) -> dict[int, object]:
    return {int(k): None if (x := a[k]) is None or (y := b[k]) is None else f(x, y) for k in rows}


def _values(n: int, known: np.ndarray, found: np.ndarray, others: dict[int, object], kind: pa.DataType) -> pa.Array:
    """A column of found where known, else of others."""
    if found.dtype != object and all(v is None for v in others.values()):
        return pa.array(found, kind, mask=~known)
    out = np.full(n, None, object)
    out[known] = found[known]
    for k, v in others.items():
        out[k] = v
    return pa.array(out, kind)


def _box_pairs(a: _Batch, b: _Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of two boxes, and their bounds."""
    (p, x), (q, y) = a.boxes(), b.boxes()
    rows = np.flatnonzero(p & q)
    return rows, x[rows], y[rows]


def _marked(n: int, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[rows] = True
    return out


def relation(a: Column, b: Column) -> Column:
    """Bits of shapes.NAMES. Boxes are compared by the order of their sides, all of a batch at once."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = _Batch(a), _Batch(b)
        rows, p, q = _box_pairs(x, y)
        bits, ok = shapes.relate_boxes(p, q)
        done, found = _marked(len(x), rows[ok]), np.zeros(len(x), np.int32)
        found[rows] = bits
        return _values(len(x), done, found, _each_pair(shapes.relate, x, y, np.flatnonzero(~done)), pa.int32())

    return F.arrow_udf(run, "int")(a, b)  # made when used: it needs a session


def _of_two(f: Callable[[Shape, Shape], object], kind: pa.DataType, name: str) -> Callable[[Column, Column], Column]:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = _Batch(a), _Batch(b)
        return pa.array(list(_each_pair(f, x, y, np.arange(len(x))).values()), kind)

    return lambda a, b: F.arrow_udf(run, name)(a, b)


def is_simple(g: Column) -> Column:
    """See shapes.is_simple. Areas, single points and segments are."""

    def run(a: pa.Array) -> pa.Array:
        x = _Batch(a)
        done = x.known & x.of_kind(("POLYGON", "MULTIPOLYGON", "POINT"))
        return _values(len(x), done, np.ones(len(x), bool), _each(shapes.is_simple, x, np.flatnonzero(~done)), pa.bool_())

    return F.arrow_udf(run, "boolean")(g)


PAIRS_AT_ONCE = 4_000_000
BYTES_AT_ONCE = 1 << 30


def is_valid(g: Column) -> Column:
    """See shapes.is_valid. Polygons of one form and few edges are looked at together, and one by one where that leaves a doubt."""

    def run(a: pa.Array) -> pa.Array:
        x = _Batch(a)
        done = np.zeros(len(x), bool)
        for _, sizes, rows, xy in x.forms("POLYGON", "MULTIPOLYGON"):
            if min(sizes) > 3 and sum(sizes) <= 32:
                step = max(1, PAIRS_AT_ONCE // sum(sizes))
                for k in range(0, len(rows), step):
                    done[rows[k : k + step]] = shapes.surely_valid(xy[k : k + step], sizes)
        return _values(len(x), done, done, _each(shapes.is_valid, x, np.flatnonzero(~done)), pa.bool_())

    return F.arrow_udf(run, "boolean")(g)


def to_wkb(g: Column) -> Column:
    """Little-endian well-known binary. Shapes of one form are written together."""

    def run(a: pa.Array) -> pa.Array:
        x = _Batch(a)
        done, made = [], []
        for kind, sizes, rows, xy in x.forms(*shapes.DIMENSION):
            raw, places = shapes.wkb_layout(kind, [sizes])
            step = max(1, BYTES_AT_ONCE // len(raw))
            for k in range(0, len(rows), step):
                lines = np.tile(raw, (len(rows[k : k + step]), 1))
                lines[:, places] = np.ascontiguousarray(xy[k : k + step], "<f8").reshape(len(lines), -1).view(np.uint8)
                ends = np.arange(len(lines) + 1, dtype=np.int32) * len(raw)
                made.append(pa.Array.from_buffers(pa.binary(), len(lines), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(lines)]))
            done.append(rows)
        others = _each(shapes.to_wkb, x, np.flatnonzero(~_marked(len(x), np.concatenate([np.zeros(0, int), *done]))))
        order = np.empty(len(x), np.int64)
        order[np.concatenate([np.zeros(0, int), *done, np.fromiter(others, int)])] = np.arange(len(x))
        return pa.concat_arrays([*made, pa.array(list(others.values()), pa.binary())]).take(pa.array(order))

    return F.arrow_udf(run, "binary")(g)


CHARACTERS_AT_ONCE, NUMBERS_AT_ONCE = 4_000_000, 1_000_000


def _read(text: Column, read: Callable[[str], Shape], plainly: Callable[[Column], Column]) -> Column:
    """Texts that `read` takes and that share their form are read together; all others plainly, inside the JVM."""

    def run(a: pa.Array) -> pa.Array:
        values = a.to_pylist()
        rows = [k for k, v in enumerate(values) if v is not None and len(v) <= CHARACTERS_AT_ONCE // 4]
        cut = np.cumsum([0, *[len(values[k]) for k in rows]])[:-1] // CHARACTERS_AT_ONCE
        blocks, left = [], _marked(len(values), np.arange(len(values)))
        for some in np.split(np.array(rows, int), np.flatnonzero(np.diff(cut)) + 1):
            for at, kind, sizes, xy in shapes.from_texts([values[k] for k in some], read)[0]:
                sure = (np.isfinite(xy) & ((xy != 0) | ~np.signbit(xy))).all((1, 2))  # others depend on who reads them
                blocks.append((some[at[sure]], kind, sizes, xy[sure]))
                left[some[at[sure]]] = False
        return _column(len(values), blocks, dict.fromkeys(map(int, np.flatnonzero(left))))

    return F.coalesce(F.arrow_udf(run, GEOMETRY)(text), plainly(text))


def read_wkt(text: Column) -> Column:
    """As `from_wkt`, for many rows: texts that differ in their numbers only are read a batch at a time. Not for use inside lambdas."""
    return _read(text, shapes.from_plain_wkt, from_wkt)


def read_geojson(text: Column) -> Column:
    """As `from_geojson`, for many rows."""
    return _read(text, shapes.from_plain_geojson, from_geojson)


def write_wkt(g: Column) -> Column:
    """As `to_wkt`, for many rows: single shapes of one form are written together if their numbers are plain, the others inside the JVM."""

    def run(a: pa.Array) -> pa.Array:
        x = _Batch(a)
        out = np.full(len(x), None, object)
        for kind, sizes, rows, xy in x.forms(*shapes.DIMENSION):
            if min(sizes, default=0) > 0 and (len(sizes) == 1 or shapes.DIMENSION[kind] == 2):
                step = max(1, NUMBERS_AT_ONCE // (2 * sum(sizes)))
                for k in range(0, len(rows), step):
                    out[rows[k : k + step]] = shapes.to_texts(kind, [sizes], xy[k : k + step], shapes.sure_number)
        return pa.array(out, pa.string())

    return F.coalesce(F.arrow_udf(run, "string")(g), to_wkt(g))


distance = _of_two(shapes.distance, pa.float64(), "double")


def relates(a: Column, b: Column, how: str) -> Column:
    """One of shapes.NAMES, or disjoint. Ask for `relation` once where several are wanted, and test its bits."""
    return has(relation(a, b), how)


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether the envelopes meet: a filter inside the JVM before the exact comparison of all relations but disjoint."""
    x, y = envelope(a), envelope(b)
    return (x["min_x"] <= y["max_x"]) & (y["min_x"] <= x["max_x"]) & (x["min_y"] <= y["max_y"]) & (y["min_y"] <= x["max_y"])


def has(bits: Column, how: str) -> Column:
    return (bits == 0) if how == "disjoint" else bits.bitwiseAND(F.lit(shapes.NAMES[how])) != 0


def dwithin(a: Column, b: Column, d: float) -> Column:
    return distance(a, b) <= d


def _shape_of(f: Callable[[Shape], Shape], g: Column) -> Column:
    def run(a: pa.Array) -> pa.Array:
        x = _Batch(a)
        return _column(len(x), [], _each(f, x, np.arange(len(x))))

    return F.arrow_udf(run, GEOMETRY)(g)


FORMS_AT_ONCE = 16


def from_wkb(raw: Column) -> Column:
    """Well-known binary of either byte order. Bytes that differ in their coordinates only are read together, for the first forms of a batch."""

    def run(a: pa.Array) -> pa.Array:
        values = a.to_pylist()
        size = np.array([-1 if v is None else len(v) for v in values], int)
        others: dict[int, Shape | None] = dict.fromkeys(map(int, np.flatnonzero(size < 0)))
        blocks, left, tried = [], [np.flatnonzero(size == n) for n in np.unique(size[size >= 0])], 0
        while left:
            rows = left.pop()
            first = shapes.from_wkb(values[rows[0]])
            alike = np.zeros(len(rows), bool)
            if tried < FORMS_AT_ONCE and len(rows) > 3 and first.parts and shapes.to_wkb(first) == values[rows[0]]:
                tried += 1
                sizes = [[len(r) for r in part] for part in first.parts]
                layout, places = shapes.wkb_layout(first.kind, sizes)
                lines = np.frombuffer(b"".join(values[k] for k in rows), np.uint8).reshape(len(rows), -1)
                xy = np.ascontiguousarray(lines[:, places]).view("<f8").astype(float).reshape(len(rows), -1, 2)
                alike = (lines[:, ~places] == layout[~places]).all(1) & ~np.isnan(xy).any((1, 2))
                blocks.append((rows[alike], first.kind, sizes, xy[alike]))
            if alike.any():
                left += [rows[~alike]] if not alike.all() else []
            else:
                others |= {int(k): shapes.from_wkb(values[k]) for k in rows}
        return _column(len(values), blocks, others)

    return F.arrow_udf(run, GEOMETRY)(raw)


def combine(a: Column, b: Column, how: str) -> Column:
    """intersection, union, difference or symdifference of two areas; intersection and difference of points or lines with an area.

    Boxes are combined by the order of their sides, all of a batch with the same order at once.
    """

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = _Batch(a), _Batch(b)
        rows, p, q = _box_pairs(x, y)
        blocks, ok = shapes.combine_boxes(p, q, how)
        rest = np.flatnonzero(~_marked(len(x), rows[ok]))
        return _column(len(x), [(rows[at], *block) for at, *block in blocks], _each_pair(lambda u, v: shapes.combine(u, v, how), x, y, rest))

    return F.arrow_udf(run, GEOMETRY)(a, b)


def overlay_areas(a: Column, b: Column) -> Column:
    """struct of the area of every overlay of two areas (see `combine`), by name. Shapes are made and measured within the batch: only numbers go back."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = _Batch(a), _Batch(b)
        rows, p, q = _box_pairs(x, y)
        out = []
        for how in shapes.KEEP:
            blocks, ok = shapes.combine_boxes(p, q, how)
            found, done = np.zeros(len(x)), _marked(len(x), rows[ok])
            for at, _, sizes, xy in blocks:
                found[rows[at]] = shapes.areas(sizes, xy)
            rest = _each_pair(lambda u, v, how=how: shapes.area(shapes.combine(u, v, how)), x, y, np.flatnonzero(~done))
            out.append(_values(len(x), done, found, rest, pa.float64()))
        return pa.StructArray.from_arrays(out, names=list(shapes.KEEP))

    return F.arrow_udf(run, f"struct<{', '.join(f'{how}: double' for how in shapes.KEEP)}>")(a, b)


def buffer(g: Column, d: float, quarter: int = 8) -> Column:
    """See shapes.buffer. Points, segments, and boxes taken in are done together."""

    def run(a: pa.Array) -> pa.Array:
        x = _Batch(a)
        done, blocks = np.zeros(len(x), bool), []

        def put(rows: np.ndarray, xy: np.ndarray) -> None:
            blocks.append((rows, "POLYGON", [[xy.shape[1]]], xy))
            done[rows] = True

        if d > 1e-3:
            for kind, sizes, rows, xy in x.forms("POINT", "LINESTRING"):
                fit = np.isfinite(xy).all((1, 2)) & (np.abs(xy) < 1e6).all((1, 2))
                if kind == "POINT" and sizes == [1]:
                    put(rows[fit], shapes.buffer_points(xy[fit, 0], d, quarter))
                elif kind == "LINESTRING" and sizes == [2]:
                    found, ok = shapes.buffer_segments(xy[fit, 0], xy[fit, 1], d, quarter)
                    put(rows[fit][ok], found)
        elif d < -1e-3:
            ok, bounds = x.boxes()
            rows = np.flatnonzero(ok)
            found, some, sure = shapes.shrink_boxes(bounds[rows], -d)
            put(rows[some], found)
            none = rows[sure & ~some]
            blocks.append((none, "MULTIPOLYGON", [], np.zeros((len(none), 0, 2))))
            done[none] = True
        return _column(len(x), [b for b in blocks if len(b[0])], _each(lambda s: shapes.buffer(s, d, quarter), x, np.flatnonzero(~done)))

    return F.arrow_udf(run, GEOMETRY)(g)


def convex_hull(g: Column) -> Column:
    return _shape_of(shapes.convex_hull, g)


def make_valid(g: Column) -> Column:
    return _shape_of(shapes.make_valid, g)


def delaunay(g: Column) -> Column:
    """The triangles of a geometry's points, as areas."""

    def triangles(s: Shape) -> Shape:
        p = np.unique(s.points, axis=0)
        return Shape("MULTIPOLYGON", [[p[[*t, t[0]]]] for t in shapes.delaunay(p)])

    return _shape_of(triangles, g)


def voronoi(g: Column, box: tuple[float, float, float, float]) -> Column:
    """The cells of a geometry's points inside the box, as areas."""

    def cells(s: Shape) -> Shape:
        found = [c for c in shapes.voronoi(np.unique(s.points, axis=0), box) if len(c) > 2]
        return Shape("MULTIPOLYGON", [[np.concatenate([c, c[:1]])] for c in found])

    return _shape_of(cells, g)


def union_aggregate(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column): the union of every group's areas, equal ones once, of unions in each task, so a group isn't gathered but as what its parts make."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partly(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                got = shapes.united([shapes.from_wkb(w) for w in rows["_wkb"]])
                out.append((*(key if isinstance(key, tuple) else (key,)), shapes.to_wkb(got)))
            yield pd.DataFrame(out, columns=[*keys, "_wkb"])

    def wholly(rows: pd.DataFrame) -> pd.DataFrame:
        got = shapes.united([shapes.from_wkb(w) for w in rows["_wkb"]])
        return pd.DataFrame([{**rows[keys].iloc[0].to_dict(), "_wkb": shapes.to_wkb(got)}])

    areas = df.where(F.col(column).isNotNull() & _is_area(F.col(column))).select(*keys, column).distinct()
    parts = areas.select(*keys, to_wkb(F.col(column)).alias("_wkb")).mapInPandas(partly, f"{kinds}, _wkb binary")
    return parts.groupBy(*keys).applyInPandas(wholly, f"{kinds}, _wkb binary").select(*keys, from_wkb(F.col("_wkb")).alias(column))


def spatial_join(left: DataFrame, right: DataFrame, cell: float, how: str = "intersects", column: str = "geometry", other: str = "geometry") -> DataFrame:
    """Pairs whose geometries relate as `how` says (not disjoint), right's columns with the prefix other_.

    Each geometry goes to the cells of side `cell` that its envelope meets; a pair is compared in one
    of them, that of the lower corner of the envelopes' common part. Choose a cell of about the size
    of the larger geometries: those of many cells are copied to all of them.
    """

    sides = ("min_x", "min_y", "max_x", "max_y")

    def placed(df: DataFrame, g: str, tag: str) -> DataFrame:
        """The bounds as plain columns, made once by a generator, and a row for each cell; _fx and _fy are the first cells."""
        known = df.where(F.col(g).isNotNull() & ~is_empty(F.col(g)))
        boxed = known.select("*", is_box(F.col(g)).alias(f"_is{tag}"), F.inline(F.array(envelope(F.col(g)))).alias(*[f"_{c}{tag}" for c in sides]))
        at = lambda c: F.floor(F.col(f"_{c}{tag}") / cell)
        rows = boxed.select("*", at("min_x").alias(f"_fx{tag}"), at("min_y").alias(f"_fy{tag}"), F.explode(F.sequence(at("min_x"), at("max_x"))).alias("_cx"))
        return rows.select("*", F.explode(F.sequence(F.col(f"_fy{tag}"), at("max_y"))).alias("_cy"))

    a, b = placed(left, column, "_a"), placed(right.select(*[F.col(c).alias(f"other_{c}") for c in right.columns]), f"other_{other}", "_b")
    c = F.col
    meet = (c("_min_x_a") <= c("_max_x_b")) & (c("_min_x_b") <= c("_max_x_a")) & (c("_min_y_a") <= c("_max_y_b")) & (c("_min_y_b") <= c("_max_y_a"))
    first = (c("_cx") == F.greatest("_fx_a", "_fx_b")) & (c("_cy") == F.greatest("_fy_a", "_fy_b"))
    kept = [*left.columns, *[f"other_{c}" for c in right.columns]]
    candidates = lambda a, b: a.join(b, ["_cx", "_cy"]).where(meet & first).select(*kept)
    exact = relates(F.col(column), F.col(f"other_{other}"), how)
    if how != "intersects":
        return candidates(a, b).where(exact)
    rest = candidates(a, b.where(~F.col("_is_b"))).unionByName(candidates(a.where(~F.col("_is_a")), b.where("_is_b")))
    return candidates(a.where("_is_a"), b.where("_is_b")).unionByName(rest.where(exact))  # boxes intersect where their envelopes meet
