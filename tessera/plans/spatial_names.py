"""Spatial functions by name in query texts, where a geometry is WKT text.

`register` makes ST_* functions for SQL; `cypher` and `aql` rewrite those languages' own names to
them. Points of Cypher are structs of x, y and srid (4326 where they are given by longitude and
latitude, whose distance is on the sphere).
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import shapes
from tessera.functions.shapes import Shape, from_wkt, to_wkt
from tessera.functions.spatial import EARTH_M

_done: set[str] = set()


def _line(ring: np.ndarray) -> str:
    return to_wkt(Shape("LINESTRING", [[ring]]))


def _length(s: Shape) -> float:
    e = s.edges()
    return float(np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]).sum())


def _centroid(s: Shape) -> str:
    if s.dimension == 2:
        e = np.concatenate([Shape("POLYGON", [[r if (shapes.ring_area(r) > 0) == (k == 0) else r[::-1]]]).edges() for part in s.parts for k, r in enumerate(part)])
        w = e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]
        at = ((e[:, :2] + e[:, 2:]) * w[:, None]).sum(0) / (3 * w.sum())
    elif s.dimension == 1:
        e = s.edges()
        w = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
        at = (shapes.middles(e) * w[:, None]).sum(0) / w.sum()
    else:
        at = s.points.mean(0)
    return to_wkt(Shape("POINT", [[at[None]]]))


def _envelope(s: Shape) -> str:
    (a, b), (c, d) = s.points.min(0), s.points.max(0)
    return to_wkt(Shape("POLYGON", [[np.array([[a, b], [c, b], [c, d], [a, d], [a, b]])]]))


def _sphere(a: Shape, b: Shape) -> float:
    (x1, y1), (x2, y2) = np.radians(a.points[0]), np.radians(b.points[0])
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def _nested(kind: str) -> Callable[[str], str]:
    def make(text: str) -> str:
        tree = json.loads(text)
        ring = lambda r: np.array(r, float).reshape(-1, 2)
        parts = {
            "MULTIPOINT": lambda: [[ring([p])] for p in tree], "LINESTRING": lambda: [[ring(tree)]], "MULTILINESTRING": lambda: [[ring(r)] for r in tree],
            "POLYGON": lambda: [[ring(r) for r in (tree if isinstance(tree[0][0], list) else [tree])]], "MULTIPOLYGON": lambda: [[ring(r) for r in part] for part in tree],
        }[kind]()
        return to_wkt(Shape(kind, parts))

    return make


ONE: dict[str, tuple[Callable[[Shape], object], str]] = {
    "st_area": (shapes.area, "double"), "st_length": (_length, "double"), "st_perimeter": (_length, "double"), "st_centroid": (_centroid, "string"), "st_envelope": (_envelope, "string"),
    "st_convexhull": (lambda s: to_wkt(shapes.convex_hull(s)), "string"), "st_isvalid": (shapes.is_valid, "boolean"), "st_issimple": (shapes.is_simple, "boolean"),
    "st_isempty": (lambda s: not s.parts, "boolean"), "st_makevalid": (lambda s: to_wkt(shapes.make_valid(s)), "string"), "st_geometrytype": (lambda s: s.kind, "string"),
    "st_npoints": (lambda s: len(s.points), "int"), "st_numgeometries": (lambda s: len(s.parts), "int"), "st_x": (lambda s: float(s.points[0][0]), "double"), "st_y": (lambda s: float(s.points[0][1]), "double"),
    "st_exteriorring": (lambda s: _line(s.parts[0][0]) if s.kind == "POLYGON" else None, "string"), "st_numinteriorrings": (lambda s: len(s.parts[0]) - 1 if s.kind == "POLYGON" else None, "int"),
    "st_startpoint": (lambda s: to_wkt(Shape("POINT", [[s.points[:1]]])), "string"), "st_endpoint": (lambda s: to_wkt(Shape("POINT", [[s.points[-1:]]])), "string"),
    "st_asbinary": (shapes.to_wkb, "binary"), "st_astext": (to_wkt, "string"),
}
TWO: dict[str, tuple[Callable[[Shape, Shape], object], str]] = {
    **{f"st_{n}": ((lambda bit: lambda a, b: bool(shapes.relate(a, b) & bit))(bit), "boolean") for n, bit in shapes.NAMES.items()},
    "st_disjoint": (lambda a, b: shapes.relate(a, b) == 0, "boolean"), "st_distance": (shapes.distance, "double"), "st_distance_sphere": (_sphere, "double"),
    **{f"st_{n}": ((lambda how: lambda a, b: to_wkt(shapes.combine(a, b, how)))(n), "string") for n in shapes.KEEP},
}
NUMBER: dict[str, tuple[Callable[[Shape, float], object], str]] = {
    "st_buffer": (lambda s, d: to_wkt(shapes.buffer(s, d)), "string"),
    "st_geometryn": (lambda s, n: to_wkt(Shape(shapes.single(s.kind), [s.parts[int(n) - 1]])) if 0 < n <= len(s.parts) else None, "string"),
    "st_pointn": (lambda s, n: to_wkt(Shape("POINT", [[s.points[int(n) - 1 : int(n)]]])) if 0 < n <= len(s.points) else None, "string"),
    "st_interiorringn": (lambda s, n: _line(s.parts[0][int(n)]) if s.kind == "POLYGON" and 0 < n < len(s.parts[0]) else None, "string"),
}


def _boxes_or_each(of_boxes: Callable, f: Callable[[Shape, Shape], object]) -> Callable[[list, list], list]:
    """A function of two lists of shapes: pairs of boxes together, the others one by one."""

    def run(a: list[Shape | None], b: list[Shape | None]) -> list:
        (p, x), (q, y) = shapes.boxed(a), shapes.boxed(b)
        rows = np.flatnonzero(p & q)
        out = dict(zip(rows.tolist(), of_boxes(x[rows], y[rows])))
        return [None if u is None or v is None else out[k] if out.get(k, _OPEN) is not _OPEN else f(u, v) for k, (u, v) in enumerate(zip(a, b))]

    return run


_OPEN = object()


def _related(test: Callable[[int], bool]) -> Callable[[list, list], list]:
    def of_boxes(x: np.ndarray, y: np.ndarray) -> list:
        return [test(n) if ok else _OPEN for n, ok in zip(*(v.tolist() for v in shapes.relate_boxes(x, y)))]

    return _boxes_or_each(of_boxes, lambda a, b: test(shapes.relate(a, b)))


def _combined(how: str) -> Callable[[list, list], list]:
    def of_boxes(x: np.ndarray, y: np.ndarray) -> list:
        out = [_OPEN] * len(x)
        for rows, kind, sizes, xy in shapes.combine_boxes(x, y, how)[0]:
            for k, text in zip(rows.tolist(), shapes.to_texts(kind, sizes, xy)):
                out[k] = text
        return out

    return _boxes_or_each(of_boxes, lambda a, b: to_wkt(shapes.combine(a, b, how)))


#: Functions of two geometries that have a way for many pairs at once.
MANY: dict[str, Callable[[list, list], list]] = {
    **{f"st_{n}": _related((lambda bit: lambda n: bool(n & bit))(bit)) for n, bit in shapes.NAMES.items()},
    "st_disjoint": _related(lambda n: n == 0), **{f"st_{how}": _combined(how) for how in shapes.KEEP},
}


def _read(texts: pd.Series) -> list[Shape | None]:
    """Shapes of texts; a text that repeats in the batch is read once, and those that differ in their numbers only together."""
    codes, kinds = pd.factorize(texts)
    kinds = list(kinds)
    found: list[Shape | None] = [None] * len(kinds)
    blocks, rest = shapes.from_texts(kinds)
    for rows, *block in blocks:
        for k, s in zip(rows.tolist(), shapes.shapes_of(*block)):
            found[k] = s
    for k in rest:
        found[k] = from_wkt(kinds[k])
    return [None if c < 0 else found[c] for c in codes.tolist()]


def _areas(texts: pd.Series) -> pd.Series:
    """st_area of texts, those that differ in their numbers only together."""
    codes, kinds = pd.factorize(texts)
    kinds = list(kinds)
    found = np.zeros(len(kinds) + 1)
    blocks, rest = shapes.from_texts(kinds)
    for rows, kind, sizes, xy in blocks:
        found[rows] = shapes.areas(sizes, xy) if shapes.DIMENSION[kind] == 2 else 0.0
    for k in rest:
        found[k] = shapes.area(from_wkt(kinds[k]))
    return pd.Series(found[codes]).astype(object).where(codes >= 0, None)


def register(spark: SparkSession) -> None:
    """The functions above in this session, once."""
    if spark.sparkContext.applicationId + str(id(spark._jsparkSession)) in _done:
        return
    for name, (f, kind) in ONE.items():
        spark.udf.register(name, F.pandas_udf(_areas, kind) if name == "st_area" else _of_one(f, kind))
    for name, (f, kind) in TWO.items():
        spark.udf.register(name, _of_two(MANY.get(name) or _one_by_one(f), kind))
    for name, (f, kind) in NUMBER.items():
        spark.udf.register(name, _of_number(f, kind))
    for kind in ("MULTIPOINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON"):
        spark.udf.register(f"geo_make_{kind.lower()}", _of_text(_nested(kind)))
    _done.add(spark.sparkContext.applicationId + str(id(spark._jsparkSession)))


def _one_by_one(f: Callable) -> Callable[[list, list], list]:
    return lambda a, b: [None if u is None or v is None else f(u, v) for u, v in zip(a, b)]


def _of_one(f: Callable, kind: str) -> Callable:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else f(s) for s in _read(a)], dtype=object)

    return F.pandas_udf(run, kind)


def _of_two(f: Callable[[list, list], list], kind: str) -> Callable:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(_read(a), _read(b)), dtype=object)

    return F.pandas_udf(run, kind)


def _of_number(f: Callable, kind: str) -> Callable:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or v is None or v != v else f(s, float(v)) for s, v in zip(_read(a), b)], dtype=object)

    return F.pandas_udf(run, kind)


def _of_text(f: Callable) -> Callable:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a], dtype=object)

    return F.pandas_udf(run, "string")


def _calls(text: str, name: str, make: Callable[[list[str]], str]) -> str:
    """Every call of a function in a query text, its arguments given to `make`."""
    from tessera.plans.cypher import split_top

    out, at = "", 0
    for m in re.finditer(rf"(?<![\w.]){name}\s*\(", text, re.I):
        if m.start() < at:
            continue
        depth, k = 1, m.end()
        while depth and k < len(text):
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            k += 1
        out += text[at : m.start()] + make([_calls(a, name, make) for a in split_top(text[m.end() : k - 1])])
        at = k
    return out + text[at:]


def _cypher_point(args: list[str]) -> str:
    from tessera.plans.cypher import split_top

    given = {k.strip().lower(): v.strip() for k, v in (p.split(":", 1) for p in split_top(args[0].strip()[1:-1]))}
    round_ = "longitude" in given
    x, y = (given["longitude"], given["latitude"]) if round_ else (given["x"], given["y"])
    return f"named_struct('x', double({x}), 'y', double({y}), 'srid', {4326 if round_ else 7203})"


def _cypher_distance(args: list[str]) -> str:
    p, q = args
    flat = f"sqrt(({p}.x - {q}.x) * ({p}.x - {q}.x) + ({p}.y - {q}.y) * ({p}.y - {q}.y))"
    h = f"pow(sin(radians({q}.y - {p}.y) / 2), 2) + cos(radians({p}.y)) * cos(radians({q}.y)) * pow(sin(radians({q}.x - {p}.x) / 2), 2)"
    return f"(CASE WHEN {p}.srid = 4326 THEN {2 * EARTH_M} * asin(least(1.0D, sqrt({h}))) ELSE {flat} END)"


def cypher(text: str) -> str:
    """Cypher's spatial functions: point and distance as expressions, the rest as ST_* over WKT."""
    text = _calls(text, "point", _cypher_point)
    text = _calls(text, r"(?:point\.)?distance", _cypher_distance)
    for ours in ("intersects", "contains", "within", "overlaps", "touches", "crosses", "disjoint"):
        text = _calls(text, ours, lambda a, f=ours: f"st_{f}({', '.join(a)})")
    for theirs, ours in (("bbox", "st_envelope"), ("centroid", "st_centroid"), ("buffer", "st_buffer"), ("convex_hull", "st_convexhull")):
        text = _calls(text, theirs, lambda a, f=ours: f"{f}({', '.join(a)})")
    return text


def uses(text: str) -> bool:
    """Whether a query text may call one of these functions."""
    return bool(re.search(r"\b(point|distance|intersects|contains|within|overlaps|touches|crosses|disjoint|bbox|centroid|buffer|convex_hull|st_\w+|GEO_\w+)\s*\(", text, re.I))


def aql(text: str) -> str:
    """AQL's GEO_* functions over WKT; coordinates are [longitude, latitude] and distances metres on the sphere."""
    text = _calls(text, "GEO_POINT", lambda a: f"concat('POINT(', {a[0]}, ' ', {a[1]}, ')')")
    for kind in ("MULTIPOINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON"):
        text = _calls(text, f"GEO_{kind}", lambda a, k=kind: f"'{_nested(k)(a[0])}'" if a[0].lstrip().startswith("[") else f"geo_make_{k.lower()}(to_json({a[0]}))")
    for theirs, ours in (("GEO_DISTANCE", "st_distance_sphere"), ("GEO_AREA", "st_area"), ("GEO_LENGTH", "st_length"), ("GEO_CONTAINS", "st_contains"), ("GEO_INTERSECTS", "st_intersects"), ("GEO_EQUALS", "st_equals"), ("GEO_CENTROID", "st_centroid"), ("GEO_BUFFER", "st_buffer")):
        text = _calls(text, theirs, lambda a, f=ours: f"{f}({', '.join(a)})")
    return _calls(text, "GEO_IN_RANGE", lambda a: f"(st_distance_sphere({a[0]}, {a[1]}) BETWEEN {a[2]} AND {a[3]})")
