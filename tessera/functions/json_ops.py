"""JSON text columns: path access, key tests, containment, merging and deleting, validation.

Malformed text gives null. Paths are dotted: a.b[0].
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_PLAIN = "map<string,string>"


def path(doc: Column, dotted: str) -> Column:
    """`->>` and `#>>`: the value at a path as text, null if missing."""
    return F.get_json_object(doc, "$" + ("" if dotted.startswith("[") else ".") + dotted)


def has_key(doc: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(doc), key)


def has_any_key(doc: Column, keys: Sequence[str]) -> Column:
    return F.arrays_overlap(F.json_object_keys(doc), F.array(*map(F.lit, keys)))


def has_all_keys(doc: Column, keys: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, keys)), F.json_object_keys(doc))) == 0


def merge(a: Column, b: Column) -> Column:
    """`||` on objects of plain values: keys of b win. Values keep their text; nested values become strings."""
    left = F.map_filter(F.from_json(a, _PLAIN), lambda k, _: ~F.coalesce(F.array_contains(F.json_object_keys(b), k), F.lit(False)))
    return F.to_json(F.map_concat(left, F.from_json(b, _PLAIN)))


def delete_key(doc: Column, key: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(doc, _PLAIN), lambda k, _: k != key))


def _within(small, big) -> bool:
    if isinstance(small, dict):
        return isinstance(big, dict) and all(k in big and _within(v, big[k]) for k, v in small.items())
    if isinstance(small, list):
        return isinstance(big, list) and all(any(_within(v, w) for w in big) for v in small)
    return type(small) is type(big) and small == big or isinstance(small, int | float) and isinstance(big, int | float) and small == big and not isinstance(small, bool) and not isinstance(big, bool)


def _loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _at(keys: Sequence[str]) -> str | None:
    """A variant's path to nested keys, if they can be written there."""
    return None if any("'" in k or "\\" in k for k in keys) else "$" + "".join(f"['{k}']" for k in keys)


def _typed(doc: Column, at: str) -> tuple[Column, Column]:
    """The value at a path as a variant, and the name of its type."""
    value = F.try_variant_get(F.try_parse_json(doc), at, "variant")
    return value, F.schema_of_variant(value)


def _is(kind_: Column, wanted: str) -> Column:
    number = kind_.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    tests = {
        "object": kind_.startswith("OBJECT"), "array": kind_.startswith("ARRAY"), "string": kind_ == "STRING", "boolean": kind_ == "BOOLEAN", "null": kind_ == "VOID",
        "number": number,
    }
    return tests[wanted]


def _holds(doc: Column, keys: tuple[str, ...], part) -> Column | None:
    """Whether the document holds a constant without arrays at nested keys, inside the JVM; None if that can't be said there."""
    at = _at(keys)
    if at is None or isinstance(part, list):
        return None
    value, kind_ = _typed(doc, at)
    if isinstance(part, dict):
        out = _is(kind_, "object")
        for k, v in part.items():
            inner = _holds(doc, (*keys, k), v)
            if inner is None:
                return None
            out = out & inner
        return out
    if part is None:
        return _is(kind_, "null")
    if isinstance(part, bool):
        return _is(kind_, "boolean") & (F.try_variant_get(value, "$", "boolean") == part)
    if isinstance(part, str):
        return _is(kind_, "string") & (F.try_variant_get(value, "$", "string") == part)
    return _is(kind_, "number") & (F.try_variant_get(value, "$", "double") == float(part)) if abs(part) < 1 << 53 else None


def contains(doc: Column, part: Column | str) -> Column:
    """`@>`: recursive for objects; an array holds another if each of its items is in some item.

    A part given as text that has no arrays is compared inside the JVM.
    """
    if isinstance(part, str):
        inside = _holds(doc, (), json.loads(part))
        if inside is not None:
            return F.when(doc.isNotNull(), F.coalesce(inside, F.lit(False)))
        part = F.lit(part)

    @pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _within(_loads(y), _loads(x)) for x, y in zip(a, b)], dtype=object)

    return run(doc, part)


def _meeting(doc: Column, keys: tuple[str, ...], schema: dict) -> Column | None:
    """As _check, inside the JVM, of the value at nested keys; None for schemas of arrays' items."""
    at = _at(keys)
    if at is None or "items" in schema or any("'" in k or "\\" in k for k in schema.get("properties", {})):
        return None
    value, kind_ = _typed(doc, at)
    out = _is(kind_, {"integer": "number"}.get(schema["type"], schema["type"])) if "type" in schema else F.lit(True)
    if schema.get("type") == "integer":  # a variant doesn't tell 1.0 from 1
        out = out & F.get_json_object(doc, at).rlike(r"^-?\d+$")
    known, names = schema.get("properties", {}), F.json_object_keys(F.get_json_object(doc, at) if keys else doc)
    lacks = F.lit(False)
    if schema.get("required"):
        lacks = lacks | (F.size(F.array_except(F.array(*map(F.lit, schema["required"])), names)) > 0)
    if schema.get("additionalProperties") is False:
        lacks = lacks | (F.size(F.array_except(names, F.array(*map(F.lit, known)).cast("array<string>"))) > 0)
    out = out & ~(_is(kind_, "object") & lacks)
    for k, s in known.items():
        inner = _meeting(doc, (*keys, k), s)
        if inner is None:
            return None
        there = F.coalesce(_is(kind_, "object") & F.array_contains(names, k), F.lit(False))
        out = out & (~there | F.coalesce(inner, F.lit(False)))
    for name, wanted, measure in (
        ("minItems", "array", lambda: F.json_array_length(F.to_json(value))), ("maxItems", "array", lambda: F.json_array_length(F.to_json(value))),
        ("minLength", "string", lambda: F.length(F.try_variant_get(value, "$", "string"))), ("maxLength", "string", lambda: F.length(F.try_variant_get(value, "$", "string"))),
        ("minimum", "number", lambda: F.try_variant_get(value, "$", "double")), ("maximum", "number", lambda: F.try_variant_get(value, "$", "double")),
    ):
        if name in schema:
            fits = measure() >= schema[name] if name.startswith("min") else measure() <= schema[name]
            out = out & (~_is(kind_, wanted) | fits)
    return out & ~_is(kind_, "null") if not keys else out


def _check(value, schema: dict) -> bool:
    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    if "type" in schema:
        kind = kinds[schema["type"]]
        if not isinstance(value, kind) or isinstance(value, bool) and schema["type"] in ("number", "integer"):
            return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", [])) or schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(_check(value[k], s) for k, s in known.items() if k in value)
    if isinstance(value, list):
        return schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) and all(_check(v, schema["items"]) for v in value if "items" in schema)
    if isinstance(value, str):
        return schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
    if isinstance(value, int | float) and not isinstance(value, bool):
        return schema.get("minimum", value) <= value <= schema.get("maximum", value)
    return True


def valid(doc: Column, schema: dict) -> Column:
    """Whether the document meets a JSON schema (type, required, properties, additionalProperties, items, bounds); inside the JVM but for schemas of arrays' items."""
    inside = _meeting(doc, (), schema)
    if inside is not None:
        return F.when(doc.isNotNull(), F.coalesce(inside, F.lit(False)))

    @pandas_udf("boolean")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (v := _loads(x)) is not None and _check(v, schema) for x in a], dtype=object)

    return run(doc)


def kind(doc: Column, dotted: str | None = None) -> Column:
    """typeof: object, array, string, number, boolean or null, of the document or of the value at a path."""
    t = F.schema_of_variant(F.variant_get(F.try_parse_json(doc), "$" + (f".{dotted}" if dotted else ""), "variant"))
    return F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.isNotNull(), "number")


_STEP = re.compile(r"\.\.(\w+|\*)|\.(\w+|\*)|\[\s*\?\s*\(\s*@\.?([\w.]*)\s*(?:(==|!=|<=|>=|<|>)\s*('[^']*'|\"[^\"]*\"|[\w.+-]+))?\s*\)\s*\]|\[\s*(-?\d*)\s*:\s*(-?\d*)\s*\]|\[\s*(-?\d+|\*|'[^']*'|\"[^\"]*\")\s*\]")


def parse_path(text: str) -> list[tuple]:
    """$.a.b, [0], [-1], [1:3], .*, [*], ..name, [?(@.x > 1)] as steps."""
    text = text.strip().removeprefix("$")
    steps, at = [], 0
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"can't read the path at {text[at:]!r}")
        deep, key, field, op, value, low, high, item = m.groups()
        if deep:
            steps.append(("deep", deep))
        elif key:
            steps.append(("any",) if key == "*" else ("key", key))
        elif field is not None:
            steps.append(("where", [p for p in field.split(".") if p], op, None if value is None else value[1:-1] if value[0] in "'\"" else json.loads(value)))
        elif item is not None:
            steps.append(("any",) if item == "*" else ("key", item[1:-1]) if item[0] in "'\"" else ("item", int(item)))
        else:
            steps.append(("slice", int(low) if low else None, int(high) if high else None))
        at = m.end()
    return steps


def _deep(value, name: str):
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        if name == "*" or k == name:
            yield v
        yield from _deep(v, name)


def _meets(value, fields: list[str], op: str | None, other) -> bool:
    for f in fields:
        if not isinstance(value, dict) or f not in value:
            return False
        value = value[f]
    if op is None:
        return True
    try:
        return {"==": value == other, "!=": value != other}[op] if op in ("==", "!=") else {"<": value < other, "<=": value <= other, ">": value > other, ">=": value >= other}[op]
    except TypeError:
        return False


def follow(value, steps: list[tuple]) -> list:
    """All values that the steps lead to; what is missing leads nowhere."""
    now = [value]
    for kind, *arg in steps:
        nxt = []
        for v in now:
            if kind == "key":
                nxt += [v[arg[0]]] if isinstance(v, dict) and arg[0] in v else []
            elif kind == "item":
                nxt += [v[arg[0]]] if isinstance(v, list) and -len(v) <= arg[0] < len(v) else []
            elif kind == "slice":
                nxt += v[arg[0] : arg[1]] if isinstance(v, list) else []
            elif kind == "any":
                nxt += list(v.values()) if isinstance(v, dict) else v if isinstance(v, list) else []
            elif kind == "deep":
                nxt += _deep(v, arg[0])
            else:
                nxt += [x for x in (v if isinstance(v, list) else [v]) if _meets(x, *arg)]
        now = nxt
    return now


def path_query(doc: Column, text: str) -> Column:
    """array<string> of the JSON of every value at a path with slices, wildcards, recursion or filters; null for malformed text."""
    steps = parse_path(text)

    @pandas_udf("array<string>")
    def run(a: pd.Series) -> pd.Series:
        parsed = a.map(_loads)
        return pd.Series([None if x is None or (v is None and x != "null") else [json.dumps(y, separators=(",", ":"), ensure_ascii=False) for y in follow(v, steps)] for x, v in zip(a, parsed)], dtype=object)

    return run(doc)


def delete_path(doc: Column, dotted: str) -> Column:
    """`#-`: the document without what is at the path; unchanged if there is nothing."""
    steps = parse_path("$" + ("" if dotted.startswith("[") else ".") + dotted)

    def without(v, rest):
        (kind, key), *more = rest
        if kind == "key" and isinstance(v, dict) and key in v:
            return {k: x for k, x in v.items() if k != key} if not more else v | {key: without(v[key], more)}
        if kind == "item" and isinstance(v, list) and -len(v) <= key < len(v):
            key %= len(v)
            return v[:key] + v[key + 1 :] if not more else [*v[:key], without(v[key], more), *v[key + 1 :]]
        return v

    @pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or (v := _loads(x)) is None else json.dumps(without(v, steps), separators=(",", ":"), ensure_ascii=False) for x in a], dtype=object)

    return run(doc)


def size(doc: Column) -> Column:
    """Items of an array, keys of an object, null for other values."""
    return F.coalesce(F.json_array_length(doc), F.size(F.json_object_keys(doc)))
