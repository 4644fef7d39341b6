"""Scalar functions whose rules differ from Spark's own; the rest are `pyspark.sql.functions` as they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division, truncated towards zero; null for a divisor of 0."""
    return F.when(b != 0, F.try_divide(a - F.try_mod(a, b), b).cast("long"))


def substring(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start below 1 counts as 1; past the end gives ''."""
    first = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    size = F.length(s) if length is None else F.greatest(F.lit(length) if isinstance(length, int) else length, F.lit(0))
    return F.substring(s, first, size)


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / the longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similar_to(s: Column, pattern: str) -> Column:
    """SIMILAR TO: % and _ as in LIKE, the rest of SQL's regular expressions, over the whole text."""
    out, inside, k = "", False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out += pattern[k : k + 2]
            k += 2
            continue
        inside = (inside or c == "[") and c != "]"
        out += c if inside else {"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c)
        k += 1
    return s.rlike(f"(?s)^(?:{out})$")


def day_of_week(d: Column) -> Column:
    """0 for Sunday."""
    return F.dayofweek(d) - 1


def slice_1(a: Column, start: int, end: int) -> Column:
    """Elements start..end (1-based, both included); out of range gives what there is."""
    return F.slice(a, max(start, 1), max(0, end - max(start, 1) + 1))


def element(a: Column, index: Column | int) -> Column:
    """1-based; null out of range."""
    return F.get(a, (F.lit(index) if isinstance(index, int) else index) - 1)


def contains_all(a: Column, b: Column) -> Column:
    """a @> b on arrays."""
    return F.size(F.array_except(b, a)) == 0
