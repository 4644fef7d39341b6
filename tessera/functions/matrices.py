"""Matrices as array<array<double>> columns, rows first: expressions inside the JVM. Shapes that don't fit give null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def transpose(m: Column) -> Column:
    width = F.size(F.get(m, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(m, lambda row: F.get(row, j)))


def matmul(a: Column, b: Column) -> Column:
    columns = transpose(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    fits = F.size(F.get(a, F.lit(0))) == F.size(b)
    return F.when(fits, F.transform(a, lambda row: F.transform(columns, lambda col: dot(row, col))))


def elementwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    fits = (F.size(a) == F.size(b)) & (F.size(F.get(a, F.lit(0))) == F.size(F.get(b, F.lit(0))))
    return F.when(fits, F.zip_with(a, b, lambda x, y: F.zip_with(x, y, f)))


def add(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x + y)


def multiply(a: Column, b: Column) -> Column:
    return elementwise(a, b, lambda x, y: x * y)


def divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return elementwise(a, b, F.try_divide)


def scale(m: Column, by: Column | float) -> Column:
    return F.transform(m, lambda row: F.transform(row, lambda v: v * by))
