"""Relational operators that Spark's DataFrame API doesn't have by name.

Null rules are SQL's: a comparison with null is null and a filter keeps only true; null join keys
never match; sorts here always say where nulls go (last by default, as in the dialect served).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order(col: str | Column, descending: bool = False, nulls_first: bool = False) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def distinct_on(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The first row of each key by `by`."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def limit_with_ties(df: DataFrame, n: int, by: Sequence[tuple[str, bool]]) -> DataFrame:
    """The first n rows by (column, descending) pairs, nulls last, and those that tie with the last of them.

    The n-th row comes from a top-n, which keeps n rows a partition; the ties are the rows with its
    values. No global window.
    """
    sort = [order(c, down) for c, down in by]
    top = df.orderBy(*sort).limit(n)
    last = top.orderBy(*[order(c, not down, True) for c, down in by]).limit(1).select(*[F.col(c).alias(f"_{c}") for c, _ in by])
    before = F.lit(False)
    for c, down in reversed(by):
        own, edge = F.col(c), F.col(f"_{c}")
        less = (own > edge) if down else (own < edge)
        less = F.coalesce(less, own.isNotNull() & edge.isNull())
        before = less | (own.eqNullSafe(edge) & before)
    tied = F.lit(True)
    for c, _ in by:
        tied = tied & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return df.join(F.broadcast(last), before | tied).drop(*[f"_{c}" for c, _ in by])


def cross_model_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, prefixes: tuple[str, str]) -> DataFrame:
    """Inner join of two models' rows on keys compared as text; columns get each model's prefix."""
    a = left.select(*[F.col(c).alias(f"{prefixes[0]}_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{prefixes[1]}_{c}") for c in right.columns])
    return a.join(b, F.col(f"{prefixes[0]}_{left_key}").cast("string") == F.col(f"{prefixes[1]}_{right_key}").cast("string"))


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, start: str, length: int) -> DataFrame:
    """Pairs with equal keys and start <= at < start + length (integers), by an equi-join on time bins.

    Each right row goes into the one or two bins that its interval touches, each left row into its
    own: work follows the pairs that meet in a bin, not all pairs of a key.
    """
    a = left.withColumn("_bin", F.floor(F.col(at) / length))
    b = right.withColumn("_bin", F.explode(F.array_distinct(F.array(F.floor(F.col(start) / length), F.floor((F.col(start) + length - 1) / length)))))
    joined = a.join(b, [*keys, "_bin"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + length)).drop("_bin")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, value: str, strict: bool = False) -> DataFrame:
    """left with the latest right `value` of its key at or before (strict: before) its own time, null if none.

    One shuffle of both sides together and a running last value; no pairs are made.
    """
    cols = [F.col(c) for c in left.columns]
    rank_left, rank_right = (0, 1) if strict else (1, 0)
    a = left.select(*cols, F.col(left_at).alias("_at"), F.lit(rank_left).alias("_side"), F.lit(True).alias("_left"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.select(*[F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(right_at).alias("_at"), F.lit(rank_right).alias("_side"), F.lit(False).alias("_left"), F.col(value).alias("_value"))
    w = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_found", F.last("_value", ignorenulls=True).over(w))
    return both.where("_left").select(*left.columns, F.col("_found").alias(f"asof_{value}"))


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
