"""Joins on keys of which a few may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 2_000
HOT_ROWS = 1_000


def join_values(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows left-joined with values, which has one row for each key.

    Keys with more than 1/HOT_KEYS of the rows (and HOT_ROWS) are joined by a broadcast of their
    values, so of less than HOT_KEYS rows; the others are shuffled. Both inputs are read twice
    where there are such keys: pass written tables.
    """
    sizes = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    least = max(HOT_ROWS, rows.count() // HOT_KEYS)
    hot = [r[0] for r in sizes.where(F.col("n") > least).select(key).collect()]
    if not hot:
        return rows.join(values, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.where(is_hot).join(F.broadcast(values.where(is_hot)), key, "left").unionByName(rows.where(~is_hot).join(values.where(~is_hot), key, "left"))
