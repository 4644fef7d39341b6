"""Windowed aggregation of event streams. The same functions serve batch and streaming DataFrames.

On a stream give `late`: events up to that much behind the newest are counted, later ones dropped,
and a window's state goes once it can't change. Batch results are over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATIONS = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.approx_count_distinct, "collect": lambda v: F.sort_array(F.collect_list(v)),
}


def _aggregate(df: DataFrame, window: Column, keys: Sequence[str], value: str, names: Sequence[str], at: str) -> DataFrame:
    extra = {"first": lambda v: F.min_by(v, at), "last": lambda v: F.max_by(v, at)}
    out = [(AGGREGATIONS | extra)[n](F.col(value)).alias(n) for n in names]
    got = df.groupBy(window.alias("w"), *keys).agg(*out)
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *names)


def _late(df: DataFrame, at: str, late: str | None) -> DataFrame:
    return df.withWatermark(at, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, at: str, size: str, keys: Sequence[str], value: str, names: Sequence[str], late: str | None = None) -> DataFrame:
    return _aggregate(_late(df, at, late), F.window(at, size), keys, value, names, at)


def sliding(df: DataFrame, at: str, size: str, slide: str, keys: Sequence[str], value: str, names: Sequence[str], late: str | None = None) -> DataFrame:
    return _aggregate(_late(df, at, late), F.window(at, size, slide), keys, value, names, at)


def session(df: DataFrame, at: str, gap: str, keys: Sequence[str], value: str, names: Sequence[str], late: str | None = None) -> DataFrame:
    return _aggregate(_late(df, at, late), F.session_window(at, gap), keys, value, names, at)


def count_windows(df: DataFrame, keys: Sequence[str], order: str, size: int, value: str) -> DataFrame:
    """(keys, window, n, total): every `size` consecutive events of a key in order; the last may be short. Batch."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("window", F.floor((F.row_number().over(w) - 1) / size)).groupBy(*keys, "window").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def count_windows_stream(df: DataFrame, key: str, size: int, value: str) -> DataFrame:
    """(key, n, total) for every `size` events of a key as they come, by state that holds a count and a sum."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        rows = []
        for part in parts:
            for v in part[value]:
                n, total = n + 1, total + float(v)
                if n == size:
                    rows.append((k[0], n, total))
                    n, total = 0, 0.0
        state.update((n, total))
        yield pd.DataFrame(rows, columns=[key, "n", "total"])

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, n long, total double", "n long, total double", "append", GroupStateTimeout.NoTimeout)
