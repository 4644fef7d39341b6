"""Time series in long form: series keys, a time in epoch milliseconds, a value.

Buckets are aligned at the epoch: bucket = floor(t / size) * size. Null values take no part in an
aggregate; a null time belongs to no bucket (null).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    micros = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000)
    return (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000 + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + micros).cast("long")


def bucket(at: Column, size_ms: int) -> Column:
    return (F.floor(at / F.lit(size_ms)) * size_ms).cast("long")


def aggregation(name: str, value: Column, at: Column) -> Column:
    """One of the named bucket aggregations; std.* and var.* with p are of the population, with s of the sample."""
    table = {
        "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "std.p": F.stddev_pop, "std.s": F.stddev_samp, "var.p": F.var_pop, "var.s": F.var_samp,
        "range": lambda v: F.max(v) - F.min(v),
        "first": lambda v: F.min_by(v, at), "last": lambda v: F.max_by(v, at),
    }
    return table[name.lower()](value)


def bucket_aggregate(df: DataFrame, keys: Sequence[str], at: str, value: str, size_ms: int, names: Sequence[str]) -> DataFrame:
    """(keys, bucket, one column for each aggregation, dots as underscores): partial sums before the shuffle."""
    out = [aggregation(n, F.col(value), F.col(at)).alias(n.lower().replace(".", "_")) for n in names]
    return df.where(F.col(value).isNotNull()).groupBy(*keys, bucket(F.col(at), size_ms).alias("bucket")).agg(*out)


def downsample(df: DataFrame, keys: Sequence[str], at: str, value: str, size_ms: int) -> DataFrame:
    """(keys, bucket, value): the mean of each interval."""
    return bucket_aggregate(df, keys, at, value, size_ms, ["avg"]).withColumnRenamed("avg", "value")


ROWS_AT_ONCE = 1_000_000


def chunk_ms(df: DataFrame, at: str, least: int = 1) -> int:
    """A chunk length by which ROWS_AT_ONCE samples, on average over all series, are in a chunk; no less than `least`.

    Windows over a series are then over (series, chunk): a few long series are as many tasks as a
    thousand short ones. What a chunk needs of the ones before it is small and joined or copied.
    """
    r = df.agg(F.min(at).alias("a"), F.max(at).alias("b"), F.count(at).alias("n")).first()
    span = (r["b"] - r["a"] + 1) if r["n"] else 1
    return int(max(least, -(-span // max(1, -(-r["n"] // ROWS_AT_ONCE)))))


def _chunked(df: DataFrame, keys: Sequence[str], at: str, chunk: int | None, least: int = 1) -> tuple[DataFrame, int]:
    size = max(chunk or chunk_ms(df, at, least), least)
    return df.withColumn("_chunk", F.floor(F.col(at) / size).cast("long")), size


def _carried(rows: DataFrame, keys: Sequence[str], edge: Column, back: bool) -> DataFrame:
    """(keys, _chunk, _edge): for each chunk, `edge` (an aggregate) of the nearest chunk before it (after it if not back) that has rows."""
    each = rows.groupBy(*keys, "_chunk").agg(edge.alias("_own"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    return each.select(*keys, "_chunk", (F.lag("_own") if back else F.lead("_own")).over(w).alias("_edge"))


def _with_edge(rows: DataFrame, keys: Sequence[str], edge: Column, back: bool) -> DataFrame:
    carried = _carried(rows, keys, edge, back)
    named = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), "_edge")
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same, "left").drop("_c", *[f"_k{i}" for i in range(len(keys))])


def time_weighted_average(df: DataFrame, keys: Sequence[str], at: str, value: str, chunk: int | None = None) -> DataFrame:
    """(keys, twa): each value weighted by the time until the next sample; a single sample is its own average."""
    rows, _ = _chunked(df, keys, at, chunk)
    rows = _with_edge(rows, keys, F.min(at), False)
    w = Window.partitionBy(*keys, "_chunk").orderBy(at)
    rows = rows.withColumn("_span", F.coalesce(F.lead(at).over(w), F.col("_edge")) - F.col(at)).withColumn("_span", F.coalesce("_span", F.lit(0)))
    total = F.sum("_span")
    return rows.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(value) * F.col("_span")) / total).otherwise(F.avg(value)).alias("twa"))


def deduplicate(df: DataFrame, keys: Sequence[str], at: str, value: str, policy: str, order: str) -> DataFrame:
    """(keys, at, value): one sample for each time by duplicate policy first, last (in `order`), min, max, sum; block fails on duplicates."""
    v, o = F.col(value), F.col(order)
    rules = {"first": F.min_by(v, o), "last": F.max_by(v, o), "min": F.min(v), "max": F.max(v), "sum": F.sum(v)}
    if policy == "block":
        many = F.count(F.lit(1)) > 1
        return df.groupBy(*keys, at).agg(F.when(many, F.raise_error(F.lit("duplicate sample"))).otherwise(F.max(v)).alias(value))
    return df.groupBy(*keys, at).agg(rules[policy].alias(value))


def latest(df: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(at).alias(at), F.max_by(value, at).alias(value))


def time_range(df: DataFrame, at: str, start: int, end: int) -> DataFrame:
    """Samples with start <= time <= end."""
    return df.where(F.col(at).between(start, end))


def label_filter(df: DataFrame, labels: str, wanted: dict[str, str]) -> DataFrame:
    """Samples whose label map has all wanted values; an empty filter keeps all."""
    for k, v in wanted.items():
        df = df.where(F.col(labels)[k] == v)
    return df


ROWS_A_STEP = 65_536


def _range_sums(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The sums of x[low:high], by sums of pairs, of pairs of pairs and so on: few additions each, none taken back."""
    out, low, high = np.zeros(len(low)), low.copy(), high.copy()
    while (some := low < high).any():
        at = some & (low & 1 == 1)
        out[at] += x[low[at]]
        low += at
        at = (low < high) & (high & 1 == 1)
        high -= at
        out[at] += x[high[at]]
        low, high = low >> 1, high >> 1
        x = x[::2] + np.append(x[1::2], np.zeros(len(x) & 1))
    return out


def moving_average(df: DataFrame, keys: Sequence[str], at: str, value: str, window_ms: int, chunk: int | None = None) -> DataFrame:
    """df with moving_avg over the samples of the last window_ms milliseconds, both ends included; samples without a time are a window of their own.

    A sample is copied to the chunk after its own where that one's windows reach back to it (chunks
    are no shorter than the window). A chunk's samples stream by in order of time; a task holds those
    of one window, and as many again. A sample costs the logarithm of its window's samples.
    """
    keys, names = list(keys), df.columns
    rows, size = _chunked(df.where(F.col(at).isNotNull()), keys, at, chunk, window_ms + 1)
    reach = F.floor((F.col(at) + window_ms) / size).cast("long")
    copied = rows.withColumn("_in", F.explode(F.sequence("_chunk", reach))).withColumn("_own", F.col("_in") == F.col("_chunk")).withColumn("_value", F.col(value).cast("double")).drop("_chunk")
    marks = [*keys, "_in"]

    def averages(waiting: pa.Table, before: tuple[np.ndarray, np.ndarray, np.ndarray], last: bool) -> tuple[list[pa.RecordBatch], pa.Table, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What is done of the rows that wait, the rest (those of the last time, unless no more come), and the samples that later windows reach."""
        t, v = waiting[at].to_numpy(), waiting["_value"]
        new = (t, v.fill_null(0.0).to_numpy(), np.asarray(v.is_valid().to_numpy(), np.int64))
        n = len(t) if last else int(np.searchsorted(t, t[-1], "left"))
        every = tuple(np.concatenate([x, y[:n]]) for x, y in zip(before, new))
        now = t[:n]
        low, high = np.searchsorted(every[0], now - window_ms, "left"), np.searchsorted(every[0], now, "right")
        count = np.concatenate([[0], np.cumsum(every[2])])
        found = count[high] - count[low]
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = _range_sums(every[1], low, high) / found
        done = waiting.slice(0, n).select(names).append_column("moving_avg", pa.array(mean, mask=found == 0)).filter(waiting["_own"].slice(0, n))
        keep = 0 if last else int(np.searchsorted(every[0], t[n] - window_ms, "left"))
        return done.to_batches(), waiting.slice(n), tuple(x[keep:] for x in every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        key, held, n, before = None, [], 0, none
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch[m].dictionary_encode().indices.fill_null(-1).to_numpy() for m in marks]
            new = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                own = tuple(batch[m][a].as_py() for m in marks)
                if own != key:
                    if n:
                        yield from averages(pa.Table.from_batches(held).combine_chunks(), before, True)[0]
                    key, held, n, before = own, [], 0, none
                held.append(batch.slice(a, b - a))
                n += b - a
                if n >= max(ROWS_A_STEP, len(before[0])):
                    done, rest, before = averages(pa.Table.from_batches(held).combine_chunks(), before, False)
                    held, n = rest.combine_chunks().to_batches(), rest.num_rows
                    yield from done
        if n:
            yield from averages(pa.Table.from_batches(held).combine_chunks(), before, True)[0]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", moving_avg double"
    timed = copied.repartition(*[F.col(m) for m in marks]).sortWithinPartitions(*marks, at).mapInArrow(run, schema)
    untimed = df.where(F.col(at).isNull()).withColumn("moving_avg", F.avg(value).over(Window.partitionBy(*keys)).cast("double"))
    return timed.unionByName(untimed)


def _before(df: DataFrame, keys: Sequence[str], at: str, value: str, chunk: int | None) -> DataFrame:
    """df with _prev: struct<at, value> of the sample before."""
    rows, _ = _chunked(df, keys, at, chunk)
    last = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    rows = _with_edge(rows, keys, F.max_by(last, F.col(at)), True)
    w = Window.partitionBy(*keys, "_chunk").orderBy(at)
    return rows.withColumn("_prev", F.coalesce(F.lag(last).over(w), F.col("_edge"))).drop("_chunk", "_edge")


def rate(df: DataFrame, keys: Sequence[str], at: str, value: str, chunk: int | None = None) -> DataFrame:
    """df with rate: change a second since the sample before; null for the first and where no time has passed."""
    seconds = (F.col(at) - F.col("_prev.at")) / 1000.0
    return _before(df, keys, at, value, chunk).withColumn("rate", F.when(seconds > 0, (F.col(value) - F.col("_prev.value")) / seconds)).drop("_prev")


def delta(df: DataFrame, keys: Sequence[str], at: str, value: str, chunk: int | None = None) -> DataFrame:
    return _before(df, keys, at, value, chunk).withColumn("delta", F.col(value) - F.col("_prev.value")).drop("_prev")


def cumulative_sum(df: DataFrame, keys: Sequence[str], at: str, value: str, chunk: int | None = None) -> DataFrame:
    """df with cumulative_sum: the chunks' totals before, and the running sum in the chunk."""
    rows, _ = _chunked(df, keys, at, chunk)
    totals = rows.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_own"))
    before = totals.withColumn("_edge", F.sum("_own").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("_own")
    named = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), "_edge")
    same = F.col("_chunk").eqNullSafe(F.col("_c"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = rows.join(named, same, "left").drop("_c", *[f"_k{i}" for i in range(len(keys))])
    run = F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(run.isNull() & F.col("_edge").isNull(), F.lit(None)).otherwise(F.coalesce(run, F.lit(0)) + F.coalesce("_edge", F.lit(0)))
    return joined.withColumn("cumulative_sum", total).drop("_chunk", "_edge")


def anomalies(df: DataFrame, keys: Sequence[str], value: str, k: float) -> DataFrame:
    """Samples further than k population deviations from their series' mean, with `z`; none where the deviation is 0.

    The statistics are aggregated (with partial sums) and joined back; a long series isn't gathered.
    """
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = (F.col(value) - F.col("_mean")) / F.col("_sd")
    return df.join(stats, list(keys)).where("_sd > 0").withColumn("z", z).where(F.abs("z") > k).drop("_mean", "_sd")


def exponential_average(df: DataFrame, keys: Sequence[str], at: str, value: str, alpha: float, chunk: int | None = None) -> DataFrame:
    """df's rows that have a value, with ema: y0 = x0, then alpha * x + (1 - alpha) * y before, in order of time (ties by value).

    A chunk's last average is decay * (the average before it) + rest, where decay and rest are the
    chunk's own: these are found for all chunks at once, the chunks' starts follow from them, and a
    second pass gives the averages. Both stream sorted partitions; a series is never held in memory.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    rows, _ = _chunked(df.where(F.col(value).isNotNull()), keys, at, chunk)
    order, names = [*keys, "_chunk", at, value], df.columns

    def sorted_(part: DataFrame) -> DataFrame:
        return part.repartition(*[F.col(k) for k in keys], F.col("_chunk")).sortWithinPartitions(*order)

    def groups(part: pd.DataFrame) -> Iterator[tuple[tuple, pd.DataFrame]]:
        marks = part[[*keys, "_chunk"]]
        new = (marks != marks.shift()) & ~(marks.isna() & marks.shift().isna())
        for _, g in part.groupby(new.any(axis=1).cumsum(), sort=False):
            yield tuple(None if v != v else v for v in g.iloc[0][[*keys, "_chunk"]]), g

    def smooth(start: float, x: np.ndarray) -> np.ndarray:
        return pd.Series(np.concatenate([[start], x])).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None  # key, decay, rest, first value of the chunk so far
        for part in parts:
            out = []
            for key, g in groups(part):
                x = g[value].to_numpy(float)
                if now is not None and now[0] == key:
                    now = (key, now[1] * (1 - alpha) ** len(x), float(smooth(now[2], x)[-1]), now[3])
                else:
                    out += [now] if now is not None else []
                    now = (key, (1 - alpha) ** len(x), float(smooth(0.0, x)[-1]), float(x[0]))
            yield pd.DataFrame([(*k, a, b, c) for k, a, b, c in out], columns=[*keys, "_chunk", "_decay", "_rest", "_first"])
        if now is not None:
            yield pd.DataFrame([(*now[0], *now[1:])], columns=[*keys, "_chunk", "_decay", "_rest", "_first"])

    def starts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, y = None, 0.0
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                own = tuple(None if v != v else v for v in row[: len(keys)])
                y = row[-1] if own != key else y
                key = own
                out.append(y)
                y = row[-3] * y + row[-2]
            yield part[[*keys, "_chunk"]].assign(_start=out)

    def averages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, y = None, 0.0
        for part in parts:
            out = []
            for own, g in groups(part):
                got = smooth(y if own == key else float(g["_start"].iloc[0]), g[value].to_numpy(float))
                key, y = own, float(got[-1])
                out.append(got)
            yield part[names].assign(ema=np.concatenate(out) if out else np.zeros(0))

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _chunk long"
    chunks = sorted_(rows.select(*order)).mapInPandas(ends, f"{kinds}, _decay double, _rest double, _first double")
    begun = chunks.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "_chunk").mapInPandas(starts, f"{kinds}, _start double")
    named = begun.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), "_start")
    same = F.col("_chunk").eqNullSafe(F.col("_c"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", ema double"
    return sorted_(rows.join(named, same).drop("_c", *[f"_k{i}" for i in range(len(keys))])).mapInPandas(averages, schema)


def compaction(df: DataFrame, keys: Sequence[str], at: str, value: str, rule: str, size_ms: int) -> DataFrame:
    """A compaction rule's destination: (keys, at, value) with each bucket's aggregate at its start."""
    name = rule.lower().replace(".", "_")
    return bucket_aggregate(df, keys, at, value, size_ms, [rule]).select(*keys, F.col("bucket").alias(at), F.col(name).cast("double").alias(value))


def continuous_aggregate(df: DataFrame, keys: Sequence[str], at: str, value: str, size_ms: int) -> DataFrame:
    """Mergeable bucket state (n, total, low, high): add new rows' state to a stored one with `merge_state`."""
    return df.groupBy(*keys, bucket(F.col(at), size_ms).alias("bucket")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def merge_state(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
