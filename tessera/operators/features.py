"""Features and series models as aggregates and joins: encoders, scalings, selection, forecasts, seasons, change points.

Statistics are aggregated with partial sums and joined back; no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import timeseries as ts


def _joined(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """stats joined to df on keys, null ones too; one row of statistics is broadcast."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))
    named = stats.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in stats.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(named, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def label_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """df with the category's place (from 0) in the order of all categories; null for null."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = values.withColumn(out or f"{column}_code", F.row_number().over(Window.orderBy(column)) - 1)  # one row a category
    return _joined(df, codes, [column])


def binary_encode(df: DataFrame, column: str, bits: int) -> DataFrame:
    """df with the label code's bits, the lowest first, as columns <column>_bit0..; codes need that many bits."""
    coded = label_encode(df, column, "_code")
    return coded.select(*df.columns, *[F.shiftright("_code", k).bitwiseAND(F.lit(1)).alias(f"{column}_bit{k}") for k in range(bits)])


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 0.0) -> DataFrame:
    """df with the category's mean target, drawn to the overall mean by `smoothing` rows of it."""
    total = df.agg(F.avg(target).alias("_all"))
    means = df.groupBy(column).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    encoded = (F.col("_s") + smoothing * F.col("_all")) / (F.col("_n") + smoothing)
    return _joined(df, means.crossJoin(F.broadcast(total)).select(column, encoded.alias(f"{column}_target")), [column])


def robust_scale(df: DataFrame, value: str, keys: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """df with scaled = (value - median) / (third - first quartile), by approximate percentiles; 0 where the quartiles are equal."""
    q = F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy)
    rows = _joined(df, df.groupBy(*keys).agg(q.alias("_q")), keys)
    width = F.col("_q")[2] - F.col("_q")[0]
    return rows.withColumn("scaled", F.when(width > 0, (F.col(value) - F.col("_q")[1]) / width).otherwise(0.0)).drop("_q")


def unit_vector(vector: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    from tessera.functions.vectors import norm

    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda v: v.cast("double") / n)).otherwise(F.transform(vector, lambda v: v.cast("double")))


def select_features(df: DataFrame, features: Sequence[str], target: str, k: int) -> list[str]:
    """The k features of the largest absolute correlation with the target, best first; one pass."""
    row = df.agg(*[F.abs(F.corr(f, target)).alias(f) for f in features]).first()
    score = {f: (row[f] if row[f] is not None and row[f] == row[f] else 0.0) for f in features}
    return sorted(features, key=lambda f: (-score[f], f))[:k]


def forecast(df: DataFrame, keys: Sequence[str], at: str, value: str, step: int, periods: int, season: int = 0) -> DataFrame:
    """(keys, at, forecast): `periods` points `step` apart after each series' last, on its line of least squares, plus the mean residual of the phase where a season is given (in time units)."""
    fit = df.groupBy(*keys).agg(F.regr_slope(value, at).alias("_a"), F.regr_intercept(value, at).alias("_b"), F.max(at).alias("_last"))
    ahead = fit.withColumn(at, F.explode(F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda k: F.col("_last") + k * step)))
    line = F.col("_a") * F.col(at) + F.col("_b")
    if not season:
        return ahead.select(*keys, at, line.alias("forecast"))
    rest = _joined(df, fit, keys).withColumn("_phase", F.pmod(F.col(at), F.lit(season)))
    phases = rest.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("_a") * F.col(at) - F.col("_b")).alias("_season"))
    with_season = _joined(ahead.withColumn("_phase", F.pmod(F.col(at), F.lit(season))), phases, [*keys, "_phase"])
    return with_season.select(*keys, at, (line + F.coalesce("_season", F.lit(0.0))).alias("forecast"))


def decompose(df: DataFrame, keys: Sequence[str], at: str, value: str, season: int) -> DataFrame:
    """df with trend (line of least squares), seasonal (mean of what is left, by phase) and residual: they add up to the value."""
    fit = df.groupBy(*keys).agg(F.regr_slope(value, at).alias("_a"), F.regr_intercept(value, at).alias("_b"))
    rows = _joined(df, fit, keys).withColumn("trend", F.col("_a") * F.col(at) + F.col("_b")).withColumn("_phase", F.pmod(F.col(at), F.lit(season)))
    phases = rows.groupBy(*keys, "_phase").agg(F.avg(F.col(value) - F.col("trend")).alias("seasonal"))
    return _joined(rows, phases, [*keys, "_phase"]).withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_a", "_b", "_phase")


def change_points(df: DataFrame, keys: Sequence[str], at: str, value: str, chunk: int | None = None) -> DataFrame:
    """(keys, at, shift): where each series' mean changes most: the last sample before the split that explains most of its squares, and the change of mean there. Ties: the earliest."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_one", F.lit(1.0))
    rows = ts.cumulative_sum(rows, keys, at, value, chunk).withColumnRenamed("cumulative_sum", "_s")
    rows = ts.cumulative_sum(rows, keys, at, "_one", chunk).withColumnRenamed("cumulative_sum", "_n")
    total = rows.groupBy(*keys).agg(F.sum(value).alias("_t"), F.count(F.lit(1)).alias("_m"))
    rows = _joined(rows, total, keys).where("_n < _m")
    shift = (F.col("_t") - F.col("_s")) / (F.col("_m") - F.col("_n")) - F.col("_s") / F.col("_n")
    gain = F.col("_n") * (F.col("_m") - F.col("_n")) / F.col("_m") * shift * shift
    best = rows.withColumn("_shift", shift).withColumn("_gain", F.round(gain, 9))
    top = best.groupBy(*keys).agg(F.max(F.struct(F.col("_gain"), (-F.col(at)).alias("_less"), F.col("_shift"))).alias("_top"))
    return top.select(*keys, (-F.col("_top._less")).alias(at), F.col("_top._shift").alias("shift"))


def embed_text(text: Column, size: int = 64) -> Column:
    """A hashed bag of words at length 1: array<double> of `size`; words are runs of letters and digits, in lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    return F.when(text.isNotNull(), unit_vector(counts))
