"""Aggregates beyond the built-in ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_agg(value: Column, ignore_nulls: bool = False) -> Column:
    """A JSON array of a group's values, sorted so that the result doesn't depend on the plan; nulls come first."""
    packed = F.collect_list(F.struct(value.alias("v")))
    items = F.transform(F.sort_array(packed), lambda x: x["v"])
    if ignore_nulls:
        items = F.sort_array(F.collect_list(value))
    return F.to_json(items, {"ignoreNullFields": "false"})


def json_object_agg(key: Column, value: Column) -> Column:
    """A JSON object of a group's key-value pairs in key order. Keys must be unique in the group."""
    return F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key.cast("string"), value)))), {"ignoreNullFields": "false"})


def first_by(value: Column, by: Column) -> Column:
    """The value of the row that comes first by `by`: unlike first(), the same in every plan."""
    return F.min_by(value, by)


def last_by(value: Column, by: Column) -> Column:
    return F.max_by(value, by)


CUTS = 200


def percentile_nearest(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """(keys, percentile): the value at rank round(p / 100 * (n - 1)) of each group's sorted non-null values.

    Exact without sorting a group: CUTS approximate quantiles around the rank cut the values into
    ranges, whose exact counts tell the range that holds the rank; only the distinct values of that
    one are counted and ranked. (Should many values lie outside the cuts, the range is larger, not wrong.)
    """
    share, eps = p / 100, 0.01
    rows = df.where(F.col(value).isNotNull())
    shares = [min(1.0, max(0.0, share - eps + 2 * eps * k / CUTS)) for k in range(CUTS + 1)]
    bounds = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array_distinct(F.percentile_approx(value, shares, 10_000)).alias("_cuts"))
    bounds = bounds.withColumn("_rank", F.floor(F.lit(share) * (F.col("_n") - 1) + 0.5)).drop("_n")

    def joined(with_: DataFrame, right: DataFrame) -> DataFrame:
        if not keys:
            return with_.crossJoin(F.broadcast(right))  # one row
        named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return with_.join(named, same).drop(*[f"_k{i}" for i in range(len(keys))])

    ranged = joined(rows, bounds).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value))))
    counts = ranged.groupBy(*keys, "_range", "_rank").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))  # CUTS + 2 rows a group at most
    hit = counts.withColumn("_upto", upto).where("_upto > _rank and _upto - _c <= _rank")
    hit = hit.select(*keys, F.col("_range").alias("_hit"), (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_place"))
    inside = joined(ranged.select(*keys, F.col(value).alias("_v"), "_range"), hit).where("_range = _hit").groupBy(*keys, "_place", "_v").agg(F.count(F.lit(1)).alias("_c"))
    below = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_upto", below).where("_upto > _place and _upto - _c <= _place").select(*keys, F.col("_v").alias("percentile"))


def histogram(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """(upper_bound, n): equal-width buckets between min and max, labelled by their upper bound; one bucket if all values are equal."""
    span = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    k = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(buckets - 1)))
    upper = F.when(F.col("_hi") == F.col("_lo"), F.col("_hi")).otherwise(F.col("_lo") + (k + 1) * width)
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(span))
    return rows.groupBy(k.alias("bucket")).agg(F.first(upper).alias("upper_bound"), F.count(F.lit(1)).alias("n")).select("bucket", "upper_bound", "n")


def skew_safe_count_distinct(df: DataFrame, keys: Sequence[str], value: str, salts: int = 32) -> DataFrame:
    """(keys, n): exact distinct counts where one key may hold a large part of the rows: distinct first, then salted partial counts."""
    once = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    part = once.groupBy(*keys, F.pmod(F.xxhash64(value), F.lit(salts)).alias("_salt")).agg(F.count(F.lit(1)).alias("_n"))
    return part.groupBy(*keys).agg(F.sum("_n").alias("n"))
