"""Key-value, list, set, sorted-set and hash operations on keyed DataFrames.

A store is a table of commands in time order; its state is a grouped aggregate of them, so any
number of keys is handled at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_values(sets: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """SET: the last write of each key wins."""
    return sets.groupBy(key).agg(F.max_by(value, at).alias(value))


def set_if_absent(sets: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """SETNX: the first write of each key wins."""
    return sets.groupBy(key).agg(F.min_by(value, at).alias(value))


def counters(changes: DataFrame, key: str, delta: str) -> DataFrame:
    """INCRBY, DECRBY."""
    return changes.groupBy(key).agg(F.sum(delta).alias(delta))


def alive(df: DataFrame, expires: str, now) -> DataFrame:
    """TTL: rows without an expiry, or with a later one than now."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def lists(pushes: DataFrame, key: str, value: str, at: str, left: bool = False) -> DataFrame:
    """RPUSH (LPUSH): (key, items) with the items in (reverse) order of time. A list is one value: it must fit into a row."""
    items = F.transform(F.sort_array(F.collect_list(F.struct(at, value)), not left), lambda x: x[value])
    return pushes.groupBy(key).agg(items.alias("items"))


def lrange(items: Column, start: int, stop: int) -> Column:
    """0-based, both ends included, negative from the end."""
    n = F.size(items)
    a = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    b = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.when(b >= a, F.slice(items, a + 1, b - a + 1)).otherwise(F.slice(items, 1, 0))


def lindex(items: Column, index: int) -> Column:
    return F.get(items, F.lit(index) if index >= 0 else F.size(items) + index)


def lrem(items: Column, value) -> Column:
    return F.array_remove(items, value)


def lset(items: Column, index: int, value: Column) -> Column:
    at = F.lit(index) if index >= 0 else F.size(items) + index
    return F.transform(items, lambda x, i: F.when(i == at, value).otherwise(x))


def hashes(sets: DataFrame, key: str, field: str, value: str, at: str) -> DataFrame:
    """HSET: (key, fields map) with the last write of each field."""
    last = sets.groupBy(key, field).agg(F.max_by(value, at).alias(value))
    return last.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(field, value)))).alias("fields"))


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def exact_sum(value: Column) -> Column:
    """Aggregate: the sum of doubles as they are written, whatever their order: 0.1 + 0.2 + 0.3 is 0.6.

    Added as decimals. Where a group has a value of 1e9 or more, or of more than 18 decimal places, it
    is the plain sum, whose last digits depend on the order.
    """
    exact = value.try_cast("decimal(38,18)")
    known = F.bool_and(F.coalesce((F.abs(value) < 1e9) & (exact.cast("double") == value), value.isNull()))
    return F.when(known, F.sum(F.when(F.abs(value) < 1e9, exact)).cast("double")).otherwise(F.sum(value))


def zset(changes: DataFrame, key: str, member: str, score: str) -> DataFrame:
    """ZINCRBY: (key, member, score) with summed scores, which don't depend on the order of the changes."""
    double = changes.schema[score].dataType.simpleString() == "double"
    return changes.groupBy(key, member).agg((exact_sum(F.col(score)) if double else F.sum(score)).alias(score))


def zrange(df: DataFrame, key: str, member: str, score: str, start: int, stop: int) -> DataFrame:
    """Members start..stop (0-based, both included) of each key by score, then name, with `rank`."""
    w = Window.partitionBy(key).orderBy(score, member)
    return df.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank").between(start, stop))


def zrank(df: DataFrame, key: str, member: str, score: str, name) -> DataFrame:
    """(key, rank from 0) of one member in each key that has it: how many come before it, without sorting a key."""
    own = df.where(F.col(member) == F.lit(name)).select(F.col(key).alias("_key"), F.col(score).alias("_score"))
    less = (F.col(score) < F.col("_score")) | ((F.col(score) == F.col("_score")) & (F.col(member) < F.lit(name)))
    return df.join(own, F.col(key) == F.col("_key")).groupBy(key).agg(F.sum(less.cast("long")).alias("rank"))


def zcount(df: DataFrame, key: str, score: str, low: float, high: float) -> DataFrame:
    """(key, n) of the members with low <= score <= high; 0 for keys without any."""
    return df.groupBy(key).agg(F.count(F.when(F.col(score).between(low, high), 1)).alias("n"))


def zrange_by_score(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(score).between(low, high))


def lpop(items: Column, count: int = 1) -> Column:
    """What is left after `count` items are taken from the head."""
    return F.slice(items, count + 1, F.greatest(F.size(items) - count, F.lit(0)))


def rpop(items: Column, count: int = 1) -> Column:
    return F.slice(items, 1, F.greatest(F.size(items) - count, F.lit(0)))


def ltrim(items: Column, start: int, stop: int) -> Column:
    return lrange(items, start, stop)


def linsert(items: Column, pivot: Column, value: Column, after: bool = False) -> Column:
    """The value before (after) the first item that equals the pivot; unchanged if there is none."""
    at = F.array_position(items, pivot).cast("int")
    return F.when(at > 0, F.concat(F.slice(items, 1, at - 1 + int(after)), F.array(value), F.slice(items, at + int(after), F.size(items)))).otherwise(items)


def hset(fields: Column, field: str, value: Column) -> Column:
    return F.map_concat(hdel(fields, field), F.create_map(F.lit(field), value))


def hdel(fields: Column, field: str) -> Column:
    return F.map_filter(fields, lambda k, _: k != field)


def hincrby(fields: Column, field: str, by) -> Column:
    """A missing field counts from 0."""
    return hset(fields, field, F.coalesce(F.try_element_at(fields, F.lit(field)), F.lit(0)) + by)


def hmget(fields: Column, *names: str) -> Column:
    return F.array(*[F.try_element_at(fields, F.lit(n)) for n in names])
