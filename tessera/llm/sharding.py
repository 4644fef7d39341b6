"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The shuffle of n rows into s shards is done as it would be between machines: draw how many rows
each source partition gives to each shard (a random matrix whose margins are the partitions'
and the shards' sizes, so the draws are multivariate hypergeometric), permute each partition by
itself and cut it by its row of the matrix, exchange, and permute each shard again. With true random
numbers every one of the n! orders would be as likely as any other; here the draws follow from `seed`
and the permutations are by hashes of it and the row's place. The shard sizes are exact.

DataFrame functions only: the texts are measured in the scan and never shuffled; what moves is a
row of a few numbers. The driver holds one small number for each source partition and shard, of
at most MAX_GROUPS partitions; above that, partitions are taken together.

Defined results: a null text has size 1 and the checksum of an empty text; rows that repeat, ids
included, are rows of their own; a null id stays null; an empty input gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import random
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import discard, written

MAX_GROUPS = 65_536
BUCKET_ROWS = 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` draws without replacement are good, by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    weights, total = {mode: 1.0}, 1.0
    for step in (1, -1):
        k, w = mode, 1.0
        while low <= k + step <= high and w > 1e-17:
            if step > 0:
                w *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
            else:
                w *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
            k += step
            weights[k] = w
            total += w
    u = rng.random() * total
    for k, w in weights.items():
        u -= w
        if u <= 0:
            return k
    return mode


def communication_matrix(partition_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each partition gives to each shard: row and column sums are the given sizes."""
    rng, left, out = random.Random(seed), list(shard_sizes), []
    for size in partition_sizes:
        row, need, pool = [], size, sum(left)
        for quota in left:
            pool -= quota
            got = hypergeometric(rng, quota, pool, need) if pool else need
            row.append(got)
            need -= got
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def shuffle_shards(docs: DataFrame, shards: int = 8, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot): every row's shard 0..shards-1 and its place there, gapless from 0.

    Shard sizes differ by one row at most. The source partitions are those of the scan, fixed by
    writing the measured rows once, so that later attempts see the same partitions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.pmod(F.spark_partition_id(), F.lit(MAX_GROUPS)).alias("_from"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    spark = docs.sparkSession
    counts = [(r["_from"], r["count"]) for r in rows.groupBy("_from").count().orderBy("_from").collect()]
    n = sum(c for _, c in counts)
    sizes = [n // shards + (k < n % shards) for k in range(shards)]
    matrix = communication_matrix([c for _, c in counts], sizes, seed)
    cuts = [(p, list(accumulate(row))) for (p, _), row in zip(counts, matrix)]
    ends = spark.createDataFrame(cuts, "_from int, _ends array<long>")

    def draw(salt: int):
        return F.xxhash64(F.lit(seed + salt), F.col("_row"))

    local = F.row_number().over(Window.partitionBy("_from").orderBy(draw(1), "_row")) - 1
    buckets = max(1, math.ceil(n / shards / bucket_rows))
    sent = written(
        rows.withColumn("_place", local)
        .join(ends, "_from")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_place"))))
        .select(id_col, "size", "text_crc32", "shard", F.pmod(draw(2), F.lit(buckets)).alias("_bucket"), "_row"),
        "shard-sent",
    )
    discard(rows)
    starts = (
        sent.groupBy("shard", "_bucket").count()
        .withColumn("_start", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("count")
    )
    inner = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(draw(3), "_row")) - 1
    return sent.withColumn("_inner", inner).join(starts, ["shard", "_bucket"]).select(id_col, "size", "text_crc32", "shard", (F.col("_start") + F.col("_inner")).alias("slot"))
