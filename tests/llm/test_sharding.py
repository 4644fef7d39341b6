import random
import zlib
from collections import Counter

import pytest

from tessera.llm.sharding import communication_matrix, hypergeometric, shuffle_shards


def test_hypergeometric_law():
    rng = random.Random(5)
    n = 40_000
    got = Counter(hypergeometric(rng, 5, 7, 4) for _ in range(n))
    from math import comb

    for k in range(5):
        assert abs(got[k] / n - comb(5, k) * comb(7, 4 - k) / comb(12, 4)) < 0.01
    assert 0 < hypergeometric(rng, 5 * 10**9, 35 * 10**9, 10**6) < 10**6


def test_matrix_margins():
    m = communication_matrix([10, 0, 3, 17], [8, 8, 7, 7], 1)
    assert [sum(r) for r in m] == [10, 0, 3, 17] and [sum(c) for c in zip(*m)] == [8, 8, 7, 7]


@pytest.mark.parametrize("bucket_rows", [10, 100_000])
def test_exact_sizes_and_gapless_slots(spark, bucket_rows):
    data = [(i if i % 50 else None, None if i % 9 == 0 else "é" * (i % 5), "s") for i in range(1003)]
    docs = spark.createDataFrame(data, "doc_id long, text string, shard string").repartition(7)
    got = shuffle_shards(docs, 8, bucket_rows=bucket_rows).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in data)
    by = Counter(r["shard"] for r in got)
    assert sorted(by) == list(range(8)) and max(by.values()) - min(by.values()) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    size = {d: 1 + len((t or "").encode()) for d, t, _ in data if d is not None}
    assert all(r["size"] == size[r["doc_id"]] for r in got if r["doc_id"] is not None)
    crc = {d: zlib.crc32((t or "").encode()) for d, t, _ in data if d is not None}
    assert all(r["text_crc32"] == crc[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_repeated_rows(spark):
    """Equal rows, ids included, are rows of their own."""
    docs = spark.createDataFrame([(1, "a")] * 20 + [(None, None)] * 5, "doc_id long, text string").repartition(3)
    got = shuffle_shards(docs, 4).collect()
    assert len(got) == 25 and len({(r["shard"], r["slot"]) for r in got}) == 25 and sorted(Counter(r["shard"] for r in got).values()) == [6, 6, 6, 7]


def test_uniform(spark):
    """Over many seeds a row is in each shard, and first in it, about as often as any other."""
    docs = spark.createDataFrame([(i, "t") for i in range(6)], "doc_id long, text string")
    seen, first = Counter(), Counter()
    for seed in range(40):
        for r in shuffle_shards(docs, 2, seed=seed).collect():
            seen[r["doc_id"], r["shard"]] += 1
            first[r["doc_id"]] += r["slot"] == 0
    assert all(8 <= n <= 32 for n in seen.values()) and len(seen) == 12
    assert all(3 <= first[i] <= 27 for i in range(6)) and sum(first.values()) == 80


def test_empty(spark):
    assert shuffle_shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0
