import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from test_kernels import shingles

from tessera.llm import fingerprints as fp


def test_containment_of_unequal_texts():
    rng = random.Random(2)
    long_text = " ".join(f"w{rng.randrange(5000)}" for _ in range(8000))
    part = " ".join(long_text.split()[1000:1600])
    (a, _), (b, _) = fp.sketches(pa.array([long_text, part]))
    assert fp.containment(b, a) > 0.95 and abs(fp.containment(a, b) - 596 / 7996) < 0.03
    (c, _), = fp.sketches(pa.array([long_text + " x " + part]))
    assert set(fp.merge(a, b)) <= set(c) | set(a)
    assert np.array_equal(fp.decode(fp.encode(a)), a)


@pytest.mark.parametrize("bucket_rows", [3, 20_000])
def test_neighbours(spark, bucket_rows):
    rng = random.Random(4)
    data = [(i * 3, " ".join(f"W{rng.randrange(60)}é" for _ in range(rng.randrange(40)))) for i in range(120)] + [(1000, None), (1001, ""), (1002, "x"), (-5, "x")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in data], "doc_id long, text string, fingerprint int").repartition(6)
    got = {r["doc_id"]: r for r in fp.neighbour_fingerprints(docs, bucket_rows=bucket_rows).collect()}
    assert len(got) == len(data)
    order = sorted(data, reverse=True)
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert set(fp.decode(r["fingerprint"])) == set(next(fp.sketches(pa.array([t])))[0])
        assert r["edited_fingerprint"] == fp.encode(next(fp.sketches(pa.array([edited])))[0])
        a, b = shingles(t), shingles(edited)
        if len(a) > 25 and b:
            assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 0.6
    same = [r for r in got.values() if r["doc_id"] in (1002, -5)]
    assert same[0]["fingerprint"] == same[1]["fingerprint"]


def test_nulls_ties_and_empty(spark):
    schema = "doc_id long, text string"
    got = fp.neighbour_fingerprints(spark.createDataFrame([(None, "a b"), (1, "c"), (1, "d"), (None, None)], schema)).collect()
    assert sorted(((r["doc_id"], r["n_chars"]) for r in got), key=repr) == [(1, 1), (1, 1), (None, 0), (None, 3)]
    assert fp.neighbour_fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fp.neighbour_fingerprints(spark.createDataFrame([(4, "abcd")], schema)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    only_null = fp.neighbour_fingerprints(spark.createDataFrame([(None, "abcd")], schema)).first()
    assert only_null["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    plain = fp.fingerprint(spark.createDataFrame([(1, None, 3)], "doc_id long, text string, n_shingles int")).first()
    assert (plain["n_shingles"], plain["fingerprint"]) == (0, "")
