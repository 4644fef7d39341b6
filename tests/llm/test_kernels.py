"""The array kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import arrays
from tessera.llm.near_dedup import AGREE, SKETCH, band_hashes, signatures

TEXTS = ["", None, " ", "one", "One TWO three", "a b c d e", "a b c d e f", "ä ö\tü\nß é è", "x" * 5000, "w " * 3000, "é" * 9, "\u00a0 nbsp is\u00a0a word", "A B C D E"]


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("limit", [1, 7, 100, 1 << 20])
def test_slices_cover_all_rows(limit):
    col = pa.array(TEXTS).slice(1)
    got = [bytes(data[o[i] : o[i + 1]]) for a, b, data, o in arrays.slices(col, limit) for i in range(b - a)]
    assert got == [(t or "").encode() for t in TEXTS[1:]]


def test_shingle_sets_equal_plain_sets():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["aa", "b", "Cc", "é"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    got = [s for g in arrays.shingle_sets(pa.array(texts)) for s in g]
    plain = [shingles(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in plain]
    for i in range(0, len(texts), 7):
        for j in range(0, len(texts), 5):
            assert len(np.intersect1d(got[i], got[j])) == len(plain[i] & plain[j])


def test_ngrams_stay_inside_their_text():
    texts = ["abcd", "", "ab", "abc", "xabc"]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    bucket, first = arrays.ngram_buckets(data, off, 3, 18)
    assert np.diff(first).tolist() == [2, 0, 0, 1, 2]
    assert bucket[0] == bucket[2] == bucket[4] and bucket[0] != bucket[1]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for keep in (2000, 1800, 1500, 800):
        other = np.concatenate([base[:keep], rng.integers(0, 2**63, 2000 - keep, dtype=np.uint64)])
        sig = signatures([np.sort(base), np.sort(other)])
        true = keep / (4000 - keep)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.12
        if true >= 0.75:
            assert (sig[0, :SKETCH].astype(np.uint8) == sig[1, :SKETCH].astype(np.uint8)).sum() >= AGREE
            bands = band_hashes(sig)
            assert (bands[0] == bands[1]).any()
