"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Which n-grams of 4 and 5 characters (code points, in lower case; runs of anything but letters, marks
and digits as one space) a text has goes into 2**BITS buckets. Each bucket is scaled by the log of the
ratio of its smoothed counts in toxic and other texts; a logistic regression with an L1 penalty on the
scaled buckets is fitted on the driver from a sample of at most `max_rows` labelled texts (MAX_ROWS by
default) and at most `max_features` buckets (MAX_FEATURES by default), those whose ratio is surest among
the buckets that LEAST_TEXTS texts have. Scoring is one narrow pass over whole texts; a text longer than
a slice is worked through in blocks, and only its distinct buckets are held.

Defined results: a null or empty text scores as one without n-grams (the intercept); repeated rows
each get a result; labels other than 0 and 1 and null labels are left out of the fit; without both
classes in the sample the score is the (smoothed) share of label 1; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import SLICE_BYTES, ngram_buckets, slices
from tessera.llm.filters import keep_where
from tessera.llm.samples import labelled_texts
from tessera.llm.scratch import discard, written

BITS = 18
LENGTHS = (4, 5)
MAX_ROWS = 8_000
MAX_FEATURES = 20_000
LEAST_TEXTS = 3
BLANK = 32


@cache
def _folded() -> np.ndarray:
    """For each code point below 2**17: its lower case if it is a letter, mark or digit, else a space."""
    out = np.full(1 << 17, BLANK, np.uint32)
    for c in range(1 << 17):
        if unicodedata.category(chr(c))[0] in "LMN":
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


@dataclass
class Model:
    weights: np.ndarray  # float32 by bucket, the ratio included
    intercept: float


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points, runs of separators as one; each text's first. Planes above the second are letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bound = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    table = _folded()
    c = np.where(points < len(table), table[np.minimum(points, len(table) - 1)], points)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BLANK) | (c[:-1] != BLANK)
    keep[bound[:-1][bound[:-1] < len(c)]] = True
    return c[keep], np.concatenate([[0], np.cumsum(keep)])[bound]


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_codes at once, or for one text that is longer than a slice block by block, each after the last codes of the one before."""
    if len(offsets) != 2 or len(data) <= SLICE_BYTES:
        yield _codes(data, offsets)
        return
    before, lo = np.zeros(0, np.uint32), 0
    while lo < len(data):
        hi = min(lo + SLICE_BYTES, len(data))
        while hi < len(data) and data[hi] & 0xC0 == 0x80:  # inside a character
            hi += 1
        codes, _ = _codes(data[lo:hi], np.array([0, hi - lo]))
        if len(before) and len(codes) and before[-1] == BLANK == codes[0]:
            codes = codes[1:]
        codes = np.concatenate([before, codes])
        yield codes, np.array([0, len(codes)])
        before, lo = codes[len(codes) - min(len(codes), max(LENGTHS) - 1) :], hi


def presence(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs without repeats, sorted; only buckets where `wanted` is true."""
    found = []
    for codes, bound in _blocks(data, offsets):
        for n in LENGTHS:
            bucket, first = ngram_buckets(codes, bound, n, BITS)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            if wanted is not None:
                hit = wanted[bucket]
                bucket, text = bucket[hit], text[hit]
            found.append(text.astype(np.int64) << BITS | bucket)
        if len(offsets) == 2:
            found = [np.unique(np.concatenate(found))]
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, (pairs & ((1 << BITS) - 1)).astype(np.int32)


def choose(p: np.ndarray, q: np.ndarray, pos: int, n: int, max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The max_features buckets whose log-count ratio is surest, and their ratios, from counts in toxic (p) and other texts (q)."""
    ratio = np.log((p + 1) / (pos + 2)) - np.log((q + 1) / (n - pos + 2))
    strength = np.where(p + q >= LEAST_TEXTS, np.abs(ratio) / np.sqrt(1 / (p + 1) + 1 / (q + 1)), 0)
    chosen = np.argsort(-strength, kind="stable")[:max_features]
    chosen = np.sort(chosen[strength[chosen] > 0])
    return chosen, ratio[chosen]


def logistic(first: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, l1: float = 4e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1 logistic regression on which scaled buckets each text has, by accelerated proximal gradient.

    Text t has the buckets col[first[t] : first[t + 1]], with their ratios as values. Sums by text and
    by bucket are differences of running sums over the pairs in either order.
    """
    n, size = len(y), len(ratio)
    order = np.argsort(col, kind="stable")
    text = np.repeat(np.arange(n), np.diff(first))[order]
    ends = np.searchsorted(col[order], np.arange(size + 1))
    col = col.astype(np.intp)
    del order
    picked, total = np.empty(len(col)), np.zeros(len(col) + 1)

    def sums(values: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        np.take(values, at, out=picked, mode="clip")
        np.cumsum(picked, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    by_text = lambda z: sums(z * ratio, col, first)
    by_bucket = lambda e: sums(e, text, ends) * ratio
    prior = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(prior / (1 - prior)))
    v = np.ones(size) / np.sqrt(size)
    norm = 0.0
    for _ in range(15):  # the step is found by the norm of the matrix
        v = by_bucket(by_text(v))
        norm = np.linalg.norm(v)
        v /= norm or 1
    step = 1 / (0.25 * (norm / n) * 1.1 + 0.25)
    w, b, w0, b0, t = np.zeros(size), start, np.zeros(size), start, 1.0
    for _ in range(rounds):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        m = (t - 1) / t1
        z, c, t = w + m * (w - w0), b + m * (b - b0), t1
        err = 1 / (1 + np.exp(-(by_text(z) + c))) - y
        w0, b0 = w, b
        w = z - step * by_bucket(err) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = c - step * err.mean()
    return w, float(b)


def unfitted(pos: int, n: int) -> Model:
    """Without n-grams: the smoothed share of label 1."""
    prior = (pos + 0.5) / (n + 1)
    return Model(np.zeros(1 << BITS, np.float32), float(np.log(prior / (1 - prior))))


def score_arrays(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text, bucket = presence(data, offsets, model.weights != 0)
    total = np.bincount(text, model.weights[bucket], len(offsets) - 1) + model.intercept
    return 1 / (1 + np.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", max_features: int = MAX_FEATURES) -> Model:
    """A model of at most max_features buckets from at most max_rows labelled rows.

    N-grams are taken and counted on the executors; the driver gets the counts of the 2**BITS
    buckets, then the chosen buckets of each sampled text.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                text, bucket = presence(data, offsets)
                cut = np.searchsorted(text, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([bucket[cut[k] : cut[k + 1]].tobytes() for k in range(b - a)], pa.binary())], ["y", "buckets"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y][np.frombuffer(raw, np.int32)] += 1
        at = np.flatnonzero(seen.any(0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1][at]), pa.array(seen[0][at])], ["bucket", "p", "q"])

    known = labelled_texts(docs, labels.where(F.col(label_col).isin(0, 1)), label_col, max_rows, id_col, text_col)
    sample = written(known.select(F.col("label").cast("int"), "text").mapInArrow(features, "y int, buckets binary"), "toxicity-sample")
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = total["n"], total["pos"]
    if not pos or pos == n:
        discard(sample)
        return unfitted(pos, n)
    sums = sample.mapInArrow(counts, "bucket int, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where(f"p + q >= {LEAST_TEXTS}").toArrow()
    p, q = np.zeros(1 << BITS), np.zeros(1 << BITS)
    p[sums.column(0).to_numpy()], q[sums.column(0).to_numpy()] = sums.column(1).to_numpy(), sums.column(2).to_numpy()
    chosen, ratio = choose(p, q, pos, n, max_features)
    if not len(chosen):
        discard(sample)
        return unfitted(pos, n)

    small = np.uint16 if len(chosen) < 1 << 16 else np.int32  # places of chosen buckets, as they go to the driver

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            cols = [place[np.frombuffer(raw, np.int32)] for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[c >= 0].astype(small).tobytes() for c in cols], pa.binary())], ["y", "cols"])

    got = sample.mapInArrow(narrowed, "y int, cols binary").toArrow()
    discard(sample)
    y = got.column(0).to_numpy().astype(np.float64)
    parts = [np.frombuffer(x.as_py(), small) for x in got.column(1)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    w, b = logistic(first, np.concatenate(parts).astype(np.int32), ratio, y)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w * ratio
    return Model(weights, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score double in 0..1, predicted int: score >= 0.5) of every whole text; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                s = score_arrays(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the texts that score 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, lambda data, offsets: score_arrays(shared.value, data, offsets) < 0.5, text_col)
