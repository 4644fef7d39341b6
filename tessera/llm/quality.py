"""Quality: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w.x - threshold_k): one vector of weights over hashed text features shared
by all grades, and thresholds in ascending order. Features are frequencies in 2**BITS buckets of
character n-grams of the text's shape (letters and digits stand for their kind, the rest for itself)
and of words that repeat one of the REPEATS words before them. The fit (on the driver, at most `max_rows` rated texts, MAX_ROWS by
default) maximises the likelihood with an L2 penalty; it gives each text its expected grade and its
tail probability P(grade >= cut), by which texts are selected. Texts longer than a slice are worked through
in blocks; 28 bytes for each of their words are held.

Defined results: a null or empty text has no features and the thresholds' own probabilities;
repeated rows each get a result; null grades are left out of the fit; a sample with one grade, or
none, gives that grade (or 0) with certainty and a tail probability of 1 or 0 by it (1 for none:
nothing is known against a text); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import ngram_blocks, slices, word_hashes
from tessera.llm.filters import keep_where
from tessera.llm.samples import labelled_texts

BITS = 14
MAX_ROWS = 8_000
LEAST = 0.25  # a text is rejected only where the model is fairly sure
PSEUDO = 30.0  # so many tokens without weight are added to every text
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:192] = 48, 65, 97, 127
_SHAPE[192:] = 97
_SHAPE[[9, 11, 12, 13]] = 32
REPEATS = 8  # a word is compared with so many before it
#: (codes, n-gram length) of each family; one more is the repeats.
FAMILIES = ((_SHAPE, 1), (_SHAPE, 2), (_SHAPE, 3), (_SHAPE, 5))


@dataclass
class Model:
    weights: np.ndarray  # float32, by family and bucket
    thresholds: np.ndarray  # ascending, one less than grades
    grades: list[int]

    def tail(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for each of the upper grades, a row for each text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - x[:, None], -500, 500)))


def tail_probability(model: Model, x: np.ndarray, cut: int) -> np.ndarray:
    """P(grade >= cut) by w.x."""
    upper = int(np.searchsorted(model.grades, cut))  # how many grades are below the cut
    if upper == 0 or not model.grades:
        return np.ones(len(x))
    return model.tail(x)[:, upper - 1] if upper < len(model.grades) else np.zeros(len(x))


def tokens(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(family, tokens' buckets, each text's first token); for a long text in blocks, so a family comes several times."""
    for k, (codes, n) in enumerate(FAMILIES):
        for bucket, first in ngram_blocks(codes, data, offsets, n, BITS):
            yield k, bucket, first
    h, first = word_hashes(data, offsets)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
    code = np.zeros(len(h), np.int32)
    for back in range(REPEATS, 0, -1):
        same = np.zeros(len(h), bool)
        same[back:] = (h[back:] == h[:-back]) & (text[back:] == text[:-back]) if len(h) > back else False
        code[same] = back
    yield len(FAMILIES), code, first


def total(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """w.x of each text."""
    weighed, count = np.zeros((len(FAMILIES) + 1, len(offsets) - 1)), np.zeros((len(FAMILIES) + 1, len(offsets) - 1))
    for k, bucket, first in tokens(data, offsets):
        sums = np.concatenate([[0.0], np.cumsum(model.weights[k << BITS :][: 1 << BITS][bucket], dtype=np.float64)])
        weighed[k] += sums[first[1:]] - sums[first[:-1]]
        count[k] += np.diff(first)
    return (weighed / (count + PSEUDO)).sum(0)


def frequencies(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its features, and their frequencies."""
    n = len(offsets) - 1
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(len(FAMILIES) + 1)]
    for k, bucket, first in tokens(data, offsets):
        if n == 1:  # maybe one of several blocks
            more = np.bincount(bucket, minlength=1 << BITS)
            found[k] = [(found[k][0][0] + more if found[k] else more, first)]
        else:
            found[k].append((bucket, first))
    for t in range(n):
        keys, values = [], []
        for k, ((bucket, first),) in enumerate(found):
            b, c = (np.flatnonzero(bucket), bucket[bucket > 0]) if n == 1 else np.unique(bucket[first[t] : first[t + 1]], return_counts=True)
            keys.append(b + (k << BITS))
            values.append(c / (c.sum() + PSEUDO))
        yield np.concatenate(keys).astype(np.int32), np.concatenate(values).astype(np.float32)


def fit_arrays(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, l2: float = 3e-5, rounds: int = 250) -> Model:
    """From the frequencies of the texts' features and the texts' grades."""
    size, n = (len(FAMILIES) + 1) << BITS, len(y)
    grades = sorted({int(g) for g in y})
    if len(grades) < 2:
        return Model(np.zeros(size, np.float32), np.zeros(0), grades)
    k = np.searchsorted(grades, y)
    mean = np.bincount(cols, values, size) / n
    scale = np.sqrt(np.maximum(np.bincount(cols, values.astype(np.float64) ** 2, size) / n - mean**2, 0))
    often = np.bincount(cols, minlength=size) >= 5
    inverse = np.where(often, 1 / (scale + 1e-4), 0)
    val = values * inverse[cols]
    shift = mean * inverse
    share = np.array([(k >= g).mean() for g in range(1, len(grades))])
    theta = -np.log(share / (1 - share))  # ascending, as the shares descend
    par = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-3))])  # first threshold, logs of the gaps
    w = np.zeros(size)
    state = [np.zeros(size), np.zeros(size), np.zeros(len(par)), np.zeros(len(par))]
    for step in range(1, rounds + 1):
        theta = par[0] + np.concatenate([[0], np.cumsum(np.exp(par[1:]))])
        x = np.bincount(rows, val * w[cols], n) - shift @ w
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta[None, :] - x[:, None], -50, 50))), np.zeros((n, 1))], 1)
        here = np.maximum(above[np.arange(n), k] - above[np.arange(n), k + 1], 1e-12)
        slope = above * (1 - above)  # of each tail probability by x
        lo, hi = slope[np.arange(n), k] / here, slope[np.arange(n), k + 1] / here
        gx = (lo - hi) / n
        g = np.bincount(cols, val * gx[rows], size) - shift * gx.sum() - l2 * w
        gt = np.zeros(len(theta) + 2)
        np.add.at(gt, k, -lo / n)
        np.add.at(gt, k + 1, hi / n)
        gt = gt[1:-1]
        gp = np.concatenate([[gt.sum()], np.cumsum(gt[::-1])[::-1][1:] * np.exp(par[1:])])
        rate = 0.03 * min(1, 2 * (1 - step / (rounds + 1)))
        for v, grad, m, s in ((w, g, state[0], state[1]), (par, gp, state[2], state[3])):  # Adam, uphill
            m += 0.1 * (grad - m)
            s += 0.01 * (grad**2 - s)
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    theta = par[0] + np.concatenate([[0], np.cumsum(np.exp(par[1:]))])
    return Model((w * inverse).astype(np.float32), theta + shift @ w, grades)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from labels (doc_id, quality, toxic): 0 poor, 1 well written but toxic, 2 well written and fit."""
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") < 1, 0).when(toxic, 1).otherwise(2).alias("grade"))


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "grade", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most max_rows rated texts; features are taken on the executors."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                cols, values = zip(*((c.tobytes(), v.tobytes()) for c, v in frequencies(data, offsets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], ["y", "cols", "vals"])

    known = labelled_texts(docs, ratings, grade_col, max_rows, id_col, text_col)
    got = known.select(F.col("label").cast("int"), "text").mapInArrow(features, "y int, cols binary, vals binary").toArrow()
    cols = [np.frombuffer(x.as_py(), np.int32) for x in got.column(1)]
    rows = np.repeat(np.arange(len(cols), dtype=np.int32), [len(c) for c in cols])
    values = np.concatenate([*(np.frombuffer(x.as_py(), np.float32) for x in got.column(2)), np.zeros(0, np.float32)])
    return fit_arrays(rows, np.concatenate([*cols, np.zeros(0, np.int32)]), values, got.column(0).to_numpy())


def grade(docs: DataFrame, model: Model, cut: int = 1, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, expected_grade double, tail_probability double: P(grade >= cut), kept boolean: that is `least` or more); narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        steps = np.diff(model.grades) if len(model.grades) > 1 else np.zeros(0)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                x = total(model, data, offsets)
                p, tail = model.tail(x), tail_probability(model, x, cut)
                expected = p @ steps + (model.grades[0] if model.grades else 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(expected.astype(float)), pa.array(tail), pa.array(tail >= least)], [id_col, "expected_grade", "tail_probability", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_grade double, tail_probability double, kept boolean")


def drop_low(docs: DataFrame, model: Model, cut: int = 1, least: float = LEAST, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the texts whose tail probability is below `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_where(docs, lambda data, offsets: tail_probability(shared.value, total(shared.value, data, offsets), cut) >= least, text_col)
