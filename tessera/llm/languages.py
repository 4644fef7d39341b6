"""Language identification by multilingual mixtures.

Each language has a distribution over character trigrams within words (word ends count as
characters; A-Z and the Latin-1 capitals lower-cased; 2**BITS buckets). A text is a mixture: each
of its words comes from one language. Expectation-maximisation estimates the languages'
proportions from the words' trigram likelihoods; the language set is the one, among the leading 1, 2, 3, ...
up to all languages, whose log-likelihood less PENALTY * log(1 + words) for each language more is
highest. A text's search ends where no larger set can be better: no set's log-likelihood is above the
whole mixture's by more than words * log(g), g the largest gradient of the mean log-likelihood by a
share. The prediction is the set's largest share, the score is that share.

The fit counts trigrams on the executors, over about `per_language` texts of each language
(PER_LANGUAGE by default), taken by hash at a rate that follows from the language's own count. The
model has 2**BITS numbers for each language and goes to every worker, so more than MAX_LANGUAGES
languages are an error.

A worker holds the likelihoods of a slice's words by all languages; slices are shorter the more
languages there are. A text longer than a slice is read in blocks (a word that goes on after a block
is two), and its words are taken once each, with their numbers.

Defined results: a text that is null or has no letter is `und` with score 0 and no languages; so
is every text if no language was learned. Null languages are left out of the fit. Repeated rows
each get a result; ties go to the language that comes first by name; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import _BYTES, SLICE_BYTES, ngram_buckets, slices, span_hashes, spans

BITS = 15
PER_LANGUAGE = 2_000
MAX_LANGUAGES = 500
PENALTY = 3.0
ROUNDS = 8
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:256] = True


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # float32, language x bucket


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with a space before each and after the last, letters folded and the rest blank; the words' starts and ends."""
    code = np.insert(data, offsets, 32)
    letter = _LETTER[code]
    latin = np.zeros(len(code), bool)
    latin[1:] = (code[:-1] == 0xC3) & (code[1:] >= 0x80) & (code[1:] <= 0x9E) & (code[1:] != 0x97)
    code = np.where((code >= 65) & (code <= 90) | latin, code + np.uint8(32), code)
    code[~letter] = 32
    return code, *spans(letter, np.array([0, len(code)]))


def word_trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all texts, the words' first and last trigrams, each text's first word."""
    code, start, end = _folded(data, offsets)
    bucket, _ = ngram_buckets(code, np.array([0, len(code)]), 3, BITS)
    first = np.searchsorted(start, offsets + np.arange(len(offsets)))
    return bucket, start - 1, end - 1, first


def _blocks(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most `limit` bytes that end between words, or inside a word that is longer."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        if hi < len(data):
            breaks = np.flatnonzero(~_LETTER[data[lo:hi]])
            hi = lo + int(breaks[-1]) + 1 if len(breaks) else hi
        yield lo, hi
        lo = hi


def count_trigrams(texts: pa.Array) -> np.ndarray:
    out = np.zeros(1 << BITS, np.int64)
    for _, _, data, offsets in slices(texts):
        for a, b in _blocks(data, SLICE_BYTES) if len(data) > SLICE_BYTES and len(offsets) == 2 else [(0, len(data))]:
            bucket, lo, hi, _ = word_trigrams(data[a:b], np.array([0, b - a]) if b - a < len(data) else offsets)
            inside = np.zeros(len(bucket) + 1, np.int32)
            np.add.at(inside, lo, 1)
            np.add.at(inside, hi, -1)
            out += np.bincount(bucket[np.cumsum(inside[:-1]) > 0], minlength=1 << BITS)
    return out


def slice_bytes(model: Model) -> int:
    """So many bytes at once that their words' likelihoods stay small."""
    return max(1 << 14, SLICE_BYTES * 8 // max(8, len(model.languages)))


def _likelihoods(model: Model, bucket: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """words x languages: log-likelihoods."""
    ll = np.empty((len(lo), len(model.languages)))
    for k in range(len(model.languages)):
        total = np.concatenate([[0.0], np.cumsum(model.logp[k][bucket], dtype=np.float64)])
        ll[:, k] = total[hi] - total[lo]
    return ll


def _words(model: Model, data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihoods of words, how often each stands there, each text's first word. A long text has each word once."""
    if len(offsets) != 2 or len(data) <= limit:
        bucket, lo, hi, first = word_trigrams(data, offsets)
        return _likelihoods(model, bucket, lo, hi), np.ones(len(lo)), first
    seen, often, ll = np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, len(model.languages)))
    for a, b in _blocks(data, limit):
        code, start, end = _folded(data[a:b], np.array([0, b - a]))
        words, at, back = np.unique(span_hashes(_BYTES[code], start, end), return_index=True, return_inverse=True)
        more = np.bincount(back, minlength=len(words)).astype(float)
        place = np.searchsorted(seen, words)
        old = np.zeros(len(words), bool)
        old[place < len(seen)] = seen[place[place < len(seen)]] == words[place < len(seen)]
        often[place[old]] += more[old]
        bucket, _ = ngram_buckets(code, np.array([0, len(code)]), 3, BITS)
        new = at[~old]
        both = np.concatenate([seen, words[~old]])
        order = np.argsort(both, kind="stable")
        seen, often = both[order], np.concatenate([often, more[~old]])[order]
        ll = np.concatenate([ll, _likelihoods(model, bucket, start[new] - 1, end[new] - 1)])[order]
    return ll, often, np.array([0, len(seen)])


def model_of(languages: list[str], counts: np.ndarray) -> Model:
    """Smoothed log probabilities from a row of trigram counts for each language."""
    p = counts + 0.5
    return Model(languages, np.log(p / p.sum(1, keepdims=True)).astype(np.float32) if len(languages) else np.zeros((0, 1 << BITS), np.float32))


def _mixture(lik: np.ndarray, often: np.ndarray, text: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from `share` (texts x languages): the proportions, and each word's log of its mixed likelihood, as often as it stands there. Every text has words."""
    n = np.add.reduceat(often, first[:-1])[:, None]
    for _ in range(rounds):
        part = share[text] * lik
        part *= (often / part.sum(1))[:, None]
        share = np.maximum(np.add.reduceat(part, first[:-1], axis=0) / n, 1e-9)
    return share, often * np.log((share[text] * lik).sum(1))


def proportions(model: Model, data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """texts x languages: the shares of the selected languages, 0 elsewhere; all 0 for a text without words."""
    n, size = len(offsets) - 1, len(model.languages)
    out = np.zeros((n, size))
    if not size:
        return out
    ll, often, first = _words(model, data, offsets, limit)
    has = np.flatnonzero(np.diff(first))
    if not len(has):
        return out
    bound = np.concatenate([first[has], first[-1:]])
    rows = np.diff(bound)
    words = np.add.reduceat(often, bound[:-1])
    text = np.repeat(np.arange(len(has)), rows)
    ll -= ll.max(1)[:, None]
    lik = np.maximum(np.exp(ll, out=ll), 1e-30, out=ll)
    share, mixed = _mixture(lik, often, text, bound, np.full((len(has), size), 1 / size), ROUNDS)
    order = np.argsort(-share, axis=1, kind="stable")
    # what any set can reach, less nothing for its languages (by Jensen's inequality; shares sum to 1 up to their floor)
    gradient = np.add.reduceat(lik * (often / np.exp(mixed / often))[:, None], bound[:-1], axis=0).max(1) / words
    reach = np.minimum(np.add.reduceat(mixed, bound[:-1]) + words * np.log(gradient), 0.0) + 1e-6 * words
    best = np.full(len(has), -np.inf)
    for k in range(1, size + 1):
        cost = PENALTY * (k - 1) * np.log1p(words)
        left = reach - cost > best
        at = np.flatnonzero(left)
        if not len(at):
            break
        chosen = order[at, :k]
        of = np.repeat(np.arange(len(at)), rows[at])
        ends = np.concatenate([[0], np.cumsum(rows[at])])
        part = np.take_along_axis(lik[left[text]], chosen[of], 1)
        start = np.take_along_axis(share[at], chosen, 1)
        got, mixed = _mixture(part, often[left[text]], of, ends, start / start.sum(1, keepdims=True), ROUNDS if k > 1 else 0)
        value = np.add.reduceat(mixed, ends[:-1]) - cost[at]
        better = value > best[at]
        at = at[better]
        best[at] = value[better]
        out[has[at]] = 0
        out[has[at][:, None], chosen[better]] = got[better]
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram distributions of the languages in lang_col, from about per_language texts of each."""
    known = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return model_of([], np.zeros((0, 1 << BITS)))
    languages = sorted(sizes)
    of = {lang: k for k, lang in enumerate(languages)}
    rates = known.sparkSession.createDataFrame([(lang, k, min(1.0, per_language / sizes[lang])) for lang, k in of.items()], "lang string, k int, rate double")
    taken = known.join(F.broadcast(rates), "lang").where((F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("rate")).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for k in np.unique(kinds):
                got = count_trigrams(batch.column(1).filter(pa.array(kinds == k)))
                total[k] = total[k] + got if k in total else got
        for k, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(got[at])], ["k", "bucket", "n"])

    rows = taken.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), 1 << BITS))
    counts[rows.column(0).to_numpy(), rows.column(1).to_numpy()] = rows.column(2).to_numpy()
    return model_of(languages, counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred string, score double, languages map<string,double>: the selected set's shares); narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        limit = slice_bytes(model)
        for batch in batches:
            lettered = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column(1), limit):
                got = proportions(model, data, offsets, limit)
                ok = lettered[a:b] & (got.sum(1) > 0) if len(model.languages) else np.zeros(b - a, bool)
                best = got.argmax(1) if len(model.languages) else np.zeros(b - a, int)
                langs = [model.languages[k] if good else UNKNOWN for k, good in zip(best, ok)]
                score = [min(1.0, float(got[i, k])) if ok[i] else 0.0 for i, k in enumerate(best)]
                sets = [[(model.languages[k], float(row[k])) for k in np.flatnonzero(row)] if good else [] for row, good in zip(got, ok)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], [id_col, "lang_pred", "score", "languages"])

    kind = docs.schema[id_col].dataType.simpleString()
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    return docs.select(id_col, text_col, lettered).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, languages map<string,double>")
