"""Token counts by a two-tier lookup at the map side.

Tier one is a compact table of the lengths, in tokens, of frequent pre-tokens, at most `table_size`
of them, that is broadcast. It is taken from about `sample_texts` texts (SAMPLE_TEXTS by default),
drawn at random; it decides how fast a token is counted, never what is counted. Tier two is each
worker's own bounded cache of what the table misses, filled by encoding. Pre-tokens are never
shuffled: the sampled texts are dealt to SAMPLE_PARTS tasks, each of which reports its
`table_size` most frequent ones to the driver.

Defined results: a null or empty text has 0 tokens and 0 bytes; repeated rows each get their
own result; other columns of the input are ignored; an empty input gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import CACHED_LENGTH, Recent, Vocabulary, vocabulary

SAMPLE_TEXTS, SAMPLE_PARTS = 10_000, 8
COUNTED = 200_000
LENGTHS_CACHED = 500_000
SEED = 20240607


def frequent_pretokens(docs: DataFrame, source, text_col: str, table_size: int, sample_texts: int = SAMPLE_TEXTS) -> list[str]:
    """The most frequent pre-tokens of a sample of the texts, table_size at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(source.value)
        seen: Counter[str] = Counter()
        cut = 0
        for batch in batches:
            for text in chain.from_iterable(batch.column(0).slice(at, 512).to_pylist() for at in range(0, batch.num_rows, 512)):
                for known, part in voc.pieces(text or ""):
                    if known is None:
                        for p in voc.parts(part):
                            seen.update(voc.pretokens(p))
                while len(seen) > COUNTED:  # in bounded memory: rare ones are forgotten
                    cut += 1
                    seen = Counter({t: c for t, c in seen.items() if c > cut})
        out = [(t, c) for t, c in seen.most_common(table_size) if len(t) <= CACHED_LENGTH]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([c for _, c in out], pa.int64())], ["token", "n"])

    texts = docs.select(text_col)
    n = texts.count()
    if n > sample_texts:
        texts = texts.sample(sample_texts / n, SEED)
    reports = texts.repartition(SAMPLE_PARTS).mapInArrow(count, "token string, n long").toArrow()
    total: Counter[str] = Counter()
    for token, found in zip(reports.column(0).to_pylist(), reports.column(1).to_pylist()):
        total[token] += found
    return [t for t, c in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:table_size] if c > 1]


class _Lengths(dict):
    """Tier one is the dict itself; a miss goes to tier two, the worker's cache of encoded pre-tokens."""

    def __init__(self, table: dict[str, int], voc: Vocabulary):
        super().__init__(table)
        self.recent = Recent(lambda t: len(voc.merge(t.encode())), LENGTHS_CACHED)

    def __missing__(self, token: str) -> int:
        return self.recent[token]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, table_size: int = 50_000, sample_texts: int = SAMPLE_TEXTS) -> DataFrame:
    """(id_col, n_bytes long, n_tokens long, over_limit boolean) of every whole text.

    Special strings inside a text count as one token each, as the library's default has it.
    One narrow pass over the texts, after one that draws the sample.
    """
    sc = docs.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    source = sc.broadcast(raw)
    voc = Vocabulary(raw)
    table = sc.broadcast({t: len(voc.merge(t.encode())) for t in frequent_pretokens(docs, source, text_col, table_size, sample_texts)})
    key = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(source.value)
        if voc.__dict__.get("lengths_of") != key:  # kept between the tasks of a worker
            voc.lengths, voc.lengths_of = _Lengths(table.value, voc), key
        get = voc.lengths.__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in chain.from_iterable(batch.column(1).slice(at, 512).to_pylist() for at in range(0, batch.num_rows, 512)):
                n = 0
                for known, part in voc.pieces(text or ""):
                    n += 1 if known is not None else sum(sum(map(get, voc.pretokens(p))) for p in voc.parts(part))
                n_tokens.append(n)
                n_bytes.append(len((text or "").encode()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
