"""Threshold-scaled document fingerprints: every shingle hash below a fixed fraction is kept.

The share of hashes that is kept does not depend on a text's length, so sketches of very unequal
texts can be compared and merged: the sketch of a union is the union of the sketches, and the
share of a sketch found in another estimates containment. A sketch is a string: base64 of the
sorted hashes as little-endian unsigned 64-bit integers.

Words are runs without ASCII white space, A-Z lower-cased; a shingle is five words, or all of them
where a text has fewer. Defined results: a null text is an empty one; an empty text has the empty
sketch; two empty sketches are alike (1.0) if the texts' shingle sets are both empty or equal,
else 0.0; repeated rows each get a result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tessera.llm.arrays import shingle_sets

FRACTION = 0.25
BUCKET_ROWS = 20_000
MAX_BUCKETS = 100_000
SAMPLED = 20  # ids looked at for each range, to cut them
FLUSH_ROWS, FLUSH_CHARS = 2_000, 500_000  # texts that wait for their fingerprints in a worker


def sketches(texts: pa.Array, fraction: float = FRACTION, width: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sketch, all shingle hashes) of each text: a sketch has the hashes below fraction * 2**64."""
    limit = np.uint64(min(int(fraction * 2.0**64), 2**64 - 1))
    for group in shingle_sets(texts, width):
        for full in group:
            yield full[: np.searchsorted(full, limit)], full


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated Jaccard similarity of the shingle sets; 0 where both sketches are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def fingerprint(docs: DataFrame, fraction: float = FRACTION, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles long, fingerprint string) of every whole text; narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for sketch, full in sketches(batch.column(1), fraction, width):
                n.append(len(full))
                out.append(encode(sketch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.string())], [id_col, "n_shingles", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_shingles long, fingerprint string")


def _short(texts: list[str], fraction: float, width: int) -> list[tuple[np.ndarray, bytes]]:
    """(sketch, what tells the whole set from others where the sketch is empty) of each text."""
    return [(sketch.copy(), b"" if len(sketch) else full.tobytes()) for sketch, full in sketches(pa.array(texts, pa.large_string()), fraction, width)]


def _alike(a: tuple, b: tuple) -> float:
    """Likeness of two (sketch, whole set) pairs; where both sketches are empty, whether the sets are equal."""
    if not len(a[0]) and not len(b[0]):
        return float(a[1] == b[1])
    return likeness(a[0], b[0])


def _cuts(ids: DataFrame, n: int, n_buckets: int) -> list[int]:
    """Ids that exist, in descending order, the largest first: range k has the ids in (cuts[k + 1], cuts[k]].

    They are quantiles of a sample of distinct ids taken by hash, about SAMPLED for each range, on the driver.
    """
    rate = SAMPLED * n_buckets / n
    some = ids.where("id is not null")
    if rate < 1:
        top = ids.agg(F.max("id")).first()[0]
        some = some.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    found = np.sort(some.distinct().toArrow().column(0).to_numpy().astype(np.int64))
    if rate < 1:
        found = np.union1d(found, [top])
    at = (len(found) * np.arange(1, n_buckets + 1)) // n_buckets - 1
    return sorted({int(found[k]) for k in at if k >= 0} | {int(found[-1])}, reverse=True)


def _range_of(cuts: list[int], id_: Column) -> tuple[Column, Column]:
    """Which range an id is in, and the cut that it begins with: a search on two levels, inside the JVM."""
    side = max(1, math.isqrt(len(cuts)))
    longs = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<long>")  # noqa: E731  one literal, after constant folding
    edges = longs(cuts)
    block = F.size(F.filter(longs(cuts[::side]), lambda c: c >= id_)) - 1
    inside = F.size(F.filter(F.slice(edges, block * side + 1, side), lambda c: c >= id_))
    own = (block * side + inside - 1).cast("int")
    return own, F.element_at(edges, own + 1)


def neighbour_fingerprints(docs: DataFrame, fraction: float = FRACTION, width: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likeness to that and to the next text.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next text, by descending id (an integer; nulls last; equal ids by text); the last is followed
    by the first. Returns (id_col, n_chars long, edited_sha256, fingerprint, edited_fingerprint string,
    near_edited, near_next double).

    One shuffle of the texts: ids are cut into ranges of about bucket_rows rows (larger ones beyond
    MAX_BUCKETS ranges). Each cut is an id that exists, so the first text of a range is known in
    the scan and is sent to the range before as well; every range is sorted, by spilling where it is
    large, and read in order with one row kept back. A worker holds FLUSH_ROWS texts or FLUSH_CHARS
    characters at a time, or one longer text and its neighbour.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer to be put in order")
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    total = ids.agg(F.count("id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(1, min(MAX_BUCKETS, max(math.ceil(total["n"] / bucket_rows), min(4 * n_parts, total["n"] // 50))))
    cuts = _cuts(ids, total["n"], n_buckets) if total["n"] else []
    nulls = total["n"] != total["all"]  # null ids are a range of their own, the last
    last = len(cuts) - 1 + nulls
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    if cuts:
        own, cut = _range_of(cuts, F.col("id"))
        rows = rows.withColumn("own", F.when(F.col("id").isNull(), last).otherwise(own)).withColumn("first", F.col("id").isNotNull() & (cut == F.col("id")))
        before = F.when(F.col("first"), F.when(F.col("own") == 0, F.lit(last)).otherwise(F.col("own") - 1))
        if nulls:  # the first null follows the smallest id
            before = F.when(F.col("own") == last, F.lit(last - 1)).otherwise(before)
        places = F.array_compact(F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("extra")), F.when(before.isNotNull(), F.struct(before.alias("range"), F.lit(1).alias("extra")))))
        rows = rows.select("id", "text", F.inline(places))
    else:
        rows = rows.select("id", "text", F.lit(last).alias("range"), F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (id, text) that waits for the next text
        pending: list[tuple] = []

        def done() -> pa.RecordBatch:
            texts = [t for _, t, _ in pending]
            edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for _, t, u in pending]
            chained = [k + 1 < len(texts) and texts[k + 1] is u for k, (_, _, u) in enumerate(pending)]
            n_chars, sha = [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited]
            b = _short(edited, fraction, width)
            edited.clear()
            others = iter(_short([u for (_, _, u), on in zip(pending, chained) if not on], fraction, width))
            a = _short(texts, fraction, width)
            c = [a[k + 1] if on else next(others) for k, on in enumerate(chained)]
            cols = [
                pa.array([i for i, _, _ in pending], pa.int64()), pa.array(n_chars, pa.int64()), pa.array(sha), pa.array([encode(x) for x, _ in a]), pa.array([encode(x) for x, _ in b]),
                pa.array([_alike(x, y) for x, y in zip(a, b)], pa.float64()), pa.array([_alike(x, y) for x, y in zip(a, c)], pa.float64()),
            ]
            pending.clear()
            return pa.RecordBatch.from_arrays(cols, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        closed = None  # the range whose extra row has come
        size = 0
        for batch in batches:
            where, extra = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            for k in range(batch.num_rows):
                if where[k] == closed:
                    continue  # more rows with the id of the next range's first
                text = batch.column(1)[k].as_py() or ""
                if held is not None:
                    pending.append((*held, text))
                    size += len(held[1]) + len(text)
                held = (batch.column(0)[k].as_py(), text)
                if extra[k]:
                    held, closed = None, where[k]
                if size > FLUSH_CHARS or len(pending) >= FLUSH_ROWS:
                    yield done()
                    size = 0
        if pending:
            yield done()

    placed = rows.repartition(max(n_parts, math.ceil(n_buckets / 4)), "range").sortWithinPartitions("range", "extra", F.col("id").desc_nulls_last(), "text")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = placed.mapInArrow(run, schema)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *out.columns[1:])
