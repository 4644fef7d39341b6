"""Near-duplicates by circulant MinHash: banding, then exact Jaccard similarity on the full sets.

Signatures: one permutation of the 32-bit numbers shuffles a text's shingle hashes, a second one,
shifted circularly by k, gives the k-th coordinate's minimum (both permutations are bijections of
0..2**32-1). With BANDS bands of ROWS coordinates a pair of similarity 0.75 shares no band with
probability 2e-6, one of 0.8 with 5e-9.

Texts with equal shingle sets are one class from the start, so copies are never compared or
paired. Within a bucket (classes that share a band) not all pairs are made: each class is
compared with the bucket's hub, the class that shares most bands with others. Where a bucket then
still holds several components, the best class off the hub's component becomes a further hub and is
compared with all that aren't in its component, for HUB_ROUNDS rounds (none, unless it is set) or until a round finds no link.
Classes that are off a bucket's largest component even then are compared with those of other components
on their full sets, in blocks of bounded size, so that no link that joins two components is missed
among the pairs that share a band; pairs that are joined by then aren't compared, none are written
but the links that join. Every link is confirmed on the full 64-bit sets.

Defined results: a text without words, or null, has an empty set, is linked with nothing and is
its own component; equal texts are linked; repeated ids are rows of their own, with one text or
several (a component's id is the least id in it, and two components may have the same); null ids
are ignored in that minimum, and a component of null ids only has a null id; exactly one row of
each component is kept, one of those with its id; other columns are ignored; an empty input gives
an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import mix, shingle_sets
from tessera.llm.scratch import discard, release, rounds, written
from tessera.operators.components import connected_components
from tessera.operators.hot import join_values

BANDS, ROWS, WIDTH = 48, 5, 5
SKETCH = 128  # coordinates kept, a byte each, to dismiss pairs before their sets are fetched
AGREE = 72  # of SKETCH; of a pair of similarity 0.75 fewer agree with probability 1e-6
BLOCK = 16_384  # shingles at once
STRAYS, OTHERS, BLOCK_SHINGLES = 256, 2_048, 2_000_000  # classes and hashes in a block of the second comparison
BROADCAST_IDS = 1_000_000
HUB_ROUNDS = 0  # each takes a dozen jobs, and 200 to 300 MB of an executor that has run many plans; it saves copies in the blocks


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(15)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """One row of `size` 32-bit minima for each non-empty set."""
    out = np.empty((len(sets), size), np.uint32)
    at = 0
    while at < len(sets):
        upto, n = at, 0
        while upto < len(sets) and (upto == at or n + len(sets[upto]) <= BLOCK):
            n += len(sets[upto])
            upto += 1
        flat = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        flat = _permute(flat, 0x7FEB352D, 0x846CA68B)
        start = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:upto]])[:-1]])
        shifted = np.empty_like(flat)
        for k in range(size):
            np.add(flat, np.uint32(k), out=shifted)
            out[at:upto, k] = np.minimum.reduceat(_permute(shifted, 0x85EBCA6B, 0xC2B2AE35), start)
        at = upto
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    acc = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(sig), 0)
    for r in range(rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + sig[:, r : bands * rows : rows].astype(np.uint64))
    return acc.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "n_shingles", "digest", "bands", "sketch"]
    for batch in batches:
        at = 0
        for group in shingle_sets(batch.column(1), WIDTH):
            full = [s for s in group if len(s)]
            sig = signatures(full) if full else np.empty((0, BANDS * ROWS), np.uint32)
            bands, sketch = band_hashes(sig), np.ascontiguousarray(sig[:, :SKETCH].astype(np.uint8))
            n = np.array([len(s) for s in group], np.int64)
            size = pa.array(np.concatenate([[0], np.cumsum((n > 0) * BANDS)]).astype(np.int32))
            lines = iter(sketch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(group)), batch.column(2).slice(at, len(group)), pa.array(n), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in group], pa.binary()),
                    pa.ListArray.from_arrays(size, pa.array(bands.ravel())), pa.array([next(lines).tobytes() if len(s) else b"" for s in group], pa.binary()),
                ],
                names,
            )
            at += len(group)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in shingle_sets(batch.column(0), WIDTH):
            bound = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in group])]).astype(np.int32))
            flat = np.concatenate(group).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in group], pa.binary()), pa.ListArray.from_arrays(bound, pa.array(flat))], ["digest", "shingles"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose two sketches agree in AGREE coordinates at least."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(1) >= AGREE))


class _Block:
    """The classes that meet in one block: strays on the left, others on the right."""

    def __init__(self, rows: list[tuple]):
        self.left = [r for r in rows if r[0]]
        right = [r for r in rows if not r[0]]
        self.node = np.array([r[1] for r in right], np.int64)
        self.root = np.array([r[2] for r in right], np.int64)
        self.size = np.array([len(r[6]) for r in right], np.int64)
        self.sets = [r[6] for r in right]
        self.bands = np.array([r[4] for r in right], np.int64).reshape(len(right), -1)
        self.sketch = np.frombuffer(b"".join(r[5] for r in right), np.uint8).reshape(len(right), SKETCH)
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            x = up
        return x

    def links(self) -> Iterator[tuple[int, int]]:
        """Confirmed links between components, no more than join them: what is joined already isn't compared.

        A pair that shares several bands is compared in the first of them only.
        """
        for _, a, label, band, bands, sketch, own in self.left if len(self.node) else ():
            at = np.flatnonzero((self.root != self.find(label)) & (100 * np.minimum(self.size, len(own)) >= 75 * np.maximum(self.size, len(own))))
            at = at[(self.sketch[at] == np.frombuffer(sketch, np.uint8)).sum(1) >= AGREE]
            at = at[bands[(self.bands[at] == bands).argmax(1)] == band] if len(at) else at
            for k in range(0, len(at), 64):
                part = at[k : k + 64]
                part = part[self.root[part] != self.find(label)]
                if not len(part):
                    continue
                flat = np.concatenate([self.sets[j] for j in part])
                place = np.searchsorted(own, flat)
                place[place == len(own)] = 0
                both = np.add.reduceat(own[place] == flat, np.concatenate([[0], np.cumsum(self.size[part])[:-1]]), dtype=np.int64)
                for j in part[100 * both >= 75 * (self.size[part] + len(own) - both)]:
                    x, y = self.find(label), int(self.root[j])
                    if x != y:
                        yield a, int(self.node[j])
                        self.parent[x] = y
                        self.root[self.root == x] = y


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links found in the blocks, whose rows come sorted by key; one block is held at a time."""
    key, rows, found = None, [], []
    for batch in batches:
        keys, stray, node, label, band = (batch.column(k).to_pylist() for k in range(5))
        sketch = batch.column(6).to_pylist()
        lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column(5), batch.column(7))]
        for k in range(batch.num_rows):
            if keys[k] != key:
                found += _Block(rows).links() if len(rows) > 1 else ()
                key, rows = keys[k], []
            bands, own = (v[o[k] : o[k + 1]].copy() for v, o in lists)
            rows.append((stray[k], node[k], label[k], band[k], bands, sketch[k], own.view(np.uint64)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])
            found = []
    found += _Block(rows).links() if len(rows) > 1 else ()
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def _full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles array<long>) of the classes in nodes (node, distinct), from one text of each; written."""
    used = written(nodes.join(classes, "node").select("node", "keeper_id", "digest"), "used")
    ids = used.select(F.col("keeper_id").alias("_wanted")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    wanted = F.broadcast(ids) if used.count() <= BROADCAST_IDS else ids  # else both sides are shuffled
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi")
    sets = texts.select("_text").mapInArrow(_sets, "digest binary, shingles array<long>")
    out = written(used.select("node", "digest").join(sets, "digest").dropDuplicates(["node"]).select("node", "shingles"), "sets")
    discard(used)
    return out


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= 75 * union; written. pairs is written already."""
    sets = _full_sets(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), classes, docs, id_col, text_col)
    both = (
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a")), "a")
        .select("a", "b", F.size("_a").alias("n_a"), F.size("_b").alias("n_b"), F.size(F.array_intersect("_a", "_b")).alias("n"))
    )
    out = written(both.where("100 * n >= 75 * (n_a + n_b - n)").select("a", "b"), "links")
    discard(sets)
    return out


def open_buckets(members: DataFrame, done: DataFrame, component: DataFrame, light: DataFrame) -> DataFrame:
    """(band, node, label, stray, level): what is left of buckets, without done (band, node), which were compared with all, where that is several components; written.

    A stray is off the component that has most of it. Classes whose sizes are within a factor of 4/3
    are of the same level or of neighbouring ones.
    """
    labelled = members.join(done, ["band", "node"], "left_anti").join(component, "node", "left").select("band", "node", F.coalesce("component", "node").alias("label"))
    parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "label")).alias("most"))
    mixed = parts.where("parts > 1").select("band", F.col("most.label").alias("main"))
    level = F.floor(F.log("n_shingles") / F.log(F.lit(4 / 3))).cast("int")
    rows = labelled.join(mixed, "band").join(light.select("node", "n_shingles"), "node")
    return written(rows.select("band", "node", "label", (F.col("label") != F.col("main")).alias("stray"), level.alias("level")), "open")


def away_from_hubs(open_: DataFrame, light: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that join components of open buckets: all that there are, up to links that join nothing more; written.

    Strays meet the others of their bucket and level in blocks of STRAYS by OTHERS, and of at most
    some BLOCK_SHINGLES, dealt by hash: a bucket of any size is many small groups, and a block
    gives no more links than it has components. The hubs have been compared with all.
    """
    n_parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stray = open_.where("stray").select("band", "node", "label", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"))
    other = open_.select("band", "node", "label", "level")
    room = F.greatest(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(4 / 3), F.col("level") + 1.0), F.lit(8.0))
    sizes = stray.groupBy("band", "level").agg(F.count(F.lit(1)).alias("_s")).join(other.groupBy("band", "level").agg(F.count(F.lit(1)).alias("_o")), ["band", "level"])
    blocks = lambda n, most: F.ceil(F.col(n) / F.least(room, F.lit(float(most)))).cast("int")
    sizes = written(sizes.select("band", "level", blocks("_s", STRAYS).alias("s_blocks"), blocks("_o", OTHERS).alias("o_blocks")), "block-sizes")

    def dealt(side: DataFrame, own: str, across: str, flag: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")  # hashes of an int and of a long differ
        theirs = F.explode(F.sequence(F.lit(0), F.col(across) - 1))
        placed = side.join(sizes, ["band", "level"]).select("*", theirs.alias("_across"), mine.alias("_mine"))
        key = ("_mine", "_across") if flag else ("_across", "_mine")
        return placed.select(F.xxhash64("band", "level", *key).alias("key"), F.lit(flag).alias("stray"), "node", "label", "band")

    rows = dealt(stray, "s_blocks", "o_blocks", True).unionByName(dealt(other, "o_blocks", "s_blocks", False))
    full = rows.join(light.select("node", "bands", "sketch").join(sets, "node"), "node").select("key", "stray", "node", "label", "band", "bands", "sketch", "shingles")
    out = written(full.repartition(n_parts, "key").sortWithinPartitions("key").mapInArrow(_across, "a long, b long"), "late-links")
    discard(sizes)
    return out


def _text_key(text_col: str) -> Column:
    """Tells the texts of one id apart: 96 bits."""
    return F.struct(F.xxhash64(text_col).alias("x"), F.hash(text_col).alias("m"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles long, component_id, kept boolean) of every row, by links of Jaccard similarity 0.75 or more."""
    return _marked(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "kept")


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    described = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _text_key(text_col).alias("text_key")).mapInArrow(
        _describe, f"doc_id {id_type}, text_key struct<x: long, m: int>, n_shingles long, digest binary, bands array<long>, sketch binary"
    )
    rows = written(described.withColumn("row", F.monotonically_increasing_id()), "described")
    classes_of = rows.where("n_shingles > 0").groupBy("digest").agg(_least("doc_id", "row").alias("first"))  # a class's node is its row with the least id
    classes = written(
        rows.join(classes_of.select("first.row"), "row").select(F.col("row").alias("node"), F.col("doc_id").alias("keeper_id"), "digest", "n_shingles", "bands", "sketch"),
        "classes",
    )
    # buckets of two classes or more, and their members
    banded = classes.select("node", F.explode("bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    members = written(banded.join(shared, "band"), "members")
    score = written(members.groupBy("node").agg(F.sum("n").alias("score")), "score")
    hubs = written(members.join(score, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("top")).select("band", F.col("top.node").alias("hub")), "hubs")
    pairs = members.join(hubs, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    light = classes.select("node", "n_shingles", "bands", "sketch")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        a, b = (light.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        return pairs.join(b, "b").join(a, "a").where("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)").select("a", "b", "sketch_a", "sketch_b")

    likely = written(with_sketches(pairs).mapInArrow(_agreeing, "a long, b long"), "pairs")
    links = first_links = _confirmed(likely, classes, docs, id_col, text_col)
    component = connected_components(links)

    done = hubs.select("band", F.col("hub").alias("node"))
    open_ = open_buckets(members, done, component, light)
    further: list[DataFrame] = []
    for _ in range(HUB_ROUNDS):
        if open_.where("stray").isEmpty():
            break
        strays = open_.where("stray").join(score, "node")
        more = written(strays.groupBy("band").agg(F.max(F.struct("score", "node", "label")).alias("top")).select("band", F.col("top.node").alias("hub"), F.col("top.label").alias("own")), "hubs")
        pairs = open_.join(more, "band").where("label <> own").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        found = written(with_sketches(pairs).mapInArrow(_agreeing, "a long, b long"), "pairs")
        new = _confirmed(found, classes, docs, id_col, text_col)
        discard(found)
        further += [more, new]
        done = done.unionByName(more.select("band", F.col("hub").alias("node")))
        if new.isEmpty():
            discard(open_)
            open_ = open_buckets(members, done, component, light)
            break
        links = links.unionByName(new)
        joined = connected_components(links)
        discard(component, open_)
        component = joined
        open_ = open_buckets(members, done, component, light)
    if not open_.where("stray").isEmpty():
        sets = _full_sets(open_.select("node").distinct(), classes, docs, id_col, text_col)
        late = away_from_hubs(open_, light, sets)
        if not late.isEmpty():
            joined = connected_components(links.unionByName(late))
            discard(component)
            component = joined
        discard(sets, late)
    discard(open_, shared, members, score, hubs, likely, first_links, *further)

    # the least id of each component and the row that is kept, for each class
    labels = written(classes.select("node", "keeper_id", "digest").join(component, "node", "left").select("node", "keeper_id", "digest", F.coalesce("component", "node").alias("label")), "labels")
    least = written(labels.groupBy("label").agg(_least("keeper_id", "node").alias("first")), "least")
    named = written(join_values(labels, least, "label").select("digest", F.col("first.keeper_id").alias("component_id"), F.col("first.node").alias("keeper")), "named")
    discard(labels, least, component, classes)
    out = join_values(rows.select("doc_id", "text_key", "n_shingles", "digest", "row"), named, "digest")
    own = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "text_key", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), (own | (F.col("row") == F.col("keeper"))).alias("kept")
    )


def _least(id_col: str, row_col: str) -> Column:
    """The least (id, row), null ids last."""
    return F.min(F.struct(F.col(id_col).isNull().alias("none"), id_col, row_col))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with exactly one row of each component: one with the least id.

    Rows are told apart by id, null or not, and text; equal in both, one of them is kept, found by a
    second join only if there are such rows. What goes is broadcast up to BROADCAST_IDS rows of it,
    else both sides are shuffled.
    """
    with rounds() as made:
        found = written(_marked(docs, id_col, text_col), "near-duplicates")
    release(made, found)
    gone_id, gone_x, gone_m = (f"_gone_{uuid.uuid4().hex}" for _ in range(3))  # no names of docs
    keys = found.groupBy(F.col("doc_id").alias(gone_id), F.col("text_key.x").alias(gone_x), F.col("text_key.m").alias(gone_m)).agg(
        F.max(F.col("kept").cast("int")).alias("any"), F.min(F.col("kept").cast("int")).alias("all")
    )
    keys = written(keys.where("all = 0"), "gone")
    discard(found)
    key = _text_key(text_col)
    same = F.col(id_col).eqNullSafe(F.col(gone_id)) & (key["x"] == F.col(gone_x)) & (key["m"] == F.col(gone_m))
    gone, again = keys.where("any = 0").drop("any", "all"), keys.where("any = 1").drop("any", "all")
    left = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, same, "left_anti")
    n_again = again.count()
    if n_again == 0:
        return left
    if n_again <= BROADCAST_IDS:
        again = F.broadcast(again)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
