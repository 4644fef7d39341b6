"""Benchmark decontamination by templates: numbers, names and units become typed placeholders.

A text's tokens are runs of letters or of digits (A-Z and the Latin-1 capitals lower-cased).
Placeholders: a number (with its decimals and thousands as one token), a unit (a word of UNITS right
after a number) and a name (a word whose first letter, only, is a capital, wherever it stands, so
that a passage has the same template inside any sentence). Windows of WINDOW template tokens, of
which at least LITERALS are plain words, are hash-joined with the benchmark's; an item with fewer
tokens has one window of them all (with one plain word less than it has tokens at least, and LITERALS at most).
Each document and item that share a window are then laid side by side along the shared windows, a run
for each alignment, and the slots are checked: a re-parameterised question replaces a value by one other
value throughout, and different values by different ones (units only the former). Runs, the longest
first, are taken together as long as one such mapping of values holds for them; windows with a slot that
contradicts it don't count, and a run with more than TOLERATED of its slots so is no match. A document is contaminated by an item if the windows of runs under one
mapping are at least `least` of the item's distinct windows (and two windows, where it has so many), or
LONG windows, however long the item is.

Every item has exact windows as well, of its lower-cased tokens as they stand, whatever their kinds:
WINDOW tokens each, or the whole of a shorter item. They are joined like the templates and need the
same share; the larger of the two shares counts. So verbatim copies of items with few plain words
(short sums, lists of names, Title Case), and copies in Title Case, are found; with other values
such items are not, as their templates would fit too much. An item of one token is found wherever
that token stands.

The benchmark's windows are broadcast up to BROADCAST_WINDOWS of them. Beyond, a bit filter of fixed
size (FILTER_BITS) of all the items' windows is broadcast, and the documents' windows that pass it are
shuffled, with their slots' hashes, to the items' windows; both ways give the same rows. Texts are
shuffled in neither case.

Defined results: null or empty texts, on either side, match nothing; repeated documents each get a
row; repeated item ids are items of their own that report the same id; null ids are reported as
null; an empty benchmark contaminates nothing; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrays import _BYTES, SLICE_BYTES, mix, powers, slices, span_hashes, spans
from tessera.llm.filters import keep_where

WINDOW, LITERALS, LEAST, LONG = 6, 3, 0.2, 40
TOLERATED = 0.2  # of a run's slots
BROADCAST_WINDOWS = 2_000_000
FILTER_BITS = 27
# fixed values: units of measure
UNITS = """
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers
mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds
ml cl l gal litre litres liter liters gallon gallons cup cups
ms s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years
usd eur gbp dollar dollars euro euros cent cents percent pct
kb mb gb tb byte bytes bit bits hz khz mhz ghz w kw mw v a k c f j kj cal kcal degree degrees
""".split()
PLAIN, NUMBER, NAME, UNIT = 0, 1, 2, 3
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:256] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Tokens:
    template: np.ndarray  # hashes: of the word if plain, else of its kind
    surface: np.ndarray  # hashes of what stands there
    kind: np.ndarray
    first: np.ndarray  # each text's first token


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    start, end = spans(data != 32, np.array([0, len(data)]))
    return np.unique(span_hashes(_BYTES[data], start, end))


_UNIT = _unit_hashes()


def _scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens begin, their hashes and their kinds, but for units."""
    n = len(data)
    alpha, digit = _ALPHA[data], _DIGIT[data]
    capital = (data >= 65) & (data <= 90)
    latin = np.zeros(n, bool)  # the second byte of a Latin-1 capital
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = np.where(capital | latin, data + np.uint8(32), data)
    # decimal points and thousands: between two digits
    inner = np.zeros(n, bool)
    if n > 2:
        inner[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
    words, numbers = spans(alpha, offsets), spans(digit | inner, offsets)
    start = np.concatenate([words[0], numbers[0]])
    end = np.concatenate([words[1], numbers[1]])
    kind = np.concatenate([np.zeros(len(words[0]), np.int8), np.ones(len(numbers[0]), np.int8)])
    order = np.argsort(start, kind="stable")
    start, end, kind = start[order], end[order], kind[order]
    if len(start):
        upper = np.concatenate([[0], np.cumsum(capital | latin)])
        wide = np.zeros(len(start), np.int64)
        ok = start + 1 < n
        wide[ok] = (data[start[ok]] == 0xC3).astype(np.int64)
        leads = (upper[np.minimum(start + 1 + wide, n)] - upper[start]) > 0
        kind[(kind == PLAIN) & leads & (upper[end] - upper[start] == 1)] = NAME
    return start, span_hashes(_BYTES[low], start, end), kind


def _blocks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE_BYTES that end where a token can't go on, or at the end."""
    breaks = ~(_ALPHA | _DIGIT)
    breaks[[44, 46]] = False
    lo = 0
    while lo < len(data):
        hi = min(lo + SLICE_BYTES, len(data))
        while hi < len(data):
            found = np.flatnonzero(breaks[data[hi : hi + SLICE_BYTES]])
            if len(found):
                hi += int(found[0])
                break
            hi = min(hi + SLICE_BYTES, len(data))
        yield lo, hi
        lo = hi


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """The texts' tokens; one long text is scanned in blocks."""
    if len(offsets) == 2 and len(data) > SLICE_BYTES:
        found = [_scan(data[lo:hi], np.array([0, hi - lo])) for lo, hi in _blocks(data)]
        surface, kind = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        first = np.array([0, len(surface)])
    else:
        start, surface, kind = _scan(data, offsets)
        first = np.searchsorted(start, offsets) if len(start) else np.zeros(len(offsets), np.int64)
    if len(surface):
        after = np.zeros(len(surface), bool)
        after[1:] = kind[:-1] == NUMBER
        after[first[:-1][first[:-1] < len(surface)]] = False
        at = np.minimum(np.searchsorted(_UNIT, surface), len(_UNIT) - 1)
        kind[after & (kind != NUMBER) & (_UNIT[at] == surface)] = UNIT
    return Tokens(np.where(kind == PLAIN, surface, _MARK[kind]), surface, kind, first)


def template_windows(t: Tokens, width: int = WINDOW, literals: int = LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the full windows that have enough plain words, and the tokens where they begin."""
    n = len(t.template)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    scale = powers(width + 1)[0]
    acc = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        acc += mix(t.template[k : n - width + 1 + k] ^ scale[k + 1])
    plain = np.concatenate([[0], np.cumsum(t.kind == PLAIN)])
    ok = plain[width:] - plain[:-width] >= literals
    for k in range(1, width):  # windows that run into the next text
        e = t.first[1:-1] - k
        ok[e[(e >= 0) & (e < len(ok))]] = False
    at = np.flatnonzero(ok)
    return mix(acc[at]), at


def exact_windows(t: Tokens, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all full windows of the tokens as they stand, and the tokens where they begin."""
    h, at = template_windows(Tokens(t.surface, t.surface, t.kind, t.first), width, 0)
    return mix(h ^ _MARK[0]), at


def windows_of_width(t: Tokens, width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(exact, hashes, first tokens): the windows by template, then the exact ones, a long text's in blocks. One token has no template."""
    step = SLICE_BYTES // 4
    if len(t.first) == 2 and len(t.surface) > step:
        for k in range(0, len(t.surface) - width + 1, step):
            part = slice(k, k + step + width - 1)
            cut = Tokens(t.template[part], t.surface[part], t.kind[part], np.array([0, len(t.kind[part])]))
            for exact, h, at in _both(cut, width):
                yield exact, h, at + k
    else:
        yield from _both(t, width)


def _both(t: Tokens, width: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    if width > 1:
        yield False, *template_windows(t, width, min(LITERALS, width - 1))
    yield True, *exact_windows(t, width)


class Windows:
    """All items' own windows, by template and exact, each once in an item. A short item (fewer tokens than a window) has one of each at most, of its own width."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.tokens = t = tokenize(data, offsets)
        n = np.diff(t.first)
        self.of = np.repeat(np.arange(len(n)), n)
        found = []
        for w in sorted({WINDOW, *(int(x) for x in n[(n > 0) & (n < WINDOW)])}):
            for exact, h, at in windows_of_width(t, w):
                keep = n[self.of[at]] == w if w < WINDOW else n[self.of[at]] >= WINDOW
                found.append((h[keep], at[keep], np.full(int(keep.sum()), w), np.full(int(keep.sum()), exact)))
        self.hashes, self.at, self.width, self.exact = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort([self.at, self.hashes, self.of[self.at]])
        same = np.zeros(len(order), bool)  # as the one before in the same item
        same[1:] = (self.hashes[order][1:] == self.hashes[order][:-1]) & (self.of[self.at[order]][1:] == self.of[self.at[order]][:-1])
        order = np.sort(order[~same])
        self.hashes, self.at, self.width, self.exact = self.hashes[order], self.at[order], self.width[order], self.exact[order]
        self.n_windows, self.n_exact = (np.bincount(self.of[self.at[self.exact == kind]], minlength=len(n)) for kind in (False, True))


class _Mapping:
    """One mapping of an item's values to a text's, and what it explains."""

    def __init__(self) -> None:
        self.forward: dict[tuple[int, int], int] = {}
        self.back: dict[tuple[int, int], int] = {}
        self.covered: set[int] = set()
        self.changed: set[int] = set()  # places in the text

    def take(self, windows: list[tuple[int, int, int]], slots: dict[int, tuple[int, int, int]]) -> bool:
        """Add a run, its slots being (kind, item's value, text's value) by place in the text, unless too many contradict the mapping or each other."""
        to, of = defaultdict(Counter), defaultdict(Counter)
        for kind, ours, theirs in slots.values():
            to[kind, ours][theirs] += 1
            of[kind, theirs][ours] += 1
        most = lambda known, seen: {v: c.most_common(1)[0][0] for v, c in seen.items()} | {v: known[v] for v in seen if v in known}
        forward, back = most(self.forward, to), most(self.back, of)
        wrong = {d for d, (kind, ours, theirs) in slots.items() if forward[kind, ours] != theirs or kind != UNIT and back[kind, theirs] != ours}
        if len(wrong) > TOLERATED * len(slots):
            return False
        for d, (kind, ours, theirs) in slots.items():
            if d not in wrong:
                self.forward[kind, ours], self.back[kind, theirs] = theirs, ours
        self.covered.update(i for d, i, w in windows if not wrong or wrong.isdisjoint(range(d, d + w)))
        self.changed.update(d for d, (_, ours, theirs) in slots.items() if ours != theirs)
        return True


def judge(windows: list[tuple[int, int, int]], as_is: set[int], slots_of: Callable, n_windows: int, n_exact: int, least: float) -> tuple[float, int] | None:
    """(share of the item's windows found, slots that hold another value) if they suffice.

    windows: (text's token, item's token, width) of shared template windows; as_is: the item's tokens
    where shared exact windows begin; slots_of(text's token, item's token, width): (text's token,
    kind, item's value, text's value) of a window's slots.
    """
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for d, i, w in windows:
        runs[d - i].append((d, i, w))
    mappings: list[_Mapping] = []
    for run in sorted(runs.values(), key=lambda r: (-len(r), r[0])):
        slots = {d: rest for window in run for d, *rest in slots_of(*window)}
        if not any(m.take(run, slots) for m in mappings):
            new = _Mapping()
            if new.take(run, slots):
                mappings.append(new)
        if mappings and len(mappings[0].covered) == n_windows:
            break
    best = max(mappings, key=lambda m: len(m.covered), default=_Mapping())
    out = None
    for found, n, changed in ((len(best.covered), n_windows, len(best.changed)), (len(as_is), n_exact, 0)):
        if n and found >= min(2, n) and (found / n >= least or found >= LONG):
            out = (max(out[0], found / n), out[1]) if out else (found / n, changed)
    return out


class Benchmark:
    """Items that fit into a worker, with their windows in order of hash."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        for _, _, data, offsets in slices(texts, 1 << 62):
            pass
        own = Windows(data, offsets)
        self.tokens, self.of, self.n_windows, self.n_exact = own.tokens, own.of, own.n_windows, own.n_exact
        order = np.argsort(own.hashes, kind="stable")
        self.hashes, self.at, self.width, self.exact = own.hashes[order], own.at[order], own.width[order], own.exact[order]
        self.filter = np.zeros(1 << 20, bool)  # by the upper bits: most windows of most texts end here
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def probe(self, t: Tokens) -> Iterator[tuple[bool, int, int, int]]:
        """(exact, document's token, item's token, width) of every shared window."""
        for w in np.unique(self.width):
            for exact, h, at in windows_of_width(t, int(w)):
                near = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
                lo, hi = np.searchsorted(self.hashes, h[near]), np.searchsorted(self.hashes, h[near], "right")
                for k in np.flatnonzero(hi > lo):
                    for j in range(lo[k], hi[k]):
                        if self.width[j] == w and self.exact[j] == exact:
                            yield exact, int(at[near[k]]), int(self.at[j]), int(w)

    def matches(self, t: Tokens, least: float) -> dict[int, dict[int, tuple[float, int]]]:
        """By text, by item: (share of the item's windows covered, slots that hold another value), where enough match."""
        text_of = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
        windows: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        as_is: dict[tuple[int, int], set[int]] = defaultdict(set)
        for exact, d, i, w in self.probe(t):
            pair = int(text_of[d]), int(self.of[i])
            if exact:
                as_is[pair].add(i)
            else:
                windows[pair].append((d, i, w))

        def slots_of(d: int, i: int, w: int) -> Iterator[tuple[int, int, int, int]]:
            for k in range(w):
                if kind := int(self.tokens.kind[i + k]):
                    yield d + k, kind, int(self.tokens.surface[i + k]), int(t.surface[d + k])

        out: dict[int, dict[int, tuple[float, int]]] = defaultdict(dict)
        for text, item in windows.keys() | as_is.keys():
            pair = text, item
            if (found := judge(windows.get(pair, []), as_is.get(pair, set()), slots_of, int(self.n_windows[item]), int(self.n_exact[item]), least)) is not None:
                out[text][item] = found
        return out


def _compare(benchmark: Benchmark, least: float, ids: pa.Array, texts: pa.Array, id_col: str) -> Iterator[pa.RecordBatch]:
    for a, b, data, offsets in slices(texts):
        t = tokenize(data, offsets)
        found = benchmark.matches(t, least)
        items, share, changed = [], [], []
        for k in range(b - a):
            got = sorted(found.get(k, {}).items(), key=lambda x: (-x[1][0], x[0]))
            items.append([benchmark.ids[i] for i, _ in got])
            share.append(float(got[0][1][0]) if got else 0.0)
            changed.append(sum(v[1] for _, v in got))
        yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(items, pa.list_(pa.int64())), pa.array(share, pa.float64()), pa.array(changed, pa.int64())], [id_col, "item_ids", "coverage", "changed_slots"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Every document with the items that contaminate it.

    Returns (id_col, contaminated boolean, item_ids array<long> by falling coverage, coverage
    double: the largest, changed_slots long: slots of those items that hold another value).
    """
    items = _items(benchmark, item_col, item_text_col)
    if _is_small(items, broadcast_windows):
        shared = docs.sparkSession.sparkContext.broadcast(_benchmark(items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _compare(shared.value, least, batch.column(0), batch.column(1), id_col)

        kind = docs.schema[id_col].dataType.simpleString()
        found = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, item_ids array<long>, coverage double, changed_slots long")
    else:
        by_text = _joined(docs, items, least, text_col)
        found = docs.select(F.col(id_col), _text_key(text_col).alias("_text_key")).join(by_text, F.col("_text_key") == F.col("key"), "left")
        found = found.select(id_col, F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("changed_slots", F.lit(0)).alias("changed_slots"))
    return found.select(id_col, (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "coverage", "changed_slots")


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))


def _benchmark(items: DataFrame) -> Benchmark:
    return Benchmark(sorted(((r["item"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def _is_small(items: DataFrame, broadcast_windows: int) -> bool:
    """Whether the items have at most so many windows: one of each kind for each two characters at most."""
    return items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] <= broadcast_windows


def _text_key(text_col: str) -> Column:
    """128 bits that stand for a text: equal texts are contaminated alike."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """docs, all columns, without the rows whose texts are contaminated; ids decide nothing."""
    items = _items(benchmark, item_col, item_text_col)
    if not _is_small(items, broadcast_windows):
        gone = f"_gone_{uuid.uuid4().hex}"  # no name of docs
        found = _joined(docs, items, least, text_col)
        return docs.join(found.select(F.col("key").alias(gone)), _text_key(text_col) == F.col(gone), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_benchmark(items))

    def clean(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        found = shared.value.matches(tokenize(data, offsets), least)
        return np.array([not found.get(k) for k in range(len(offsets) - 1)], bool)

    return keep_where(docs, clean, text_col)


def _slot_lists(t: Tokens, at: np.ndarray, width: int) -> tuple[pa.Array, pa.Array]:
    """For each window: its tokens' hashes, and their kinds as digits of base 4, the first token's lowest."""
    place = at[:, None] + np.arange(width)
    kinds = (t.kind[place].astype(np.int64) << (2 * np.arange(width))).sum(1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(t.surface[place].ravel().view(np.int64))), pa.array(kinds.astype(np.int32))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["item_row", "item", "n_windows", "n_exact", "hash", "width", "exact", "i", "ours", "kinds"]
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(2)):
            own = Windows(data, offsets)
            for w in np.unique(own.width):
                pick = np.flatnonzero(own.width == w)
                at = own.at[pick]
                of = own.of[at]
                rows, ids = (batch.column(k).slice(a, b - a).take(pa.array(of)) for k in (0, 1))
                lists, kinds = _slot_lists(own.tokens, at, int(w))
                yield pa.RecordBatch.from_arrays(
                    [rows, ids, pa.array(own.n_windows[of]), pa.array(own.n_exact[of]), pa.array(own.hashes[pick].view(np.int64)), pa.array(own.width[pick].astype(np.int32)), pa.array(own.exact[pick]), pa.array(at), lists, kinds], names
                )


def _judged(least: float) -> Callable:
    """From shared windows, sorted by text and item: what suffices. One text's and item's windows are held at a time."""

    def of(rows: list[dict]) -> tuple | None:
        tokens = {(r["d"], r["i"]): r for r in rows if not r["exact"]}

        def slots_of(d: int, i: int, w: int) -> Iterator[tuple[int, int, int, int]]:
            r = tokens[d, i]
            for k in range(w):
                if kind := r["kinds"] >> 2 * k & 3:
                    yield d + k, kind, r["ours"][k], r["theirs"][k]

        one = rows[0]
        found = judge([(d, i, r["width"]) for (d, i), r in tokens.items()], {r["i"] for r in rows if r["exact"]}, slots_of, one["n_windows"], one["n_exact"], least)
        return found and (one["key"], one["item"], one["item_row"], *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows = None, []
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1024):
                for r in batch.slice(at, 1024).to_pylist():
                    if (r["key"], r["item_row"]) != pair:
                        out += [of(rows)] if rows else []
                        pair, rows = (r["key"], r["item_row"]), []
                    rows.append(r)
            yield table([x for x in out if x])
        yield table([x for x in [of(rows)] if x] if rows else [])

    def table(found: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*found)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "item", "item_row", "share", "changed"])

    return run


def _joined(docs: DataFrame, items: DataFrame, least: float, text_col: str) -> DataFrame:
    """For a benchmark of any size: (key, item_ids, coverage, changed_slots) of each contaminated text."""
    sc = docs.sparkSession.sparkContext
    items = items.withColumn("row", F.xxhash64("item", "text"))
    items = items.groupBy("row").agg(F.first("item").alias("item"), F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    theirs = items.select("row", "item", "text").mapInArrow(_item_windows, "item_row long, item long, n_windows long, n_exact long, hash long, width int, exact boolean, i long, ours array<long>, kinds int")
    bits = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = theirs.groupBy(F.shiftright(bits, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    passes = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    passes[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    widths = sorted(r["width"] for r in theirs.select("width").distinct().collect())
    shared = sc.broadcast((passes, widths))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes, widths = shared.value
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                t = tokenize(data, offsets)
                text_of = np.repeat(np.arange(b - a), np.diff(t.first))
                for w in widths:
                    for exact, h, at in windows_of_width(t, w):
                        bit = h >> np.uint64(64 - FILTER_BITS)
                        near = np.flatnonzero(passes[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1))
                        h, at = h[near], at[near]
                        keys = batch.column(0).slice(a, b - a).take(pa.array(text_of[at]))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(h.view(np.int64)), pa.array(np.full(len(h), w, np.int32)), pa.array(np.full(len(h), exact)), pa.array(at - t.first[text_of[at]]), _slot_lists(t, at, w)[0]], ["key", "hash", "width", "exact", "d", "theirs"])

    mine = docs.select(_text_key(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(windows_of, "key string, hash long, width int, exact boolean, d long, theirs array<long>")
    shared_windows = mine.join(theirs, ["hash", "width", "exact"]).drop("hash").distinct()  # equal texts are one
    found = shared_windows.repartition("key", "item_row").sortWithinPartitions("key", "item_row", "exact", "d", "i").mapInArrow(_judged(least), "key string, item long, item_row long, share double, changed long")
    found = found.join(items.select(F.col("row").alias("item_row"), "times"), "item_row").withColumn("item", F.explode(F.array_repeat("item", F.col("times").cast("int"))))
    by_share = F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("less"), F.col("item").isNull().alias("none"), "item", "item_row")))
    return found.groupBy("key").agg(F.transform(by_share, lambda x: x["item"]).alias("item_ids"), F.max("share").alias("coverage"), F.sum("changed").alias("changed_slots"))
