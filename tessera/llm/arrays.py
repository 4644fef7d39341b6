"""Whole-batch text kernels over Arrow buffers: words, shingles and byte n-grams as numpy arrays.

Texts are read straight from Arrow's UTF-8 buffers, in slices of bounded size, so a worker holds
one slice's arrays at a time however long the partition is. A text longer than a slice is a slice of
its own, and its bytes are worked through in blocks of SLICE_BYTES, with what a block needs of the one
before carried over: only its words' hashes (8 bytes each, 16 while they are put together) and its results are held as a whole.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
U64 = np.uint64
_M = U64(0x9E3779B97F4A7C13)  # odd, so it has an inverse modulo 2**64
_MINV = U64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_BYTES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD_CODE = np.where(SPACE, U64(0), _BYTES[_LOWER])
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_M, _MINV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's


def give_back() -> None:
    """Return to the system what this worker's allocators hold and don't use: idle workers stay small."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(col: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about `limit` bytes; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    if off[-1] - off[0] > SLICE_BYTES:
        give_back()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses from one text to the next."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_sums(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The polynomial of each run of byte codes, by where it starts and ends."""
    p, inv = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * p[:-1], out=total[1:])
    return (total[end] - total[start]) * inv[start]


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of byte codes, by where it starts and ends."""
    return mix(span_sums(codes, start, end))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs without ASCII white space, A-Z lower-cased) and each text's first word.

    In blocks of bytes: a word that goes on into the next block has the sums of its parts put together.
    """
    starts, sums = [], []
    length = 0  # bytes so far of a word that reaches the end of the blocks so far
    for lo in range(0, len(data), SLICE_BYTES):
        hi = min(lo + SLICE_BYTES, len(data))
        block = data[lo:hi]
        cuts = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")] - lo
        start, end = spans(~SPACE[block], cuts)
        got = span_sums(_WORD_CODE[block], start, end)
        on = bool(length and len(start) and start[0] == 0 and not (len(cuts) and cuts[0] == 0))
        if on:
            sums[-1][-1] = U64((int(sums[-1][-1]) + pow(int(_M), length, 1 << 64) * int(got[0])) % (1 << 64))
            length += int(end[0])
        if len(start) > on:
            if len(offsets) > 2:
                starts.append(start[on:] + lo)
            sums.append(got[on:])
            length = int(end[-1] - start[-1])
        if not len(end) or end[-1] != len(block):
            length = 0
    for block in sums:
        block[:] = mix(block)
    h = np.concatenate([np.zeros(0, U64), *sums])
    if len(offsets) <= 2:
        return h, np.array([0, len(h)])[: len(offsets)]
    return h, np.searchsorted(np.concatenate([np.zeros(0, np.int64), *starts]), offsets)


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` values, and each text's first window.

    A text with fewer values, but not none, has one window of them all.
    """
    count = np.diff(first)
    n_win = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    bound = np.concatenate([[0], np.cumsum(n_win)])
    out = np.empty(bound[-1], U64)
    at = np.arange(bound[-1]) - np.repeat(bound[:-1], n_win) + np.repeat(first[:-1], n_win)
    full = np.repeat(count >= width, n_win)
    acc = np.full(int(full.sum()), U64(width), U64)
    where = at[full]
    scale = powers(width + 2)[0]
    for k in range(width):
        acc += mix(h[where + k] ^ scale[k + 1])
    out[full] = mix(acc)
    for d in np.flatnonzero((count > 0) & (count < width)):
        part = h[first[d] : first[d + 1]]
        acc1 = U64(len(part)) + mix(part ^ scale[1 : len(part) + 1]).sum(dtype=U64)
        out[bound[d]] = mix(np.array([acc1]))[0]
    return out, bound


def _long_set(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one long text, in blocks of words."""
    h, _ = word_hashes(data, offsets)
    step = SLICE_BYTES // 8
    found = [np.unique(windows(part, np.array([0, len(part)]), width)[0]) for k in range(0, max(1, len(h) - width + 1), step) if len(part := h[k : k + step + width - 1])]
    del h
    out = np.concatenate([np.zeros(0, U64), *found])
    found.clear()
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def shingle_sets(col: pa.Array, width: int = 5) -> Iterator[list[np.ndarray]]:
    """For runs of rows: the sorted distinct shingle hashes of each row's whole text."""
    for a, b, data, offsets in slices(col):
        if b - a == 1 and len(data) > SLICE_BYTES:
            yield [_long_set(data, offsets, width)]
            continue
        h, bound = windows(*word_hashes(data, offsets), width)
        yield [np.unique(h[bound[i] : bound[i + 1]]) for i in range(b - a)]


def ngram_buckets(codes: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket of 2**bits for every n-gram of codes that lies in one text, and each text's first n-gram."""
    count = np.maximum(np.diff(offsets) - n + 1, 0)
    bound = np.concatenate([[0], np.cumsum(count)])
    total = max(len(codes) - n + 1, 0)
    if not total:
        return np.zeros(0, np.int32), bound
    h = np.zeros(total, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h += codes[k : k + total]
    h += np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - bits)
    keep = np.ones(total, bool)
    for k in range(1, n):  # n-grams that begin less than n before a text's end
        e = offsets[1:-1] - k
        keep[e[(e >= 0) & (e < total)]] = False
    return h[keep].astype(np.int32), bound


def ngram_blocks(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ngram_buckets of table[data]: at once, or for one text that is longer than a slice in blocks that each give some of its n-grams."""
    if len(offsets) != 2 or len(data) <= SLICE_BYTES:
        yield ngram_buckets(table[data], offsets, n, bits)
        return
    for k in range(0, max(1, len(data) - n + 1), SLICE_BYTES):
        part = table[data[k : k + SLICE_BYTES + n - 1]]
        yield ngram_buckets(part, np.array([0, len(part)]), n, bits)
