"""Byte-pair encoding: a priority queue of merge ranks over a doubly linked list of symbols.

`Vocabulary` reads the JSON of a public tokenizer (BPE models whose pre-tokenizer ends in a byte
level) and encodes or decodes as that file says. It never trains anything.

The tokenizers library has Unicode tables of its own: letters and digits of Unicode 16, lower case of
17, normal forms of 9. Texts with characters on which this Python or its regex module differ go a
second, exact way; whatever release of them is installed, the results are the library's.

A pre-token of n bytes takes about 60 n bytes while it is merged. Long texts are encoded in parts, so
nothing else grows with a text but the text itself, its ids and what they decode to.

Defined results: a null text is an empty one; an empty text has no ids and decodes to an empty
string; repeated rows each get their own result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# fixed values: letters and digits that Unicode 16 added to Unicode 15.1
LETTERS_16 = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
DIGITS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
# fixed values: capitals that Unicode 16 and 17 added, first-last=lower case of the first
CAPITALS_17 = "1C89=1C8A A7CB=264 A7CC=A7CD A7CE=A7CF A7D2=A7D3 A7D4=A7D5 A7DA=A7DB A7DC=19B 10D50-10D65=10D70 16EA0-16EB8=16EBB"
# fixed values: characters with a combining class, or that compose, added from Unicode 10 to 15.1
MARKS_10 = "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
CACHE_ENTRIES = 250_000
CACHED_LENGTH = 64
PART_CHARS = 500_000
_CUT = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[tuple, Vocabulary] = {}


def _points(ranges: str) -> set[int]:
    ends = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return {c for e in ends for c in range(e[0], e[-1] + 1)}


def _class(points: set[int]) -> str:
    """The members of a regular expression's class."""
    out: list[list[int]] = []
    for c in sorted(points):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in out)


@cache
def odd_classes() -> dict[str, tuple[set[int], set[int]]]:
    """For L and N: what the regex module takes for one and the library doesn't, and the other way round. Few; found in blocks."""
    out = {}
    for kind, added in (("L", _points(LETTERS_16)), ("N", _points(DIGITS_16))):
        pattern = regex.compile(rf"\p{{{kind}}}")
        more, less = set(), set()
        for lo in range(0, 0x110000, 2048):
            if 0xD800 <= lo < 0xE000:
                continue
            block = range(lo, lo + 2048)
            theirs = {c for c in block if unicodedata.category(chr(c))[0] == kind or c in added}
            ours = set(map(ord, pattern.findall("".join(map(chr, block)))))
            more |= ours - theirs
            less |= theirs - ours
        out[kind] = more, less
    return out


def _exact(pattern: str) -> str:
    """The pattern with the library's letters and digits spelt out."""
    for kind, (more, less) in odd_classes().items():
        inner = rf"\p{{{kind}}}" + (f"--[{_class(more)}]" if more else "")
        pattern = pattern.replace(rf"\p{{{kind}}}", f"[[{inner}]{_class(less)}]")
    return "(?V1)" + pattern


_CAPITALS = {
    c: chr(int(low, 16) + k) for r in CAPITALS_17.split() for span, low in [r.split("=")] for k, c in enumerate(sorted(_points(span)))
}
_MARKS = re.compile(f"([{_class(_points(MARKS_10))}])")
_NEW_CAPITALS = re.compile(f"[{_class(set(_CAPITALS))}]")


def _normal(kind: str, text: str) -> str:
    """A normal form in which the newest marks stay where they are."""
    return "".join(p if k % 2 else unicodedata.normalize(kind, p) for k, p in enumerate(_MARKS.split(text)))


def _lower(text: str) -> str:
    """Lower case of each character by itself: a sigma that ends a word isn't special."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


def _newest_lower(text: str) -> str:
    low = _lower(text)
    return low.translate(_CAPITALS) if _NEW_CAPITALS.search(low) else low


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Recent(dict):
    """A bounded cache in two generations: a full young one becomes the old one, and what is used again moves back.

    Lookups by [] of what is young stay inside the interpreter's dict; there are at most `entries`,
    with about CACHED_LENGTH times as many characters; keys longer than four times that aren't kept.
    """

    def __init__(self, make: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old, self.held = make, entries, {}, 0

    def __missing__(self, token: str):
        value = self.old.pop(token, None)
        if value is None:
            value = self.make(token)
        if len(token) > 4 * CACHED_LENGTH:
            return value
        if 2 * len(self) >= self.entries or 2 * self.held >= self.entries * CACHED_LENGTH:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[token] = value
        self.held += len(token)
        return value


class Vocabulary:
    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE":
            raise ValueError(f"not a BPE tokenizer: {model['type']}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.strings = [""] * (1 + max(chain(self.ids.values(), self.special.values())))
        for string, i in chain(self.ids.items(), self.special.items()):
            self.strings[i] = string
        self.special_starts = {s[0] for s in self.special if s}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.first = [self.ids.get(s, -1) for s in symbols]
        self.last = [self.ids.get(s + self.suffix, -1) for s in symbols]
        self.holes = -1 in self.first or -1 in self.last
        self.bytes_of = {s: b for b, s in enumerate(symbols)}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        pattern = self._pattern(spec["pre_tokenizer"])
        self.pattern, self.exact_pattern = regex.compile(pattern), regex.compile(_exact(pattern))
        self.steps, self.exact_steps = self._normalizers(spec.get("normalizer"), False), self._normalizers(spec.get("normalizer"), True)
        odd = set().union(*chain.from_iterable(odd_classes().values()))
        self.odd = re.compile(f"[{_class(odd)}]")
        self.high = re.compile(f"[{chr(min(odd | _points(MARKS_10) | set(_CAPITALS)))}-\U0010ffff]")  # below it, all releases agree
        blank = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
        if not self.pattern.search(regex.sub(r"\S", "", blank)):  # runs of white space as one space change nothing where no pre-token has any
            self.steps, self.exact_steps = ([f for f in steps if getattr(f, "spaces", None) is None] for steps in (self.steps, self.exact_steps))
            known = {f.func if isinstance(f, partial) else f for f in self.exact_steps} <= {_normal, _newest_lower}
            self.by_parts = known and "(?" not in pattern
        else:
            self.by_parts = pattern == BYTE_LEVEL and not self.steps
        self.coded = Recent(self._code)

    def _code(self, token: str) -> bytes:
        """A pre-token's ids as little-endian unsigned 32-bit integers."""
        return np.array(self.merge(token.encode()), "<u4").tobytes() if sys.byteorder != "little" else array("I", self.merge(token.encode())).tobytes()

    @staticmethod
    def _normalizers(spec: dict | None, exact: bool) -> list:
        if not spec:
            return []
        out = []
        for step in spec["normalizers"] if spec["type"] == "Sequence" else [spec]:
            kind = step["type"]
            if kind in ("NFC", "NFD", "NFKC", "NFKD"):
                out.append(partial(_normal if exact else unicodedata.normalize, kind))
            elif kind == "Replace":
                p = step["pattern"]
                out.append(lambda s, p=regex.compile(p.get("Regex") or regex.escape(p["String"])), c=step["content"]: p.sub(lambda _: c, s))
                if (p.get("Regex"), step["content"]) == (r"\s+", " "):
                    out[-1].spaces = True
            elif kind == "Lowercase":
                out.append(_newest_lower if exact else _lower)
            else:
                raise ValueError(f"unknown normalizer {kind}")
        return out

    @staticmethod
    def _pattern(spec: dict) -> str:
        parts = spec["pretokenizers"] if spec["type"] == "Sequence" else [spec]
        if any(p.get("add_prefix_space") for p in parts):
            raise ValueError("add_prefix_space isn't supported")
        split = next((p for p in parts if p["type"] == "Split"), None)
        if split is None:
            return BYTE_LEVEL
        if split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("only a split that keeps its matches is supported")
        return split["pattern"]["Regex"]

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() or not self.high.search(text):
            for f in self.steps:
                text = f(text)
            return self.pattern.findall(text)
        for f in self.exact_steps:
            text = f(text)
        return (self.exact_pattern if self.odd.search(text) else self.pattern).findall(text)

    def pieces(self, text: str) -> Iterator[tuple[int | None, str]]:
        """(id, string) of special strings, (None, string) of the text between them."""
        if not any(c in text for c in self.special_starts):
            yield None, text
            return
        for k, part in enumerate(self.split_special.split(text)):
            if part:
                yield (self.special[part] if k % 2 else None), part

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token's bytes; a symbol that was merged into the one before it becomes -1."""
        if not raw:
            return []
        n, first = len(raw), self.first
        kind = list if n < 4096 else partial(array, "i")
        sym = kind([first[b] for b in raw])
        sym[-1] = self.last[raw[-1]]
        if self.holes and -1 in sym:  # the model has no unknown token: such a symbol has no id
            sym = [s for s in sym if s >= 0]
            n = len(sym)
        merges = self.merges
        after, before = kind(range(1, n + 1)), kind(range(-1, n - 1))
        queue = [m[0] << 32 | i for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0 or (m := merges.get((sym[i], sym[j]))) is None or m[0] != top >> 32:
                continue  # stale: one of the two was merged meanwhile
            new = sym[i] = m[1]
            sym[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(queue, m[0] << 32 | i)
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(queue, m[0] << 32 | h)
        return [s for s in sym if s >= 0]

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts whose pre-tokens are its own: cut before single spaces, where that can't change any."""
        at = 0
        while self.by_parts and len(text) - at > PART_CHARS and (cut := _CUT.search(text, at + PART_CHARS)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encoded(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        get, raw = self.coded.__getitem__, []
        for known, piece in self.pieces(text):
            if known is not None:
                raw.append(np.array([known], "<u4").tobytes())
                continue
            for part in self.parts(piece):
                raw.append(b"".join(map(get, self.pretokens(part))))
        return b"".join(raw)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded(text or ""), "<u4").tolist()

    def decode(self, ids) -> str:
        """Vocabulary strings of known ids put together: by spaces where the file names no decoder, else as bytes."""
        strings = map(self.strings.__getitem__, ids)
        if not self.byte_decoder:
            return " ".join(strings)
        out, code = bytearray(), self.bytes_of
        for s in strings:
            if s in self.special:
                out += s.encode()
            else:
                out += bytes(code[c] for c in s)
        return out.decode("utf-8", "replace")


def vocabulary(source: str) -> Vocabulary:
    """One vocabulary for each file and Python worker."""
    key = (len(source), hash(source))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(source)
    return _loaded[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Ids of every whole text, and the text that they decode to.

    Returns (id_col, n_tokens long, token_ids array<int> if keep_ids, decoded string), one row for
    each row of docs; no shuffle. The tokenizer's file is read on the driver and broadcast.
    """
    return _apply(docs, tokenizer_path, id_col, text_col, "ids" if keep_ids else "text")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, but (id_col, n_tokens, ids_sha256, decoded_sha256): digests of the ids and the decoded text."""
    return _apply(docs, tokenizer_path, id_col, text_col, "digests")


def _apply(docs: DataFrame, path: str, id_col: str, text_col: str, kind: str) -> DataFrame:
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, first, second = [], [], []
                for text in part.column(1).to_pylist():
                    ids = voc.encoded(text or "")
                    text = voc.decode(np.frombuffer(ids, "<u4").tolist())
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest() if kind == "digests" else np.frombuffer(ids, "<i4"))
                    second.append(hashlib.sha256(text.encode()).hexdigest() if kind == "digests" else text)
                cols = [part.column(0), pa.array(n, pa.int64())]
                if kind == "digests":
                    cols.append(pa.array(first, pa.string()))
                elif kind == "ids":
                    cols.append(pa.array(first, pa.list_(pa.int32())))
                cols.append(pa.array(second, pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "n_tokens", *{"digests": ["ids_sha256", "decoded_sha256"], "ids": ["token_ids", "decoded"], "text": ["decoded"]}[kind]]
    types = {"n_tokens": "long", "token_ids": "array<int>"}
    sql_id = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join(f"`{c}` {sql_id if c == id_col else types.get(c, 'string')}" for c in names)
    return docs.select(id_col, text_col).mapInArrow(run, schema)
