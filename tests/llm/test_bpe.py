"""BPE and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, token_counts

HARD = [None, "", "   ", "a", "<|endoftext|>x <|startoftext|> Y", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ", "don't we'll 'S 'RE I'M", "x" * 3000, "12345 ½ Ⅷ", "日本語テスト 한국어", "👩‍👩‍👧 emoji 🙂", "\u2003 　z\x1cq\x85w", "a\x00b\x1f", "<|endoftext|", "\n\n\n  \n a   b", "e\u0301 é"]


def texts():
    rng = random.Random(1)
    return HARD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 127), rng.randrange(0xA0, 0x500)])) for _ in range(rng.randrange(120))) for _ in range(200)] + ["the cat sat"] * 3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_vocabulary_equals_library(name):
    path = public_tokenizers.path(name)
    lib, own = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    for t in texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point(name):
    """Each by itself, and between letters, digits, spaces and marks that it may join or reorder."""
    path = public_tokenizers.path(name)
    lib, own = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    plain = {p for p in points if 0x3400 <= ord(p) < 0xD7A4 or 0x17000 <= ord(p) < 0x18CD6 or 0x20000 <= ord(p)} - set("\U0002FA1D\U0002F800")  # all alike: one in 97 of them
    some = [p for k, p in enumerate(points) if p not in plain or k % 97 == 0]
    for texts in ([f"a{p}b 1{p}2 {p}" for p in some], [f"x\u0323{p}\u0301y" for p in some[: len(some) // 2]]):
        for k in range(0, len(texts), 4096):
            want = lib.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)
            wrong = [hex(ord(some[k + j])) for j, (t, w) in enumerate(zip(texts[k : k + 4096], want)) if own.encode(t) != w.ids]
            assert not wrong


def test_long_pretoken():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    word = "".join(random.Random(2).choice("abcdetho") for _ in range(60_000))
    assert own.merge(word.encode()) == lib.encode(word, add_special_tokens=False).ids


def test_special_strings_of_any_form():
    import json

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["added_tokens"][0]["content"] = "[END]"
    lib, own = Tokenizer.from_str(json.dumps(spec)), bpe.Vocabulary(json.dumps(spec))
    assert own.encode("a [END] b[END]") == lib.encode("a [END] b[END]", add_special_tokens=False).ids


def test_merge_skips_stale_entries():
    """All orders of merging of repeated pairs: the lowest rank first, then the leftmost."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    for word in ("aaaaaaaaa", "ababababa", "thethethe", "mississippi" * 4, "-" * 77):
        assert own.merge(word.encode()) == lib.encode(word, add_special_tokens=False).ids


def test_encode_digests(spark):
    data = [(i, t, "clash", 7) for i, t in enumerate(texts())] + [(None, "null id", "", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids_sha256 string, n_tokens int")
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.encode_digests(docs, path).collect()}
    for i, t, *_ in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe.encode_decode(docs, path).collect()}
    assert full[4]["token_ids"] == lib.encode(HARD[4], add_special_tokens=False).ids
    assert bpe.encode_digests(docs.limit(0), path).count() == 0


@pytest.mark.parametrize(("table_size", "sample"), [(5, 10_000), (50_000, 10_000), (50_000, 20)])
def test_token_counts(spark, table_size, sample):
    data = [(i, t, 1) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_bytes int").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs, path, limit=10, table_size=table_size, sample_texts=sample).collect()}
    for i, t, _ in data:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 10)
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
