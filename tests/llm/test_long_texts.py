"""A text of 50 MB through every kernel: the peak of each stays below what its docstring says, in a process of its own."""

import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

ROOT = Path(__file__).resolve().parents[2]
START = """
import random, resource, sys
import numpy as np, pyarrow as pa
from tessera.llm import arrays, decontamination, languages, near_dedup, quality, toxicity, bpe, fingerprints, token_counts
import public_tokenizers
rng = random.Random(1)
words = [''.join(rng.choice('abcdefghijklmnoprstué') for _ in range(rng.randrange(2, 10))) for _ in range(60000)]
text = ' '.join(rng.choices(words, k=7_500_000))[:48_000_000]
col = pa.array([text], pa.large_string())
size = len(text.encode())
del words
data, offsets = [(d, o) for _, _, d, o in arrays.slices(col)][0]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
before = peak()
"""
KERNELS = {
    "shingles": ("s = [len(x) for g in arrays.shingle_sets(col) for x in g]", 7),
    "signatures": ("s = [x for g in arrays.shingle_sets(col) for x in g]; near_dedup.signatures(s, 16)", 9),
    "fingerprint": ("s = fingerprints._short([text], 0.25, 5)", 9),
    "toxicity": ("m = toxicity.Model(np.ones(1 << toxicity.BITS, np.float32), 0.0); toxicity.score_arrays(m, data, offsets)", 3),
    "quality": ("m = quality.Model(np.ones((len(quality.FAMILIES) + 1) << quality.BITS, np.float32), np.zeros(1), [0, 1]); quality.total(m, data, offsets)", 10),
    "languages": ("m = languages.model_of(['a', 'b', 'c'], np.random.default_rng(1).random((3, 1 << languages.BITS))); languages.proportions(m, data, offsets)", 4),
    "decontamination": ("b = decontamination.Benchmark([(1, 'what is the capital of the large country')]); b.matches(decontamination.tokenize(data, offsets), 0.2)", 16),
    "bpe": ("v = bpe.Vocabulary(open(public_tokenizers.path('word_bpe_49k.json')).read()); v.encoded(text)", 9),
}


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_peak(name):
    """Peak over what was there before, as a multiple of the text's 50 MB."""
    code, times = KERNELS[name]
    done = subprocess.run([sys.executable, "-c", START + code + "\nprint((peak() - before) / size)"], capture_output=True, text=True, cwd=ROOT, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert float(done.stdout) < times, done.stdout


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_parts_change_nothing(name, monkeypatch):
    path = public_tokenizers.path(name)
    lib, own = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    rng = np.random.default_rng(5)
    pieces = ["a", " ", "  ", "\n", " \n", "don't", "'s", "12", "é", "x\u0301", "\u0301", "日本", ",", "...", "\t", "\x1c", "<|endoftext|>", "İ", " Σ"]
    for size in (1, 5, 30):
        monkeypatch.setattr(bpe, "PART_CHARS", size)
        for _ in range(60):
            text = "".join(rng.choice(pieces, 80))
            assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids
