"""Components against all pairs compared by brute force."""

import random

import numpy as np
import pytest
from test_kernels import shingles

from tessera.llm import near_dedup
from tessera.operators.components import connected_components
from tessera.llm.near_dedup import drop_duplicates, near_duplicates


def brute(data):
    """{position: least id of its component}"""
    sets = [shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(data):
        low.setdefault(find(i), []).append(d)
    return [min(low[find(i)]) for i in range(len(data))]


def varied(rng, text, changes):
    w = text.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed):
    """Stars whose copies are alike only by way of the original, chains, copies, a common passage, short and empty texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = [None, "", "  ", "one", "one", "One", "a b c d", "a b c d", "a b c e"]
    for _ in range(6):
        base = " ".join(rng.choice(words) for _ in range(rng.randrange(60, 200)))
        out += [base, base.upper()] + [varied(rng, base, max(1, len(base.split()) // 45)) for _ in range(25)]
    link = " ".join(rng.choice(words) for _ in range(150))
    for _ in range(20):
        link = varied(rng, link, 3)
        out.append(link)
    out += [passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([20, 40, 80]))) for _ in range(60)]
    out += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 50))) for _ in range(60)]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    data = corpus(seed)
    docs = spark.createDataFrame([(d, t, 5, "x") for d, t in data], "doc_id long, text string, n_shingles int, component_id string").repartition(5)
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    ref = brute(data)
    assert len(got) == len(data)
    for (d, t), c in zip(data, ref):
        assert got[d]["n_shingles"] == len(shingles(t))
        assert got[d]["component_id"] == c and got[d]["kept"] == (c == d)


def test_repeated_rows_null_ids_and_empty(spark):
    text = "the quick brown fox jumps over it"
    docs = spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (7, "other words are here now ok"), (8, None), (8, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()), key=repr)
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (8, 8, True), (8, 8, True), (None, 3, False)]
    assert near_duplicates(docs.limit(0)).count() == 0
    kept = sorted((r["doc_id"] for r in drop_duplicates(docs.where("doc_id is not null")).collect()))
    assert kept == [3, 7, 8, 8]
    twice = spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in drop_duplicates(twice).collect()) == [1, 2]


@pytest.mark.parametrize("broadcast", [0, near_dedup.BROADCAST_IDS])
def test_one_row_of_each_component_is_kept(spark, monkeypatch, broadcast):
    """Null ids, one id with several texts, and equal rows, by the shuffled and the broadcast way."""
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", broadcast)
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(80)) for k in "abcde")
    near = c + " more"
    data = [(1, a), (5, a), (5, b), (6, c), (6, d), (None, a), (None, near), (None, e), (None, e), (None, e.upper()), (7, d), (7, d), (8, "Some words"), (8, "some words"), (8, "some words"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(data)], "doc_id long, text string, k int").repartition(3)
    marked = near_duplicates(docs).collect()
    assert len(marked) == len(data) and sum(r["kept"] for r in marked) == 8
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (6, c), (6, d), (None, e), (8, "some words"), (None, ""), (None, "")], key=repr)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 900 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys([1000, *range(900, 930)], 900)}


@pytest.mark.parametrize("blocks", [(256, 2048), (3, 4)])
def test_second_comparison_is_complete(spark, monkeypatch, blocks):
    """What is alike in an open bucket is joined, whatever the blocks; only links that join are given."""
    monkeypatch.setattr(near_dedup, "STRAYS", blocks[0])
    monkeypatch.setattr(near_dedup, "OTHERS", blocks[1])
    n, bands = 40, [11] * near_dedup.BANDS
    family = {k: k % 5 for k in range(n)}
    sets = {k: np.unique(np.arange(100, dtype=np.uint64) * np.uint64(2**57 + 12345) + np.uint64(family[k])) for k in range(n)}
    for k in range(n):
        sets[k] = np.unique(np.concatenate([sets[k][k % 7 :], np.array([10**12 + k], np.uint64)]))
    label = {k: 0 if k < 8 else 8 if k < 12 else k for k in range(n)}
    frame = spark.createDataFrame
    members = frame([(11, k, n) for k in range(n)] + [(6, 0, 2), (6, 3, 2)], "band long, node long, n long")
    done = frame([(11, 2), (6, 0)], "band long, node long")
    component = frame([(k, v) for k, v in label.items() if k < 12], "node long, component long")
    light = frame([(k, len(sets[k]), bands, bytes(near_dedup.SKETCH)) for k in range(n)], "node long, n_shingles long, bands array<long>, sketch binary")
    full = frame([(k, sets[k].view(np.int64).tolist()) for k in range(n)], "node long, shingles array<long>")
    open_ = near_dedup.open_buckets(members, done, component, light)
    assert {(r["band"], r["node"]) for r in open_.collect()} == {(11, k) for k in range(n) if k != 2}
    got = [(r["a"], r["b"]) for r in near_dedup.away_from_hubs(open_, light, full).collect()]

    def parts(links):
        up = dict(label)
        for a, b in links:
            x, y = up[a], up[b]
            up = {k: y if v == x else v for k, v in up.items()}
        return sorted(sorted(k for k in up if up[k] == v) for v in set(up.values()))

    true = [(a, b) for b in range(n) for a in range(b) if 2 not in (a, b) and family[a] == family[b]]
    assert all(family[a] == family[b] for a, b in got)
    assert parts(got) == parts(true)
    if blocks[0] > n:
        assert len(got) < 2 * n


@pytest.mark.parametrize("hub_rounds", [0, 1, 5])
def test_links_away_from_the_hub(spark, monkeypatch, hub_rounds):
    """Texts that are all a little too far from their bucket's hub, some of them alike in pairs: only further hubs and the last comparison find those."""
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", hub_rounds)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    data = [(0, " ".join(base))]

    def changed(words, n):
        out = list(words)
        for at in rng.sample(range(3, 147), n):
            out[at] = f"x{rng.randrange(10**7)}"
        return out

    for i in range(120):
        one = changed(base, 5)
        data.append((len(data), " ".join(one)))
        if i % 4 == 0:
            near = list(one)
            for at in rng.sample([k for k in range(3, 147) if one[k] == base[k]], 4):
                near[at] = f"y{rng.randrange(10**7)}"
            data.append((len(data), " ".join(near)))
    ref = brute(data)
    assert len(set(ref)) > 20 and len(set(ref)) < len(data)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in data] == ref
