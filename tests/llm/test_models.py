"""Classifiers on planted signals, language mixtures, decontamination, and the pipeline's stages."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontamination as dec
from tessera.llm import arrays, languages, quality, toxicity
from tessera.llm import queries as q
from tessera.llm.arrays import slices

D = "/root/testdata/sf0.01"


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "an", "ing", "o", "ly"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def test_toxicity_learns_planted_words(spark):
    rng = random.Random(1)
    data = []
    for i in range(900):
        bad = i % 5 == 0
        w = prose(rng, rng.randrange(5, 120)).split()
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grobnik", "zzorp", "Wumpfel"]))
        data.append((i, " ".join(w), int(bad), "clash"))
    docs = spark.createDataFrame([(i, t, c) for i, t, _, c in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in data if i < 600] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y, _ in data if i >= 600]
    assert np.mean([got[i]["predicted"] == y for i, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.drop_toxic(docs.unionByName(spark.createDataFrame([(-1, None, None), (-2, "", "x")], docs.schema)), model)
    assert {-1, -2} <= {r["doc_id"] for r in kept.collect()} and kept.columns == docs.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs.limit(3), none).select("score").distinct().count() == 1
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_quality_orders_grades(spark):
    rng = random.Random(2)
    data = []
    for i in range(900):
        w, g = prose(rng, rng.randrange(20, 90)).split(), i % 3
        if g == 0:
            w = [x.upper() + "!!" for x in w]
        elif g == 1:
            w = [x + "!!" if rng.random() < 0.3 else x for x in w]
        data.append((i, " ".join(w), g))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(-1, None), (-2, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in data if i < 600] + [(0, None)], "doc_id long, grade int")
    model = quality.fit(docs, ratings)
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == [0, 1, 2]
    got = {r["doc_id"]: r for r in quality.grade(docs, model).collect()}
    means = [np.mean([got[i]["expected_grade"] for i, _, g in data if i >= 600 and g == k]) for k in range(3)]
    assert means[0] < 0.3 < 0.7 < means[1] < 1.4 < 1.6 < means[2]
    assert np.mean([got[i]["kept"] == (g >= 1) for i, _, g in data if i >= 600]) > 0.97
    assert len(got) == 902 and 0 <= got[-1]["tail_probability"] <= 1
    upper = {r["doc_id"]: r["tail_probability"] for r in quality.grade(docs, model, cut=2).collect()}
    assert all(upper[d] <= got[d]["tail_probability"] + 1e-12 for d in got)
    empty = quality.fit(docs, ratings.limit(0))
    assert quality.grade(docs.limit(2), empty).first()["kept"] and quality.drop_low(docs, empty).count() == 902
    one = quality.fit(docs, ratings.where("grade = 0"))
    assert not quality.grade(docs.limit(1), one).first()["kept"]


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=4000)
    y = (x + rng.logistic(size=4000) * 0.3 > -0.5).astype(int) + (x + rng.logistic(size=4000) * 0.3 > 0.8)
    rows, cols = np.arange(4000), np.zeros(4000, int)
    m = quality.fit_arrays(rows, cols, x.astype(np.float32), y)
    assert m.weights[0] > 0 and m.thresholds[0] < m.thresholds[1]


def test_held_out_accuracy(spark):
    """On rows that the fits haven't seen."""
    labels = {r["doc_id"]: r for r in q.table(spark, D, "labels").collect()}
    tox = [r for r in q.op3_toxicity(spark, D).collect()]
    assert len(tox) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in tox)
    held = [r for r in tox if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["toxic"] for r in held]) > 0.85
    kept = [r for r in q.op6_quality(spark, D).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["kept"] for r in kept if labels[r["doc_id"]]["quality"] == 1]) > 0.85
    langs = {r["doc_id"]: r["lang"] for r in q.table(spark, D, "documents", "doc_id", "lang").collect()}
    got = [r for r in q.op8_language_id(spark, D).collect()]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in got if r["held_out"]]) > 0.97


def test_language_mixtures(spark):
    rng = random.Random(4)
    make = {"xx": ["ka", "ro", "mi"], "yy": ["bel", "dor", "sch"], "zz": ["éa", "uî", "oç"]}
    text = lambda k, n: " ".join("".join(rng.choice(make[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    docs = spark.createDataFrame([(i, text(k, 60), k) for i, k in enumerate(["xx", "yy", "zz"] * 30)] + [(500, "q", None), (501, None, "xx")], "doc_id long, text string, lang string")
    model = languages.fit(docs)
    assert model.languages == ["xx", "yy", "zz"]
    mixed = [(1, text("xx", 70) + " " + text("yy", 30)), (2, text("zz", 50)), (3, None), (4, ""), (5, "12 !? 3"), (6, "k"), (7, "日本")]
    got = {r["doc_id"]: r for r in languages.identify(spark.createDataFrame([(i, t, "z", 1) for i, t in mixed], "doc_id long, text string, lang_pred string, score int"), model).collect()}
    assert got[1]["lang_pred"] == "xx" and set(got[1]["languages"]) == {"xx", "yy"} and abs(got[1]["score"] - 0.7) < 0.05
    assert got[2]["languages"] == {"zz": 1.0} and got[2]["score"] == 1.0
    assert [got[i]["lang_pred"] for i in (3, 4, 5)] == ["und"] * 3 and got[6]["lang_pred"] in model.languages and got[7]["lang_pred"] in model.languages
    nothing = languages.fit(docs.limit(0))
    assert {r["lang_pred"] for r in languages.identify(docs, nothing).collect()} == {"und"}


def test_language_sets_of_any_size(spark):
    """Five languages in one text, all found; the set is the best of all sizes."""
    rng = random.Random(6)
    make = {"aa": ["ka", "ro", "mi"], "bb": ["bel", "dor", "sch"], "cc": ["éa", "uî", "oç"], "dd": ["zyx", "qwv", "jjk"], "ee": ["thu", "ngo", "pfe"], "ff": ["lli", "ggu", "cca"]}
    text = lambda k, n: " ".join("".join(rng.choice(make[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    model = languages.fit(spark.createDataFrame([(i, text(k, 60), k) for i, k in enumerate([*make] * 30)], "doc_id long, text string, lang string"))
    five = " ".join(text(k, n) for k, n in zip("aa bb cc dd ee".split(), (60, 50, 40, 30, 20)))
    got = {r["doc_id"]: r for r in languages.identify(spark.createDataFrame([(1, five), (2, text("dd", 40))], "doc_id long, text string"), model).collect()}
    assert got[1]["lang_pred"] == "aa" and set(got[1]["languages"]) == {"aa", "bb", "cc", "dd", "ee"} and abs(got[1]["score"] - 0.3) < 0.03
    assert got[2]["languages"] == {"dd": 1.0}


def test_long_texts_in_blocks(monkeypatch):
    """Every kernel gives a text that is longer than a slice what it gives the same text as a whole."""
    rng = random.Random(9)
    text = " ".join(rng.choice(["Über", "ça", "ÉTÉ!!", "naïve", "12,5", "the", "the", "日本語", "x-y", "Ωmega"]) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(900)) + "zz" * 200
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    weights = np.random.default_rng(1).normal(size=(len(quality.FAMILIES) + 1) << quality.BITS).astype(np.float32)
    graded = quality.Model(weights, np.array([0.0, 1.0]), [0, 1, 2])
    model = languages.model_of(["aa", "bb", "cc"], np.random.default_rng(2).integers(0, 50, (3, 1 << languages.BITS)).astype(float))
    whole = quality.total(graded, data, offsets), list(quality.frequencies(data, offsets))[0], toxicity.presence(data, offsets)[1], languages.proportions(model, data, offsets), languages.count_trigrams(pa.array([text]))
    for size in (64, 500, 3000):
        for m in (toxicity, languages, arrays):
            monkeypatch.setattr(m, "SLICE_BYTES", size)
        assert np.allclose(whole[0], quality.total(graded, data, offsets))
        assert all(np.allclose(a, b) for a, b in zip(whole[1], list(quality.frequencies(data, offsets))[0]))
        assert np.array_equal(whole[2], toxicity.presence(data, offsets)[1])
        if size > 500:  # the last word is longer than the smaller ones
            assert np.allclose(whole[3], languages.proportions(model, data, offsets, size))
            assert np.array_equal(whole[4], languages.count_trigrams(pa.array([text])))


def test_brute_force_scores(spark):
    """The array kernels against plain Python, with weights at random."""
    rng, gen = random.Random(10), np.random.default_rng(3)
    texts = ["", "a", "Ab cd", "ÀÉ  naïve,  日本語テスト ok", "x" * 40, "the the cat the cat"] + [prose(rng, rng.randrange(1, 60)) for _ in range(40)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    model = toxicity.Model((gen.normal(size=1 << toxicity.BITS) * (gen.random(1 << toxicity.BITS) < 0.3)).astype(np.float32), -0.2)
    bucket = lambda codes, n, bits: int(arrays.ngram_buckets(np.array(codes, np.uint32), np.array([0, len(codes)]), n, bits)[0][0])
    got = toxicity.score_arrays(model, data, offsets)
    for t, s in zip(texts, got):
        folded = re.sub(" +", " ", "".join(c.lower() if unicodedata.category(c)[0] in "LMN" else " " for c in t))
        have = {bucket([*map(ord, folded[k : k + n])], n, toxicity.BITS) for n in (4, 5) for k in range(len(folded) - n + 1)}
        assert abs(s - 1 / (1 + np.exp(-(sum(float(model.weights[b]) for b in have) - 0.2)))) < 1e-5
    weights = gen.normal(size=(len(quality.FAMILIES) + 1) << quality.BITS).astype(np.float32)
    graded = quality.Model(weights, np.array([0.0, 1.0]), [0, 1, 2])
    for t, x in zip(texts, quality.total(graded, data, offsets)):
        want, raw, words = 0.0, t.encode(), t.lower().encode().split()
        for k, (codes, n) in enumerate(quality.FAMILIES):
            grams = [bucket([int(codes[b]) for b in raw[i : i + n]], n, quality.BITS) for i in range(len(raw) - n + 1)]
            want += sum(float(weights[(k << quality.BITS) + g]) for g in grams) / (len(grams) + quality.PSEUDO)
        near = [next((d for d in range(1, quality.REPEATS + 1) if i >= d and words[i - d] == w), 0) for i, w in enumerate(words)]
        want += sum(float(weights[(len(quality.FAMILIES) << quality.BITS) + d]) for d in near) / (len(words) + quality.PSEUDO)
        assert abs(x - want) < 1e-4


def test_language_sets_by_brute_force():
    """Proportions against a plain search: EM over all sets of leading languages."""
    rng = random.Random(11)
    names = ["aa", "bb", "cc", "dd"]
    model = languages.model_of(names, np.random.default_rng(4).integers(0, 400, (4, 1 << languages.BITS)).astype(float) ** 2)
    texts = [" ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(30)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = languages.proportions(model, data, offsets)

    def em(lik, share):
        for _ in range(languages.ROUNDS):
            part = share * lik
            share = np.maximum((part / part.sum(1, keepdims=True)).mean(0), 1e-9)
        return share, np.log((share * lik).sum(1)).sum()

    for t, row in zip(texts, got):
        ll = []
        for word in t.encode().split():
            code = np.frombuffer(b" " + word + b" ", np.uint8)
            grams = arrays.ngram_buckets(code, np.array([0, len(code)]), 3, languages.BITS)[0]
            ll.append(model.logp[:, grams].astype(float).sum(1))
        lik = np.maximum(np.exp(np.array(ll) - np.max(ll, 1, keepdims=True)), 1e-30)
        order = np.argsort(-em(lik, np.full(4, 0.25))[0], kind="stable")
        start, best = em(lik, np.full(4, 0.25))[0], None
        for k in range(1, 5):
            pick = order[:k]
            share, value = em(lik[:, pick], start[pick] / start[pick].sum()) if k > 1 else (np.ones(1), np.log(lik[:, pick[0]]).sum())
            value -= languages.PENALTY * (k - 1) * np.log1p(len(ll))
            if best is None or value > best[0]:
                best = value, {int(p): float(s) for p, s in zip(pick, share)}
        assert np.allclose(row, [best[1].get(k, 0.0) for k in range(4)], atol=1e-6)


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(languages, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        languages.fit(spark.createDataFrame([(i, "abc", str(i)) for i in range(3)], "doc_id long, text string, lang string"))


ITEMS = [
    (1, "Alice has 12 apples and gives 5 apples to Bob before walking 3 km home, how many apples remain with Alice?"),
    (2, "what is the capital of the large country that lies south of the river"),
    (3, "short item here"),
    (4, None),
    (5, ""),
]
FILL = "plain filler words that stand around what matters in this small text and say nothing"


def decontaminated(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, coverage string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {r["doc_id"]: r for r in dec.decontaminate(docs, bench, **more).collect()}


@pytest.mark.parametrize("windows", [0, dec.BROADCAST_WINDOWS])
def test_templates(spark, windows):
    again = "Carol has 77 apples and gives 31 apples to Dave before walking 9 km home, how many apples remain with Carol?"
    broken = "Carol has 77 apples and gives 31 apples to Dave before walking 9 km home, how many apples remain with Erwin?"
    units = "Alice has 12 apples and gives 5 apples to Bob before walking 3 miles home, how many apples remain with Alice?"
    texts = [f"{FILL} {ITEMS[0][1]} {FILL}", f"{FILL} {again}", FILL, None, "", ITEMS[1][1].upper(), "a short item here too", units, f"{FILL} {again} {ITEMS[1][1]}", again, again, broken]
    got = decontaminated(spark, texts, broadcast_windows=windows)
    assert len(got) == len(texts)
    assert [got[i]["item_ids"] for i in range(12)] == [[1], [1], [], [], [], [2], [3], [1], [1, 2], [1], [1], [1]]
    assert got[0]["changed_slots"] == 0 and got[1]["changed_slots"] == 6 and got[7]["changed_slots"] == 1 and got[0]["coverage"] == 1.0
    assert got[2]["contaminated"] is False and got[2]["coverage"] == 0.0


@pytest.mark.parametrize("windows", [0, dec.BROADCAST_WINDOWS])
def test_items_of_few_plain_words(spark, windows):
    """Sums, names, Title Case and single tokens have no template window, but exact ones; so have copies in Title Case."""
    names = "Anna Berta Carl Dora Emil Frida Gustav Hanna Ivan Jakob"
    items = ["What is 15 * 27?", "What is 12 + 7 - 3 + 5?", "Solve 3 + 4 = 7", names, "The Quick Brown Fox Jumps Over It", "Xylograph", ITEMS[1][1]]
    texts = [f"{FILL}. {i} {FILL}" for i in [*items[:6], ITEMS[1][1].title()]] + [FILL, "What is 15 * 28?", " ".join(reversed(names.split())), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in dec.decontaminate(docs, bench, broadcast_windows=windows).collect()}
    assert [got[k]["item_ids"] for k in range(len(texts))] == [[0], [1], [2], [3], [4], [5], [6], [], [], [], []]
    assert all(got[k]["coverage"] == 1.0 and got[k]["changed_slots"] == 0 for k in range(7))
    kept = dec.drop_contaminated(docs, bench, broadcast_windows=windows)
    assert sorted(r["doc_id"] for r in kept.collect()) == [7, 8, 9, 10]


@pytest.mark.parametrize("windows", [0, dec.BROADCAST_WINDOWS])
def test_inconsistent_slots_are_no_match(spark, windows):
    """One value for one value, both ways, over the whole item."""
    item = "Ann saw 3 of Ann and 3 of Ann then 3 or Ann met 3 on Ann"
    bench = spark.createDataFrame([(1, item), (2, ITEMS[0][1])], "item_id long, text string")
    names, n = iter("Bea Cid Dot Eva Fay".split()), iter(range(10, 30))
    scrambled = " ".join(next(names) if w == "Ann" else str(next(n)) if w == "3" else w for w in item.split())
    swapped = item.replace("Ann", "Zoe").replace("3", "44")
    many_to_one = "Carol has 7 apples and gives 7 apples to Carol before walking 9 km home, how many apples remain with Carol?"
    half = f"{ITEMS[0][1].replace('12', '90')} {FILL} {ITEMS[0][1].replace('12', '91')}"  # two copies, each consistent
    docs = spark.createDataFrame([(1, scrambled), (2, swapped), (3, many_to_one), (4, half)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in dec.decontaminate(docs, bench, broadcast_windows=windows).collect()}
    assert [got[k]["item_ids"] for k in range(1, 5)] == [[], [1], [], [2]]
    assert got[4]["coverage"] == 1.0 and got[4]["changed_slots"] == 1


def values(text, change):
    """text with its numbers and names changed by `change`."""
    return re.sub(r"\d+(?:[.,]\d+)*|(?<![^\W\d_])[A-Z][a-zà-ÿ]+(?![^\W\d_])", lambda m: change(m[0]), text)


@pytest.mark.parametrize("windows", [0, dec.BROADCAST_WINDOWS])
def test_every_item_contaminates_itself(spark, windows):
    """Each item as it stands and with other values throughout, not with values that contradict each other."""
    rng = random.Random(7)
    names, nouns = "Ann Bob Cara Dan Eve Finn Gail Hugo".split(), "apples pears books coins stones shells".split()
    items = [r["text"] for r in q.table(spark, D, "benchmark").collect()]
    n_given = len(items)
    for _ in range(60):
        x, y = rng.sample(names, 2)
        a, b = rng.sample(range(2, 99), 2)
        items.append(f"{x} has {a} {rng.choice(nouns)} while {y} holds {b} more than {x} once had before {y} gave {a} of the {b} back to {x} and kept the rest")
    other = {**{n: f"{n[::-1].title()}q" for n in names}, **{str(k): str(k + 1000) for k in range(200)}}
    fresh = iter(range(5000, 10**6))
    docs = [(i, f"{FILL} {t} {FILL}") for i, t in enumerate(items)]
    docs += [(10_000 + i, values(t, lambda v: other.get(v, v))) for i, t in enumerate(items) if i >= n_given]
    docs += [(20_000 + i, values(t, lambda v: f"Q{''.join(chr(97 + int(c)) for c in str(next(fresh)))}" if v[0].isalpha() else str(next(fresh)))) for i, t in enumerate(items) if i >= n_given]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in dec.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench, broadcast_windows=windows).collect()}
    assert all(i % 10_000 in got[i] for i, _ in docs if i < 20_000)
    assert not any(i % 10_000 in got[i] for i, _ in docs if i >= 20_000)


def test_both_ways_are_alike(spark):
    """The broadcast and the shuffled comparison on a whole table, with repeated and null ids, rows and items; rows go by their texts."""
    docs = q.table(spark, D, "documents", "doc_id", "text")
    bench = q.table(spark, D, "benchmark", "item_id", "text")
    first = bench.first()["text"]
    more = [(7, f"{FILL} {first}"), (7, FILL), (None, f"{FILL} {first}"), (None, FILL), (None, None), (8, first), (8, first)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("_gone", F.lit(1)).withColumn("key", F.lit("k"))
    bench = bench.unionByName(spark.createDataFrame([(0, first), (0, first), (None, FILL[:40])], bench.schema))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r))
    a, b = (sorted(dec.decontaminate(docs, bench, broadcast_windows=w).collect(), key=key) for w in (dec.BROADCAST_WINDOWS, 0))
    assert a == b and sum(r["contaminated"] for r in a) > 10
    bench = bench.where("item_id is not null")
    a, b = (sorted(dec.drop_contaminated(docs, bench, broadcast_windows=w).collect(), key=key) for w in (dec.BROADCAST_WINDOWS, 0))
    assert a == b and [r["text"] for r in a if r["doc_id"] is None] == [FILL, None] and sum(r["text"] == FILL for r in a) == 2


def test_windows_meet_only_their_own_width(spark):
    """Shared windows, before any is judged, are few: items give windows of their own width only."""
    docs, bench = q.table(spark, D, "documents", "doc_id", "text"), q.table(spark, D, "benchmark", "item_id", "text")
    items = dec.Benchmark([(r["item_id"], r["text"]) for r in bench.collect()])
    pairs = set()
    for r in docs.collect():
        for _, _, data, offsets in slices(pa.array([r["text"]])):
            pairs |= {(r["doc_id"], int(items.of[i])) for _, _, i, _ in items.probe(dec.tokenize(data, offsets))}
    assert len(pairs) < 100


def test_tokens_of_a_long_text_in_blocks(monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice(["12", "3.5", "km", "Anna", "É", "über", "x", "7,000", "...", "McDo"]) for _ in range(400)) + "9" * 300
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = dec.tokenize(data, offsets)
    h = {w: [np.concatenate([x for e, *rest in dec.windows_of_width(whole, w) if e == exact for x in rest[:1]]) for exact in (False, True)] for w in (2, 6)}
    for size in (16, 50, 333):
        monkeypatch.setattr(dec, "SLICE_BYTES", size)
        got = dec.tokenize(data, offsets)
        assert all(np.array_equal(x, y) for x, y in zip((whole.template, whole.surface, whole.kind, whole.first), (got.template, got.surface, got.kind, got.first)))
        for w in (2, 6):
            again = [np.concatenate([x for e, *rest in dec.windows_of_width(got, w) if e == exact for x in rest[:1]]) for exact in (False, True)]
            assert all(np.array_equal(x, y) for x, y in zip(h[w], again))


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, FILL)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not dec.decontaminate(docs, none).first()["contaminated"] and dec.drop_contaminated(docs, none).count() == 1
    assert dec.decontaminate(docs.limit(0), none).count() == 0


def test_pipeline_stages(spark):
    """Each stage against what it is asked to keep, on its own input."""
    docs = q.table(spark, D, "documents")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "MinHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D).cache()
        assert out.columns == columns
        before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and 0.5 * len(before) < len(after) < len(before)
        if name == "MinHash near-dedup":
            from test_near_dedup import brute

            data = sorted(before.items())
            assert set(after) == {d for (d, _), c in zip(data, brute(data)) if c == d}
        if name == "benchmark decontamination":
            items = [" ".join(r["text"].split()) for r in q.table(spark, D, "benchmark").collect()]
            leaked = {d for d, t in before.items() if any(i in " ".join(t.split()) for i in items)}
            assert set(after) == set(before) - leaked
        docs = out
    final = corpus_pipeline.run(spark, D)
    assert {r["doc_id"] for r in final.collect()} == {r["doc_id"] for r in docs.collect()}
