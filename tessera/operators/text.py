"""Entities in text: extraction by pattern and keyword, deduplication, relations, path scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATTERN_CONFIDENCE, KEYWORD_CONFIDENCE, FUZZY = 0.8, 0.9, 0.8


def extract_patterns(docs: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str]) -> DataFrame:
    """(id, type, text, confidence 0.8): every match of every type's regular expression in whole texts."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("type"), m.alias("text")))

    found = [of(t, p) for t, p in patterns.items()]
    return docs.select(id_col, F.explode(F.concat(*found)).alias("m")).select(id_col, "m.type", "m.text", F.lit(PATTERN_CONFIDENCE).alias("confidence"))


def extract_keywords(docs: DataFrame, id_col: str, text_col: str, keywords: DataFrame, max_keywords: int = 1_000_000) -> DataFrame:
    """(id, type, text, confidence 0.9): words and phrases of the text that equal a keyword (keyword, type), case ignored, by a hash join.

    A keyword of several words matches these words one after another, whatever stands between
    them that is no letter or digit; keywords that begin or end with such a character match nothing.
    """

    def split(text: str) -> Column:
        return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    known = keywords.where(F.col("keyword").rlike(r"^[\p{L}\p{N}]") & F.col("keyword").rlike(r"[\p{L}\p{N}]\z"))
    known = known.select(split("keyword").alias("_words"), "type", F.col("keyword").alias("text"))
    longest = known.agg(F.max(F.size("_words"))).first()[0] or 1
    known = known.select(F.array_join("_words", " ").alias("_word"), "type", "text")
    words = docs.select(id_col, split(text_col).alias("_words"))

    def phrases(n: int) -> Column:
        starts = F.when(F.size("_words") >= n, F.sequence(F.lit(1), F.size("_words") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.col("_words") if n == 1 else F.transform(starts, lambda k: F.array_join(F.slice("_words", k, n), " "))

    words = words.select(id_col, F.explode(F.array_distinct(F.concat(*[phrases(n) for n in range(1, longest + 1)]))).alias("_word"))
    small = known.limit(max_keywords + 1).count() <= max_keywords
    return words.join(F.broadcast(known) if small else known, "_word").select(id_col, "type", "text", F.lit(KEYWORD_CONFIDENCE).alias("confidence"))


def dedupe_exact(entities: DataFrame) -> DataFrame:
    """(type, text, confidence): one row for each, with the highest confidence."""
    return entities.groupBy("type", "text").agg(F.max("confidence").alias("confidence"))


def dedupe_fuzzy(entities: DataFrame, threshold: float = FUZZY) -> DataFrame:
    """Exact duplicates merged; then a text goes if one of its type, better (confidence, then order), is similar enough.

    Similarity is 1 - Levenshtein distance / the longer length, case ignored. Pairs meet by pieces:
    of a text cut into one piece more than the edits allowed, one stands unchanged in any similar
    text, at most that many places off. So no similar pair is missed, and none is made but by a piece.
    """
    e = dedupe_exact(entities).withColumn("_low", F.lower("text")).withColumn("_len", F.length("_low"))
    edits = lambda n: F.floor((1 - threshold) * F.floor(n / threshold + 1e-9) + 1e-9).cast("int")  # noqa: E731  at most, of a text of n letters and any similar one
    begin = lambda n, k: F.floor(k * n / (edits(n) + 1)).cast("int")  # noqa: E731  where piece k begins, from 0
    piece = lambda at, size: F.substring("_low", at, size)

    def span(low: Column, high: Column) -> Column:
        return F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))

    n = F.col("_len")
    own = F.transform(span(F.lit(0), edits(n)), lambda k: F.struct(n.alias("n"), k.alias("k"), piece(begin(n, k) + 1, begin(n, k + 1) - begin(n, k)).alias("p")))
    better = e.where("_len > 0").select(F.col("type"), F.col("_low").alias("_text"), F.col("text").alias("_full"), F.col("confidence").alias("_conf"), F.explode(own).alias("_at"))

    def near(m: Column) -> Column:
        def of(k: Column) -> Column:
            size, at = begin(m, k + 1) - begin(m, k), begin(m, k) + 1
            places = span(F.greatest(F.lit(1), at - edits(m)), F.least(n - size + 1, at + edits(m)))
            return F.transform(places, lambda i: F.struct(m.alias("n"), k.alias("k"), piece(i, size).alias("p")))

        return F.flatten(F.transform(span(F.lit(0), edits(m)), of))

    lengths = span(F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9)), F.floor(n / threshold + 1e-9))
    probes = e.where("_len > 0").withColumn("_at", F.explode(F.array_distinct(F.flatten(F.transform(lengths, near)))))
    beats = (F.col("_conf") > F.col("confidence")) | ((F.col("_conf") == F.col("confidence")) & (F.col("_full") < F.col("text")))
    close = 1 - F.levenshtein("_low", "_text") / F.greatest(n, F.length("_text")) >= threshold - 1e-9
    losers = probes.join(better, ["type", "_at"]).where(beats & close).select("type", "text").distinct()
    return e.drop("_low", "_len").join(losers, ["type", "text"], "left_anti")


def extract_contained(docs: DataFrame, id_col: str, text_col: str, keywords: DataFrame, at_once: int = 2_000) -> DataFrame:
    """(id, type, text, position, confidence 0.9): keywords (keyword, type) found anywhere in the lower-cased text, inside words too, each once, at its first place (from 0).

    Keywords are tried in blocks of at_once, one scan a block; for long lists of whole words
    `extract_keywords` joins instead.
    """
    known = [(r["keyword"], r["type"]) for r in keywords.select("keyword", "type").distinct().orderBy("keyword", "type").toLocalIterator() if r["keyword"]]
    low, out = F.lower(text_col), None
    for k in range(0, len(known), at_once):
        tried = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(w).alias("text"), F.instr(low, w.lower()).alias("at")) for w, t in known[k : k + at_once]])
        hits = docs.select(id_col, F.explode(F.filter(tried, lambda x: x["at"] > 0)).alias("m"))
        rows = hits.select(id_col, "m.type", "m.text", (F.col("m.at") - 1).alias("position"), F.lit(KEYWORD_CONFIDENCE).alias("confidence"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.select(id_col, F.lit("").alias("type"), F.lit("").alias("text"), F.lit(0).alias("position"), F.lit(KEYWORD_CONFIDENCE).alias("confidence")).limit(0)
    return out


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy_matches(text: str, keyword: str, least: float = FUZZY) -> list[tuple[int, str, float]]:
    """(place, window, similarity): windows of the keyword's length (3 at least) that are similar, the best first, none overlapping.

    Only windows around an unchanged piece of the keyword are compared: with d edits allowed, one of
    d + 1 pieces stands in any similar window.
    """
    size = max(len(keyword), 3)
    if not keyword or len(text) < size:
        return []
    allowed = int((1 - least) * size + 1e-9)
    cuts = [len(keyword) * k // (allowed + 1) for k in range(allowed + 2)]
    starts: set[int] = set()
    for a, b in zip(cuts, cuts[1:]):
        at = text.find(keyword[a:b]) if b > a else -1
        while at >= 0:
            starts.update(range(max(0, at - a - allowed), min(len(text) - size, at - a + allowed) + 1))
            at = text.find(keyword[a:b], at + 1)
    found = [(1 - edit_distance(keyword, text[i : i + size]) / max(len(keyword), size), i) for i in sorted(starts)]
    out: list[tuple[int, str, float]] = []
    for score, i in sorted((f for f in found if f[0] >= least - 1e-9), key=lambda f: (-f[0], f[1])):
        if all(i + size <= j or j + size <= i for j, _, _ in out):
            out.append((i, text[i : i + size], score))
    return out


def extract_fuzzy(docs: DataFrame, id_col: str, text_col: str, keywords: DataFrame, least: float = FUZZY, max_keywords: int = 100_000) -> DataFrame:
    """(id, type, keyword, text, position, confidence: the similarity): windows of the lower-cased text similar to a keyword; on Arrow batches, the keywords broadcast."""
    known = [(r["keyword"].lower(), r["type"], r["keyword"]) for r in keywords.where("keyword is not null").select("keyword", "type").distinct().limit(max_keywords + 1).collect()]
    if len(known) > max_keywords:
        raise ValueError(f"more than {max_keywords} keywords: give them in parts")
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for d, text in zip(part.iloc[:, 0], part.iloc[:, 1]):
                for word, kind, name in shared.value if text else ():
                    out += [(d, kind, name, found, at, score) for at, found, score in fuzzy_matches(text.lower(), word, least)]
            yield pd.DataFrame(out, columns=[id_col, "type", "keyword", "text", "position", "confidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, type string, keyword string, text string, position int, confidence double")


# fixed values: the basic relations, their patterns and confidences
RELATIONS = {
    "WORKS_FOR": (r"\b(\w+)\s+works\s+for\s+(\w+)\b", 0.7),
    "LOCATED_IN": (r"\b(\w+)\s+(?:is\s+)?(?:located\s+)?in\s+(\w+)\b", 0.6),
}


def extract_relations(docs: DataFrame, id_col: str, text_col: str, rules: Mapping[str, tuple[str, float]] = RELATIONS) -> DataFrame:
    """(id, source, target, type, confidence): the two groups of every match of every rule's pattern, in order."""
    groups = lambda pattern, g: F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(g))
    of = lambda name, pattern, sure: F.zip_with(groups(pattern, 1), groups(pattern, 2), lambda a, b: F.struct(a.alias("source"), b.alias("target"), F.lit(name).alias("type"), F.lit(sure).alias("confidence")))
    found = F.concat(*[of(name, pattern, float(sure)) for name, (pattern, sure) in rules.items()])
    return docs.select(id_col, F.explode(found).alias("m")).select(id_col, "m.*")


def cooccurrences(entities: DataFrame, id_col: str, max_distinct: int = 1000) -> DataFrame:
    """(a, b, n): pairs of different entity texts in one document, a < b, and in how many documents. Documents are the bound of a pair list."""
    e = entities.select(id_col, "text").distinct()
    return e.join(e.withColumnRenamed("text", "_b"), id_col).where(F.col("text") < F.col("_b")).groupBy(F.col("text").alias("a"), F.col("_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def path_score(confidence: Column, hops: Column, relevance: Column) -> Column:
    """Combined score: 0.4 * confidence + 0.3 * 1 / hops + 0.3 * relevance."""
    return 0.4 * confidence + 0.3 / hops + 0.3 * relevance


def best_paths(start: DataFrame, edges: DataFrame, max_hops: int, keep: int, least: float = 0.2) -> DataFrame:
    """(start, end, hops, confidence, path): per start and end the `keep` best simple paths by the product of edge confidences, dropping what falls below `least`."""
    step = edges.select("src", "dst", F.col("confidence").alias("_c"))
    now = start.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(1.0).alias("confidence"), F.array("id").alias("path"))
    out = None
    for _ in range(max_hops):
        nxt = now.join(step, F.col("end") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        nxt = nxt.select("start", F.col("dst").alias("end"), (F.col("confidence") * F.col("_c")).alias("confidence"), F.array_append("path", F.col("dst")).alias("path")).where(F.col("confidence") >= least)
        now = nxt
        out = now if out is None else out.unionByName(now)
    w = Window.partitionBy("start", "end").orderBy(F.desc("confidence"), F.size("path"), "path")
    return out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n").withColumn("hops", F.size("path") - 1)


def term_frequencies(docs: DataFrame, id_col: str, text_col: str, terms: Sequence[str]) -> DataFrame:
    """Full-text match: (id, score) of documents that have all terms, score = occurrences."""
    lower = F.lower(F.col(text_col))
    counts = [F.size(F.regexp_extract_all(lower, F.lit(rf"(?<![\p{{L}}\p{{N}}]){t.lower()}(?![\p{{L}}\p{{N}}])"), F.lit(0))) for t in terms]
    rows = docs.select(id_col, *[c.alias(f"_{k}") for k, c in enumerate(counts)])
    hit = rows.where(" and ".join(f"_{k} > 0" for k in range(len(counts))))
    return hit.select(id_col, sum((F.col(f"_{k}") for k in range(len(counts))), F.lit(0)).cast("long").alias("score"))
