"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, fingerprints, languages, near_dedup, quality, sharding, token_counts, toxicity, url_filters
from tessera.llm.tables import table

RULES = [
    url_filters.Rule("block", "net/"),
    url_filters.Rule("allow", "example.net/en/"),
    url_filters.Rule("block", "example.com/de/"),
    url_filters.Rule("allow", "org/fr/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filters.filter_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(rule, rhost, rpath, rverdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
         ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fit AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(rverdict, length(rule)) AS rverdict
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict FROM split s LEFT JOIN fit f USING (page_id)
"""


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return toxicity.score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labels whose remainder by 5 isn't 0; kept: probably of grade 1 or better."""
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    model = quality.fit(docs, quality.grades(labels.where(remainder("doc_id", 5) != 0)))
    out = quality.grade(docs, model)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail_probability", "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = languages.fit(docs.where(remainder("doc_id", 3) != 1))
    return languages.identify(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "languages")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words
), windows AS (
  SELECT doc_id, count(*) OVER d AS n, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p, lead(word, 4) OVER p) AS shingle, i
  FROM places WINDOW p AS (PARTITION BY doc_id ORDER BY i), d AS (PARTITION BY doc_id)
), sets AS (SELECT DISTINCT doc_id, shingle FROM windows WHERE i <= greatest(n - 4, 1)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN sizes m ON m.doc_id = x.doc_id JOIN sizes n ON n.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (any_value(m.n) + any_value(n.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT l.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, l.doc_id = l.component_id AS kept FROM least l LEFT JOIN sizes s USING (doc_id)
"""


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fingerprints are taken of: the part of op2 that SQL can express."""
    return op2_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITS_SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), pairs AS (
  SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM texts
)
SELECT doc_id, length(text) AS n_chars, sha256(substr(text, 1, length(text) - length(text) // 2) || substr(next, 1, length(text) // 2)) AS edited_sha256 FROM pairs
"""


def sharding_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7's law and its slots come to, shard by shard."""
    slot = F.col("slot")
    return op7_sharding(spark, sf_dir).groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.min(slot).alias("first_slot"), F.max(slot).alias("last_slot"), F.countDistinct(slot).alias("n_slots"))


SIZES_SQL = """
WITH total AS (SELECT count(*) AS n FROM documents),
shards AS (SELECT CAST(k AS INTEGER) AS shard, n // 8 + CASE WHEN k < n % 8 THEN 1 ELSE 0 END AS n_rows FROM total, range(8) t(k))
SELECT shard, n_rows, 0 AS first_slot, n_rows - 1 AS last_slot, n_rows AS n_slots FROM shards WHERE n_rows > 0
"""


def sharding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_sharding(spark, sf_dir).select("doc_id", "size")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filters, op2_fingerprints, op3_toxicity, op4_decontamination, op5_bpe, op6_quality, op7_sharding, op8_language_id, op9_token_counts, op10_near_dedup)
    parts = (fingerprint_edits, sharding_sizes, sharding_texts)
    return {f.__name__: f for f in ops + parts} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL in full for ops 1 and 10; for ops 2 and 7, of what doesn't depend on the method."""
    return {
        "op1_url_filters": OP1_SQL, "op10_near_dedup": OP10_SQL, "fingerprint_edits": EDITS_SQL, "sharding_sizes": SIZES_SQL,
        "sharding_texts": "SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size FROM documents",
    }
