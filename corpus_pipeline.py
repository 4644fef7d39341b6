"""From raw documents to token ids: grade, drop toxic texts, near-duplicates and benchmark leaks, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of documents. `run` writes each stage's rows to the shared folder and reads
them again as the next one's documents.

Defined results: a null text is an empty one in every stage, it has the model's own probabilities
(kept, unless most rated texts are rejected), is a duplicate of nothing and leaks nothing; rows are
judged by their texts, whatever their ids, null or repeated; of equal rows one stays after the third
stage; empty tables give empty results, and without labels or benchmark items nothing is rejected for
them; other columns, of any names, go along to the last stage but one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontamination, near_dedup, quality, toxicity
from tessera.llm.scratch import release, rounds, written
from tessera.llm.tables import small_batches, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is probably 1 or better; rejected ones go."""
    small_batches(spark)
    return quality.drop_low(docs, quality.fit(docs, quality.grades(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near-duplicates."""
    small_batches(spark)
    return near_dedup.drop_duplicates(docs)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded): each document's ids and what they decode to."""
    small_batches(spark)
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", keep_civil),
    ("MinHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", keep_unleaked),
    ("BPE encoding and decoding", encode),
]
#: No stage but the fourth's join could be put into SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with rounds() as made:
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            release(made, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
