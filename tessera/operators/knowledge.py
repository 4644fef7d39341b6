"""Knowledge graphs from text: entities as nodes, co-occurrence as edges, retrieval along them.

Entities are (doc id, type, text, confidence) rows as `tessera.operators.text` extracts them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph, text


def build_knowledge(docs: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str], keywords: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities with their node as `entity`, nodes (id, text, type, confidence, documents), edges (src, dst, type, weight, confidence)); ids are hashes of type and text."""
    found = text.extract_patterns(docs, id_col, text_col, patterns)
    if keywords is not None:
        found = found.unionByName(text.extract_keywords(docs, id_col, text_col, keywords))
    entities = found.select(F.col(id_col), F.xxhash64("type", "text").alias("entity"), "type", "text", "confidence")
    nodes = entities.groupBy(F.col("entity").alias("id")).agg(F.first("text").alias("text"), F.first("type").alias("type"), F.max("confidence").alias("confidence"), F.count_distinct(id_col).alias("documents"))
    pairs = text.cooccurrences(entities.select(id_col, F.col("entity").alias("text")), id_col)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("co_occurs").alias("type"), F.col("n").alias("weight"), (1 - F.pow(F.lit(0.5), F.col("n"))).alias("confidence"))
    return entities, nodes, edges


def list_entities(nodes: DataFrame, kind: str | None = None, limit: int = 100) -> DataFrame:
    rows = nodes if kind is None else nodes.where(F.col("type") == kind)
    return rows.orderBy(F.desc("documents"), "text").limit(limit)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entities, relationships, types): one row."""
    n = nodes.agg(F.count(F.lit(1)).alias("entities"), F.count_distinct("type").alias("types"))
    return n.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("relationships"))))


def find_paths(nodes: DataFrame, edges: DataFrame, source: str, target: str, max_hops: int = 3, keep: int = 5) -> DataFrame:
    """The best paths between two entity texts over edges taken both ways, with the combined score."""
    e = edges.select("src", "dst", "confidence")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence"))
    paths = text.best_paths(nodes.where(F.col("text") == source).select("id"), both, max_hops, keep)
    ends = nodes.where(F.col("text") == target).select(F.col("id").alias("end"))
    return paths.join(ends, "end").withColumn("score", text.path_score(F.col("confidence"), F.col("hops"), F.lit(1.0)))


def find_similar(nodes: DataFrame, edges: DataFrame, entity: str, limit: int = 10) -> DataFrame:
    """(id, text, score): entities that share most neighbours with an entity, by Jaccard similarity of neighbourhoods."""
    near = graph.undirected(edges)
    size = near.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    own = near.join(nodes.where(F.col("text") == entity).select(F.col("id").alias("src")), "src").select(F.col("dst").alias("dst"), F.col("src").alias("own"))
    mine = own.agg(F.count(F.lit(1)).alias("m"))
    shared = near.join(own, "dst").where("src <> own").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("both"))
    scored = shared.join(size, "id").join(F.broadcast(mine)).select("id", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("score"))
    return scored.join(nodes.select("id", "text"), "id").orderBy(F.desc("score"), "text").limit(limit).select("id", "text", "score")


def rag_query(entities: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, words: Sequence[str], max_hops: int = 1, limit: int = 10) -> DataFrame:
    """(id, score, entities): documents that mention entities of the question's words, or what those lead to, best first. An entity counts 1 / (1 + hops)."""
    start = nodes.where(F.lower("text").isin([w.lower() for w in words])).select("id")
    reached = graph.bfs(start, graph.undirected(edges), max_hops).groupBy(F.col("node").alias("entity")).agg(F.min("depth").alias("depth"))
    hits = entities.select(id_col, "entity", "text").distinct().join(reached, "entity")
    return hits.groupBy(id_col).agg(F.round(F.sum(1 / (1 + F.col("depth"))), 6).alias("score"), F.sort_array(F.collect_set("text")).alias("entities")).orderBy(F.desc("score"), id_col).limit(limit)


def trends(entities: DataFrame, at: str, period: str) -> DataFrame:
    """(period, type, n): mentions of each type over time, from entities joined with their documents' time."""
    return entities.groupBy(F.date_trunc(period, at).alias("period"), "type").agg(F.count(F.lit(1)).alias("n"))


def semantic_search(vectors: DataFrame, nodes: DataFrame, vector: list[float], k: int) -> DataFrame:
    """Nodes by the similarity of their vectors (id, embedding) to a query's."""
    from tessera.functions.vectors import search

    return search(vectors, vector, k, id_col="id").select("id", "score").join(nodes, "id").orderBy(F.desc("score"), "id")
