"""Vector functions on array<float> columns, as codegen-friendly higher-order expressions, and k-nearest search.

Distances of vectors with different dimensions, or with a null, are null. A zero vector has cosine
similarity 0. The inner product is positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def dot(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def hamming(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Coordinates on different sides of the threshold."""
    return _sum(a, b, lambda x, y: F.when((x > threshold) != (y > threshold), 1.0).otherwise(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def dims(a: Column) -> Column:
    return F.when(a.isNotNull(), F.size(a))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(F.size(a) == F.size(b), 0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def score(metric: str, a: Column, b: Column) -> Column:
    """Similarity: cosine, dot, or 1 / (1 + distance) for l2 and l1."""
    return {"cosine": cosine_similarity, "dot": dot, "l2": lambda x, y: 1 / (1 + l2(x, y)), "l1": lambda x, y: 1 / (1 + l1(x, y))}[metric](a, b)


def search(df: DataFrame, vector: list[float], k: int, metric: str = "cosine", threshold: float | None = None, where: Column | None = None, col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k rows of the highest score to one query vector: metadata filter, score, threshold, top-k. No global sort: each task keeps k rows."""
    rows = df.where(where) if where is not None else df
    query = F.array(*[F.lit(float(v)) for v in vector])
    scored = rows.withColumn("score", score(metric, F.col(col), query))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


MAX_QUERY_FLOATS = 8_000_000


def knn_join(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "vec_id", col: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank): exact k nearest rows of df for each query row.

    Queries are collected in blocks of at most MAX_QUERY_FLOATS numbers and broadcast; every task
    multiplies its rows with a block and keeps k candidates a query, so the shuffle is of k rows for
    each query and task. These are ranked in 64 parts a query, then the best k of each part.
    """
    total = queries.count()
    if not total:
        return df.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    width = queries.select(F.max(F.size(col))).first()[0] or 1
    blocks = max(1, -(-total * width // MAX_QUERY_FLOATS))
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b).select(F.col(id_col).cast("long"), col).toArrow()
        ids = part.column(0).to_numpy()
        matrix = np.array([np.asarray(v, np.float64) for v in part.column(1).to_pylist()])
        shared = df.sparkSession.sparkContext.broadcast((ids, matrix))
        found = df.select(F.col(id_col).cast("long"), col).where(F.col(col).isNotNull()).mapInArrow(_nearest(shared, k, metric, exclude_self), "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    fewer = out.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", rank("query_id", "_part")).where(F.col("rank") <= k)
    return fewer.drop("_part").withColumn("rank", rank("query_id")).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")


def _nearest(shared, k: int, metric: str, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        qn = np.linalg.norm(q, axis=1)
        top_s = np.full((len(ids), 0), -np.inf)
        top_i = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                own = part.column(0).to_numpy()
                x = np.array([np.asarray(v, np.float64) for v in part.column(1).to_pylist()])
                s = q @ x.T
                if metric == "cosine":
                    n = qn[:, None] * np.linalg.norm(x, axis=1)[None, :]
                    s = np.divide(s, n, out=np.zeros_like(s), where=n > 0)
                elif metric == "l2":
                    s = 1 / (1 + np.sqrt(np.maximum((qn**2)[:, None] + (x**2).sum(1)[None, :] - 2 * s, 0)))
                if exclude_self:
                    s[ids[:, None] == own[None, :]] = -np.inf
                top_s, top_i = np.concatenate([top_s, s], 1), np.concatenate([top_i, np.broadcast_to(own, s.shape)], 1)
                if top_s.shape[1] > k:
                    keep = np.lexsort((top_i, -top_s), axis=1)[:, :k]
                    top_s, top_i = np.take_along_axis(top_s, keep, 1), np.take_along_axis(top_i, keep, 1)
        ok = np.isfinite(top_s)
        if ok.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(top_i[ok]), pa.array(top_s[ok])], ["query_id", "id", "score"])

    return run
