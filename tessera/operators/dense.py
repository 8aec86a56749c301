"""Dense retrieval: exact cosine top-k, and ranks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cosine
from tessera.runtime import ship

DENSE_K = 50
#: Numbers (vectors times dimension) in a block of the batch search, at least and at most; queries that a task multiplies at once.
LEAST, MOST, TILE = 1 << 16, 1 << 20, 256


def top_k(vectors: DataFrame, query: Sequence[float], k: int = DENSE_K, digits: int | None = None) -> DataFrame:
    """chunk_id, score of the ``k`` best vectors, ties by id; other dimensions and null vectors are left out."""
    if k < 0:
        raise ValueError("k must not be negative")
    if not query:
        raise ValueError("empty query vector")
    q = F.array(*(F.lit(float(x)) for x in query))
    score = cosine(F.col("embedding"), q)
    score = score if digits is None else F.round(score, digits)
    scored = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(query))).select("chunk_id", score.alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def fast_top_k(vectors: DataFrame, query: Sequence[float], k: int = DENSE_K) -> DataFrame:
    """The same with one matrix product a batch: each task passes on its ``k`` best of every batch."""
    if not query:
        raise ValueError("empty query vector")
    ship(vectors.sparkSession)
    q = np.asarray(query, dtype=np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.operators.dense import best_of_batch

        for b in batches:
            ids, scores = best_of_batch(b.column(0), b.column(1), q, k)
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], ["chunk_id", "score"])

    own = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(q))).select("chunk_id", "embedding")
    kind = own.schema["chunk_id"].dataType.simpleString()
    return own.mapInArrow(run, f"chunk_id {kind}, score double").orderBy(F.desc("score"), "chunk_id").limit(k)


def best_of_batch(ids: pa.Array, vectors: pa.ListArray, q: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), len(q))
    size = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(q @ q)
    score = np.divide(x @ q, size, out=np.zeros(len(x)), where=size > 0)
    order = np.empty(len(ids), dtype=np.int64)
    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    best = np.lexsort((order, -score))[:k]
    return ids.take(pa.array(best)), score[best]


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int | None = None, least: int = LEAST, most: int = MOST) -> DataFrame:
    """query_id, chunk_id, score, rank of the ``k`` best vectors for every row of ``queries`` (query_id, query).

    Queries and vectors are dealt into blocks of bounded size; each pair of blocks is one matrix product that passes on
    its ``k`` best for each query, and those are merged. Vectors that are null, or hold null or NaN, are left out.
    """
    ship(vectors.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tessera.operators.dense import TILE, best_of_rows

        pdf = pdf.sort_values("id", ignore_index=True)
        asked = pdf["asks"].to_numpy()
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        size = np.sqrt(np.einsum("ij,ij->i", x, x))
        x = np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
        ids, q, y = pdf["id"].to_numpy(), np.flatnonzero(asked), np.flatnonzero(~asked)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(y) and k > 0:
            for lo in range(0, len(q), TILE):
                t = q[lo : lo + TILE]
                scores = x[t] @ x[y].T
                scores = scores if digits is None else np.round(scores, digits)
                row, col = best_of_rows(scores, k)
                out.append((ids[t[row]], ids[y[col]], scores[row, col]))
        return pd.DataFrame(dict(zip(("query_id", "chunk_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    def typed(df: DataFrame, key: str, v: str, asks: bool) -> DataFrame:
        own = df.select(F.lit(asks).alias("asks"), F.col(key).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
        return own.where(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e))).withColumn("dim", F.size("v"))

    def blocks(df: DataFrame, most: int) -> int:
        return max(1, -(-df.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0] // most))

    own, asked = typed(vectors, "chunk_id", "embedding", False), typed(queries, "query_id", "query", True)
    n_own, n_asked = blocks(own, least), blocks(asked, most)
    n_own = max(blocks(own, most), min(n_own, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = own.withColumn("vb", dealt(n_own)).withColumn("qb", every(n_asked)).unionByName(asked.withColumn("qb", dealt(n_asked)).withColumn("vb", every(n_own)))
    best = rows.groupBy("dim", "qb", "vb").applyInPandas(run, "query_id long, chunk_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest scores of each row, ties by column."""
    k = min(k, scores.shape[1])
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    row, col = np.nonzero(scores >= least)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], col[kept]


def ranked(best: DataFrame) -> DataFrame:
    """Adds rank, best first, to a frame of bounded size (a top-k result)."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
