"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.dense import ranked

RRF_K = 60.0


def fuse(dense: DataFrame, lexical: DataFrame, k: float = RRF_K) -> DataFrame:
    """chunk_id, score of two top-k results (chunk_id, score): the sum of 1 / (k + rank), best first, ties by id."""
    k = k if k > 0 else RRF_K
    d = ranked(dense).select("chunk_id", F.col("rank").alias("rank_d"))
    x = ranked(lexical).select("chunk_id", F.col("rank").alias("rank_l"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    return d.join(x, "chunk_id", "full").select("chunk_id", (part("rank_d") + part("rank_l")).alias("score")).orderBy(F.desc("score"), "chunk_id")
