"""Hybrid search: dense and lexical candidates, fused by rank, then joined with their text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import dense, fusion, lexical


@dataclass(frozen=True)
class Tuning:
    dense_k: int = dense.DENSE_K
    lexical_k: int = lexical.LEXICAL_K
    rrf_k: float = fusion.RRF_K

    def __post_init__(self) -> None:
        if self.dense_k < 0 or self.lexical_k < 0:
            raise ValueError("candidate numbers must not be negative")


def hydrate(best: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Adds path, lines, symbol and content to a top-k result; ids that are gone drop out."""
    text = chunks.select("chunk_id", "file_id", "start_line", "end_line", "symbol", "content")
    return best.join(text, "chunk_id").join(files.select("file_id", "path"), "file_id").select("chunk_id", "path", "start_line", "end_line", "symbol", "content", "score")


def search(chunks: DataFrame, files: DataFrame, postings: DataFrame, query: str, vector: Sequence[float], top_n: int = 10, tuning: Tuning = Tuning(), fast: bool = True, vectors: DataFrame | None = None) -> DataFrame:
    """The ``top_n`` best chunks; only ids, vectors and counts are read until those are known."""
    if not query or top_n <= 0:
        return hydrate(chunks.select("chunk_id", F.lit(0.0).alias("score")).where("false"), chunks, files)
    vectors = chunks.select("chunk_id", "embedding") if vectors is None else vectors
    near = (dense.fast_top_k if fast else dense.top_k)(vectors, vector, tuning.dense_k)
    words = lexical.search(postings, chunks.select("chunk_id", "n_tokens"), query, tuning.lexical_k)
    best = fusion.fuse(near, words, tuning.rrf_k).limit(top_n)
    return hydrate(best, chunks, files).orderBy(F.desc("score"), "chunk_id")
