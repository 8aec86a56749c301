"""Incremental maintenance: what is new, changed, unchanged or deleted, and the tables after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(content) -> F.Column:
    """sha256 of bytes or text, in hex."""
    return F.sha2(content, 256)


def file_id(path) -> F.Column:
    """128 bits of a path, in hex."""
    return F.md5(path)


def diff(scan: DataFrame, files: DataFrame) -> DataFrame:
    """path and status (new, changed, unchanged, deleted) from (path, content_hash) of both sides."""
    now = scan.select("path", F.col("content_hash").alias("now")).dropDuplicates(["path"])
    old = files.select("path", F.col("content_hash").alias("old"), F.lit(True).alias("known"))
    both = now.withColumn("seen", F.lit(True)).join(old, "path", "full")
    status = F.when(F.col("seen").isNull(), "deleted").when(F.col("known").isNull(), "new").when(F.col("now").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def deleted_paths(scan: DataFrame, files: DataFrame) -> DataFrame:
    return files.select("path").join(scan.select("path"), "path", "left_anti")


def unchanged_files(scan: DataFrame, files: DataFrame) -> DataFrame:
    return scan.join(files.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def replace_rows(current: DataFrame, replaced: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """``current`` without the rows of ``replaced`` keys, and ``new``."""
    return current.join(replaced.select(key), key, "left_anti").unionByName(new)


def mark_stale(files: DataFrame) -> DataFrame:
    """Forget all content hashes, so that every file counts as changed while its chunks stay."""
    return files.withColumn("content_hash", F.lit(""))


def chunk_counts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_id, chunk_count; 0 for files without chunks."""
    return files.select("file_id").join(chunks.groupBy("file_id").count(), "file_id", "left").select("file_id", F.coalesce("count", F.lit(0)).cast("int").alias("chunk_count"))
