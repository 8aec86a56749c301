"""Line dedup: lines spread over many sites are boilerplate and stay in one document only.

Every line's hash carries a HyperLogLog sketch of the sites (``source``) it occurs in; sketches
merge in Spark's partial aggregation, so a line of a third of all rows costs a sketch for each
map task. A sketch's estimate decides lines well above or below ``min_sites``; lines within its
error get exact distinct counts. A boilerplate line stays in the document with the smallest
doc_id that has it, so its content is not lost, and goes from all others.

DataFrame functions only. Lines are compared without leading and trailing spaces; those shorter
than ``min_chars`` are never boilerplate.

Edge cases: null texts stay null and have no lines; a null source is a site of its own; rows
with null ids are never the document that keeps a line unless all are null, and then all keep it; repeated rows get
the same result each, so all rows of the id that keeps a line keep it; an empty table gives an empty result; other columns
pass through as they are, and may have any names but those that start with ``_ld_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import materialize, table

MIN_SITES, MIN_CHARS, LG_K = 5, 20, 12
#: Three standard errors of a sketch of 2^LG_K registers.
BAND = 3 * 1.04 / 2 ** (LG_K / 2)


def _print(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    line = F.trim("_ld_line")
    site = F.when(F.col("source").isNull(), "?").otherwise(F.concat(F.lit("="), "source"))
    return (
        docs.select("doc_id", "_ld_key", site.alias("_ld_site"), F.explode_outer(F.split("text", "\n")).alias("_ld_line"))
        .where(F.length(line) >= min_chars)
        .select("doc_id", "_ld_key", "_ld_site", _print(line).alias("_ld_hash"))
    )


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """_ld_hash, _ld_first: hashes of lines of at least ``min_sites`` sites, and the id that keeps each."""
    spread = lines.groupBy("_ld_hash").agg(F.hll_sketch_agg("_ld_site", F.lit(LG_K)).alias("_ld_sketch"), F.min("doc_id").alias("_ld_first"))
    guess = F.hll_sketch_estimate("_ld_sketch")
    low, high = min_sites * (1 - BAND) - 1, min_sites * (1 + BAND) + 1
    wide = materialize(spread.where(guess >= low).select("_ld_hash", "_ld_first", (guess > high).alias("_ld_sure")), "line-spread")
    near = wide.where("not _ld_sure").select("_ld_hash", "_ld_first")
    exact = lines.join(near.select("_ld_hash"), "_ld_hash", "left_semi").groupBy("_ld_hash", "_ld_site").agg(F.lit(1).alias("_ld_one"))
    exact = exact.groupBy("_ld_hash").agg(F.count("*").alias("_ld_n")).where(F.col("_ld_n") >= min_sites)
    return materialize(wide.where("_ld_sure").select("_ld_hash", "_ld_first").unionByName(near.join(exact.select("_ld_hash"), "_ld_hash", "left_semi")), "line-boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; with ``counts``, columns of those names for lines and lines removed."""
    keyed = docs.withColumn("_ld_key", F.xxhash64(F.lit(1), "text", F.lit(2)))  # with doc_id, what tells rows apart
    lines = _lines(keyed, min_chars)
    drop = lines.join(boilerplate(lines, min_sites), "_ld_hash").where(~F.col("doc_id").eqNullSafe(F.col("_ld_first")))
    drop = drop.groupBy(F.col("doc_id").alias("_ld_id"), F.col("_ld_key").alias("_ld_own")).agg(F.collect_set("_ld_hash").alias("_ld_drop"))
    split = F.split("text", "\n")
    kept = F.filter(split, lambda x: ~F.array_contains("_ld_drop", _print(F.trim(x))) | (F.length(F.trim(x)) < min_chars))
    out = keyed.join(drop, keyed["doc_id"].eqNullSafe(F.col("_ld_id")) & (F.col("_ld_key") == F.col("_ld_own")), "left").withColumn("_ld_kept", F.when(F.col("_ld_drop").isNotNull(), kept))
    own = [F.col(f"`{c}`") for c in docs.columns]
    text = F.when(F.col("_ld_kept").isNull(), F.col("text")).otherwise(F.array_join("_ld_kept", "\n"))
    own[docs.columns.index("text")] = text.alias("text")
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
        n_removed = F.when(F.col("_ld_kept").isNull(), 0).otherwise(F.size(split) - F.size("_ld_kept")).cast("long")
        own += [n_lines.alias(counts[0]), n_removed.alias(counts[1])]
    return out.select(own)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of the remaining text of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs, counts=("n_lines", "n_removed")).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def clean_sql(docs: str, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> str:
    """DuckDB SQL for doc_id, n_lines, n_removed and text (ids must be unique), of a table or parenthesised query."""
    return f"""SELECT doc_id, any_value(n) AS n_lines, count(*) FILTER (bad) AS n_removed,
  CASE WHEN any_value(whole) IS NULL THEN NULL ELSE coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT bad), '') END AS text
FROM (
  SELECT l.doc_id, l.n, l.whole, l.line, l.i, coalesce(b.first_id <> l.doc_id, false) AS bad
  FROM (SELECT doc_id, text AS whole, source, coalesce(len(string_split(text, chr(10))), 0) AS n, unnest(coalesce(string_split(text, chr(10)), [NULL])) AS line, unnest(range(1, greatest(coalesce(len(string_split(text, chr(10))), 0), 1) + 1)) AS i FROM {docs}) l
  LEFT JOIN (
    SELECT trim(line) AS t, min(doc_id) AS first_id
    FROM (SELECT doc_id, CASE WHEN source IS NULL THEN '?' ELSE '=' || source END AS site, unnest(string_split(text, chr(10))) AS line FROM {docs})
    WHERE length(trim(line)) >= {min_chars} GROUP BY 1 HAVING count(DISTINCT site) >= {min_sites}
  ) b ON b.t = trim(l.line)
) GROUP BY doc_id"""


ORACLE = f"SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS text_sha256 FROM ({clean_sql('documents')})"
