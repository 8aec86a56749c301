"""Overlapping line windows and the merging of small ones, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES, OVERLAP, MERGE_LINES = 60, 10, 4
#: Some character that is no white space, by Unicode.
NOT_BLANK = r"(?U)\S"


def window_options(max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> tuple[int, int]:
    """Lines of a window and its step; an overlap of a whole window or more becomes half of one."""
    if max_lines < 1:
        raise ValueError("max_lines must be at least 1")
    if overlap >= max_lines:
        overlap = max_lines // 2
    step = max_lines - overlap
    return max_lines, step if step >= 1 else max_lines


def line_windows(df: DataFrame, text: str = "content", max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """``df`` without ``text`` and a row for each window: ordinal, start_line, end_line, chunk. Blank windows go."""
    size, step = window_options(max_lines, overlap)
    others = [c for c in df.columns if c != text]
    lines = df.where(F.length(text) > 0).select(*others, F.split(F.regexp_replace(text, r"\n+\z", ""), "\n").alias("_lines"))
    last = F.greatest(F.lit(0), F.size("_lines") - (size - step) - 1)
    at = lines.select("*", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("ordinal", "_at"))
    chunk = F.array_join(F.slice("_lines", F.col("_at") + 1, F.lit(size)), "\n")
    out = at.select(*others, "ordinal", (F.col("_at") + 1).alias("start_line"), F.least(F.col("_at") + size, F.size("_lines")).alias("end_line"), chunk.alias("chunk"))
    return out.where(F.col("chunk").rlike(NOT_BLANK))


def merge_small(chunks: Column, max_lines: int = MAX_LINES, merge_lines: int = MERGE_LINES) -> Column:
    """Fold an array of (start_line, end_line, symbol, content): a small nameless chunk joins a nameless one before it."""
    span = lambda c: c["end_line"] - c["start_line"] + 1

    def step(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (x["symbol"] == "") & (before["symbol"] == "") & (span(x) <= merge_lines) & (span(before) < max_lines)
        joined = F.struct(before["start_line"].alias("start_line"), x["end_line"].alias("end_line"), F.lit("").alias("symbol"), F.concat_ws("\n", before["content"], x["content"]).alias("content"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    # element_at of an empty array is only reached behind the size test once the array has a row.
    first = F.slice(chunks, 1, 1)
    return F.aggregate(F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))), first, step)
