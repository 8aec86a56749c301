"""Connected components, and bounded blocks of large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for every node of ``edges``; nodes are long and not null.

    Alternates large-star and small-star steps, each a few aggregations and joins, until the
    edges no longer change; that takes a number of rounds logarithmic in the longest path.
    Every round is a written table. A hub's edges are split by adaptive skew joins.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    sign = None
    now = materialize(now, "cc")
    while True:
        now = materialize(_small_star(_large_star(now)), "cc")
        got = now.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if got == sign or got[0] == 0:
            break
        sign = got
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())


def in_blocks(rows: DataFrame, group: Column, member: Column, size: Column, unit: Column, block: int) -> DataFrame:
    """Rows with columns bin, i, j, b: every two rows of a group share one (bin, i, j), of about 2 * ``block`` units at most.

    A row has ``unit`` units, its group ``size``. Groups of up to ``block`` units share bins with
    others of their kind; a larger one gets its rows dealt into blocks b by their hash, and i, j go
    over pairs of blocks. Rows of one bin may be of different groups, so compare only those of
    equal ``group``.
    """
    n = F.ceil(size / F.lit(block)).cast("long")
    units = rows.where(size <= block).agg(F.coalesce(F.sum(unit), F.lit(0))).first()[0]
    bins = max(1, -(-units // block))
    zero = F.lit(0).cast("long")
    small = rows.where(size <= block).withColumns({"bin": F.pmod(F.xxhash64(group), F.lit(bins)).cast("string"), "i": zero, "j": zero, "b": zero})
    large = rows.where(size > block).withColumns({"bin": F.concat(F.lit("g"), group.cast("string")), "b": F.pmod(F.xxhash64(member), n), "_n": n})
    large = large.withColumn("_k", F.explode(F.sequence(zero, F.col("_n") - 1)))
    large = large.withColumns({"i": F.least("b", "_k"), "j": F.greatest("b", "_k")}).drop("_k", "_n")
    return small.unionByName(large)
