"""Sharding: best-fit-decreasing packing of indivisible groups of equal texts.

Packing is sequential, but groups of equal size are alike: after one of them is put into the tightest bin, that bin is still
the tightest for the next, as long as it fits. So all groups of a size are one item with a count, placed in runs, which gives
just what packing them one by one gives. There can be no more than sqrt(2 * bytes) different sizes, and only
the number of groups of each reaches the driver. Back in Spark, a group finds its shard by its size and its
rank among the groups of that size, which is counted in blocks. No group is ever split.

A group larger than the mean shard can't be packed near-equally; it gets a shard of its own
and the rest is balanced over the remaining shards.

Edge cases: a null text counts as empty (16 bytes) and groups with empty texts; null ids and
repeated rows are rows like any other; an empty table gives an empty result; columns other
than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.runtime import materialize, table

#: Bytes that each document takes beside its text.
OVERHEAD = 16
#: Sizes up to this many (about 60 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SIZES = 500_000
#: Rows of a shard that one slot-numbering task takes, and groups of a size that one ranking task takes, about.
SLOT_BLOCK, RANK_BLOCK = 2048, 256


class CapacityTree:
    """A treap of (remaining capacity, bin): insert, and take the tightest bin that holds a size."""

    def __init__(self, seed: int = 7) -> None:
        self._rng = random.Random(seed)
        self._root: list | None = None  # [key, priority, left, right]

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def insert(self, remaining: int, bin_id: int) -> None:
        key = (remaining, bin_id)
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._rng.random(), None, None]), right)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        left, right = self._split(self._root, (size, -1))
        if right is None:
            self._root = left
            return None
        node, parent = right, None
        while node[2] is not None:
            node, parent = node[2], node
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(left, right)
        return node[0]


#: For each size, how many of its items go to which bin, in order.
Runs = list[list[tuple[int, int]]]


def best_fit_decreasing(items: list[tuple[int, int]], capacity: int, max_bins: int | None = None) -> Runs | None:
    """Runs of (bin, items) for each (size, count) of ``items``, largest first; None if more than ``max_bins`` are needed."""
    tree, n, out = CapacityTree(), 0, []
    for size, count in items:
        runs = []
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if n == max_bins or size > capacity:
                    return None
                found, n = (capacity, n), n + 1
            remaining, b = found
            k = min(count, remaining // size)
            tree.insert(remaining - k * size, b)
            runs.append((b, k))
            count -= k
        out.append(runs)
    return out


def pack_into(items: list[tuple[int, int]], n_bins: int) -> Runs:
    """Best-fit-decreasing of (size, count), largest first, into ``n_bins`` bins at the least capacity that a search finds."""
    left, bins, rest = sum(s * c for s, c in items), n_bins, list(items)
    alone: Runs = []
    while rest and bins > 1 and rest[0][0] * bins >= left:  # as large as a mean shard of what is left: alone in its shard
        size, count = rest[0]
        runs = []
        while count and bins > 1 and size * bins >= left:
            runs.append((n_bins - bins, 1))
            left, bins, count = left - size, bins - 1, count - 1
        alone.append(runs)
        if count:
            rest[0] = (size, count)
            break
        rest.pop(0)
    if not rest:
        return alone
    low = max(rest[0][0], -(-left // bins))
    step = max(1, low // 20_000)
    best, high = best_fit_decreasing(rest, low, bins), low
    while best is None:
        low, high = high, high + step
        step *= 2
        best = best_fit_decreasing(rest, high, bins)
    while high - low > max(1, low // 20_000):
        mid = (low + high) // 2
        packed = best_fit_decreasing(rest, mid, bins)
        low, high, best = (mid, high, best) if packed is None else (low, mid, packed)
    shifted = [[(n_bins - bins + b, k) for b, k in runs] for runs in best]
    split = len(alone) + len(rest) > len(items)  # the first of the rest has items that are alone, too
    return [*alone[:-1], alone[-1] + shifted[0], *shifted[1:]] if split else alone + shifted


def _in_blocks(rows: DataFrame, group: str, block: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, numbers from 0 without gaps within ``group``: counted by block, then within each."""
    rows = rows.withColumn("block", block)
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(group, "block").count().select(group, "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(group, "block").orderBy(*order)
    numbered = rows.withColumn("i", F.row_number().over(within)).join(starts, [group, "block"])
    return numbered.withColumn(name, (F.col("start") + F.col("i") - 1).cast("long")).drop("i", "start", "block")


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit("second"), text).alias("h2"),
        ),
        "shard-rows",
    )
    n_rows = rows.count()
    groups = materialize(rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")), "shard-groups")
    # sqrt(2 * total) rows at most.
    items = sorted(((r.bytes, r["count"]) for r in groups.groupBy("bytes").count().collect()), reverse=True)
    placed = [(size, count, [b for b, _ in runs], list(accumulate(k for _, k in runs))) for (size, count), runs in zip(items, pack_into(items, n_shards), strict=True)]
    sizes = spark.createDataFrame(placed, "bytes long, alike long, bins array<int>, ends array<long>")
    sized = groups.join(F.broadcast(sizes) if len(placed) <= BROADCAST_SIZES else sizes, "bytes")
    whole = sized.where(F.size("bins") == 1).select("h1", "h2", F.get("bins", F.lit(0)).alias("shard"))
    dealt = _in_blocks(sized.where(F.size("bins") > 1), "bytes", F.pmod("h1", F.ceil(F.col("alike") / RANK_BLOCK)), ["h1", "h2"], "rank")
    dealt = dealt.select("h1", "h2", F.get("bins", F.size(F.filter("ends", lambda e: e <= F.col("rank")))).alias("shard"))
    out = rows.join(whole.unionByName(dealt), ["h1", "h2"])
    n_blocks = max(1, -(-n_rows // (n_shards * SLOT_BLOCK)))
    out = _in_blocks(out, "shard", F.pmod(F.xxhash64("doc_id", "h2"), F.lit(n_blocks)), ["doc_id", "h1", "h2"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes, groups of equal texts whole."""
    return shard_documents(table(spark, sf_dir, "documents"), 40)
