"""MinHash near-dedup with min-max hashing.

Each of 48 permutations gives its minimum and its maximum over a document's shingles: 96 values
in 24 bands of 4, so a pair of similarity 0.8 shares no band with probability 3e-6. Documents
with equal shingle sets form a class, represented by its smallest id. Then, among representatives:

1. every member of a bucket is compared with the bucket's smallest id, which joins large groups of
   near copies in time linear in their size;
2. in buckets that still hold several components, all pairs across components are compared, in
   blocks of bounded size, so no bucket is capped and none is held by one task. Sets are compared
   in place and only links leave a block, so pairs that don't link are never rows.

Before sets are compared, pairs far from the threshold drop out by set size, which is exact, and by
their 96 one-byte sketches, where pairs four standard errors below the threshold remain. What remains is
confirmed on the full sets of both texts. Components come from linked pairs.

Edge cases: null, empty and blank texts have no shingles and link with nothing; a text of fewer
words than a shingle has one shingle; rows with a null id link with nothing, their component is null
and they are kept; rows that share an id are one node; an empty table gives an empty result; other
columns are ignored (``near_duplicates``) or pass through (``keep_representatives``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components, in_blocks
from tessera.runtime import materialize, ship, table

PERMUTATIONS, ROWS = 48, 4
#: Four standard errors of an estimate from 96 values at similarity 0.8.
MARGIN = 0.17
#: A document is one unit of a block, and one more for this many shingles.
UNIT = 1000
BLOCK = 1024
#: Ids up to this many are broadcast to fetch texts (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _signature_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    from tessera.llm.shingles import MinMax, shingle_hashes, text_words

    minmax = MinMax(PERMUTATIONS, ROWS)

    def flush(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        full = [i for i, s in enumerate(sets) if len(s)]
        lengths = np.array([len(s) for s in sets], dtype=np.int64)
        prints = np.zeros((len(sets), 2), dtype=np.uint64)
        buckets: list = [None] * len(sets)
        sketches: list = [None] * len(sets)
        if full:
            starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
            values = minmax.signatures(np.concatenate([sets[i] for i in full]), starts)
            for i, bucket, sketch in zip(full, minmax.buckets(values).view(np.int64), minmax.sketches(values), strict=True):
                buckets[i], sketches[i] = bucket, sketch.tobytes()
                prints[i] = np.add.reduce(sets[i]), np.bitwise_xor.reduce(sets[i] * np.uint64(0xD6E8FEB86659FD93))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array(buckets, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
            ["doc_id", "n_shingles", "p1", "p2", "buckets", "sketch"],
        )

    for b in batches:
        ids, sets, held = [], [], 0
        for i, t in zip(b.column(0), b.column(1), strict=True):
            raw = np.frombuffer(t.as_buffer() or b"", dtype=np.uint8) if t.is_valid else np.zeros(0, np.uint8)
            ids.append(i.as_py())
            sets.append(np.unique(shingle_hashes(text_words(raw), k)))
            held += len(sets[-1])
            if held >= 100_000:
                yield flush(ids, sets)
                ids, sets, held = [], [], 0
        if ids:
            yield flush(ids, sets)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, p1 and p2 (fingerprint of the set), buckets, sketch of every row."""
    ship(docs.sparkSession)

    def run(batches):
        from tessera.llm.minhash import _signature_batches

        yield from _signature_batches(batches, k)
        pa.default_memory_pool().release_unused()  # a worker outlives its task

    schema = "doc_id long, n_shingles long, p1 long, p2 long, buckets array<long>, sketch binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _near_enough(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (a, b), those whose set sizes and sketches allow the threshold."""
    side = lambda x: known.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold)

    def run(batches):
        from tessera.llm.shingles import estimate

        for x in batches:
            if x.num_rows:
                p, q = (np.frombuffer(b"".join(x.column(c).to_pylist()), dtype=np.uint8).reshape(x.num_rows, -1) for c in ("sa", "sb"))
                yield x.select(["a", "b"]).filter(pa.array(estimate(p, q) >= threshold - MARGIN))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text of the documents with ``ids``."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi"), "minhash-texts")


def _confirmed(pairs: DataFrame, known: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b), those whose full shingle sets have the similarity asked for.

    Pairs of one b, a bucket's least document, are compared together: those of small groups share a bin, those of a large one are dealt
    over bins of its own, and b's text goes to each bin once.
    """
    unit = known.select(F.col("doc_id").alias("a"), (1 + F.floor(F.col("n_shingles") / UNIT)).alias("unit"))
    sized = pairs.join(unit, "a")
    groups = sized.groupBy("b").agg(F.sum("unit").alias("units"))
    dealt = sized.join(groups, "b")
    n_bins = max(1, -(-(groups.where(F.col("units") <= BLOCK).agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]) // BLOCK))
    own = F.concat_ws(":", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("units") / BLOCK)))
    dealt = materialize(dealt.select("a", "b", F.when(F.col("units") <= BLOCK, F.pmod(F.xxhash64("b"), F.lit(n_bins)).cast("string")).otherwise(own).alias("bin")), "minhash-dealt")
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    members = dealt.join(texts.withColumnRenamed("doc_id", "a"), "a").select("bin", "b", "a", "text", F.lit(False).alias("hub"))
    hubs = dealt.select("bin", "b").distinct().join(texts.withColumnRenamed("doc_id", "b"), "b").select("bin", "b", F.col("b").alias("a"), "text", F.lit(True).alias("hub"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tessera.llm.shingles import shingle_set

        hubs, rest = pdf[pdf["hub"]].groupby("b")["text"], pdf[~pdf["hub"]].sort_values("b")
        last, hub, out = None, [], []
        for a, b, text in zip(rest["a"], rest["b"], rest["text"], strict=True):
            if b != last:  # an id may have several texts
                last, hub = b, [shingle_set(t, k) for t in hubs.get_group(b)]
            p = shingle_set(text, k)
            for q in hub:
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both > 0 and 100 * both >= percent * (len(p) + len(q) - both):
                    out.append((a, b))
                    break
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return members.unionByName(hubs).groupBy("bin").applyInPandas(run, "a long, b long").distinct()


def _links_across(open_rows: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: a forest of the linked pairs of one bucket whose components differ.

    A pair is looked at in the first band that it shares only. Sets are compared in place, so
    pairs that don't link are never rows, and documents that have been joined aren't compared again.
    """
    threshold = percent / 100

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tessera.llm.shingles import estimate, shingle_set

        pdf = pdf.sort_values(["bucket", "doc_id"], ignore_index=True)
        bucket, ids, comp, n, block = (pdf[c].to_numpy() for c in ("bucket", "doc_id", "component", "n_shingles", "b"))
        comp = comp.copy()
        sketch = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint8).reshape(len(pdf), -1)
        bands = np.stack(pdf["buckets"].to_numpy())
        between = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(pdf)]
        sets: dict[int, set] = {}
        out = []

        def whole(row: int) -> set:
            if row not in sets:
                sets[row] = set(shingle_set(pdf["text"].iloc[row], k).tolist())
            return sets[row]

        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            sets.clear()
            if hi - lo == 1 or (comp[lo:hi] == comp[lo]).all():
                continue
            band = int(np.flatnonzero(bands[lo] == bucket[lo])[0])
            for x in range(lo, hi - 1):
                y = np.arange(x + 1, hi)
                y = y[(comp[y] != comp[x]) & (np.minimum(n[y], n[x]) >= threshold * np.maximum(n[y], n[x]))]
                if between:
                    y = y[block[y] != block[x]]
                y = y[(bands[y] == bands[x]).argmax(axis=1) == band]
                if len(y):
                    guess = estimate(sketch[y], sketch[x])
                    for z in y[np.argsort(-guess)][: int((guess >= threshold - MARGIN).sum())]:
                        if comp[z] != comp[x]:
                            p, q = whole(x), whole(z)
                            both = len(p & q)
                            if 100 * both >= percent * (len(p) + len(q) - both):
                                out.append((ids[z], ids[x]))
                                comp[comp == comp[z]] = comp[x]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    blocks = in_blocks(open_rows, F.col("bucket"), F.col("doc_id"), F.col("units"), F.col("unit"), BLOCK)
    return blocks.groupBy("bin", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    threshold = percent / 100
    known = materialize(signatures(docs, k), "minhash-signatures")
    full = known.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(full.groupBy("n_shingles", "p1", "p2").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    # Written, so that joins of hubs with it are joins of plain tables, which adaptive execution splits.
    reps = full.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch", "buckets")
    reps = materialize(reps, "minhash-reps")

    rows = reps.select("doc_id", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1")
    members = materialize(rows.join(shared, "bucket"), "minhash-members")
    stars = members.where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
    stars = materialize(_near_enough(stars, reps.select("doc_id", "n_shingles", "sketch"), threshold), "minhash-stars")
    links = materialize(_confirmed(stars, reps.select("doc_id", "n_shingles"), docs, k, percent), "minhash-links")

    # An id with several texts is a node of all their classes.
    own = materialize(full.join(classes, ["n_shingles", "p1", "p2"]).select("doc_id", "rep").distinct(), "minhash-own")
    several = own.where("doc_id <> rep").join(own.groupBy("doc_id").count().where("count > 1"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = links.union(several)

    joined = materialize(connected_components(links), "minhash-joined")
    labelled = members.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    unit = 1 + F.floor(F.col("n_shingles") / UNIT)
    labelled = labelled.select("bucket", "doc_id", "component").join(reps.select("doc_id", "n_shingles", "sketch", "buckets").withColumn("unit", unit), "doc_id")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.sum("unit").alias("units")).where("c1 <> c2").select("bucket", "units")
    open_rows = materialize(labelled.join(mixed, "bucket"), "minhash-open")
    texts = _texts(docs, open_rows.select("doc_id").distinct())
    more = materialize(_links_across(open_rows.join(texts, "doc_id"), k, percent), "minhash-across")
    if not more.isEmpty():
        joined = connected_components(links.union(more))

    of_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "p1", "p2", F.coalesce("component", "rep").alias("component_id"))
    keyed = known.select("doc_id", "n_shingles", "p1", "p2")
    out = keyed.join(of_class, ["n_shingles", "p1", "p2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that have a near duplicate of smaller id, directly or by links."""
    gone = near_duplicates(docs, k, percent).where("NOT kept").select(F.col("doc_id").alias("_mh_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_mh_gone"], "left_anti")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by 4-word shingles at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


def oracle(k: int = 4, percent: int = 80) -> str:
    """DuckDB SQL of the same by counting shared shingles of all pairs that have any, of a table with unique ids that fits one machine."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {k - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 1}, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
r AS (SELECT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""
