"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a run of tokens; the positions that it marks are hashed, the others are
ignored, so a hash still matches where an ignored token was substituted. Hashes of all positions of
all documents join those of the benchmark, and around each hit the two token sequences are compared
on the hit's diagonal: a document is contaminated by an item if ``WINDOW`` consecutive tokens (all, for a
shorter item) agree in at least 80 % of their places. The three masks together find every
window of 20 tokens with up to 4 substitutions.

What a hit is decided by are the tokens within a window's reach of it on either side, its context. Hits are therefore
reduced to the distinct contexts of a document and those of an item before the two are joined: a text that repeats
itself has few, however often its seeds meet, and other texts have one for each hit.

DataFrame functions only. Documents are read and hashed once. Seeds of a benchmark of up to ``BLOCK_TOKENS``
tokens are broadcast, so no document token is shuffled, and a passage that a third of all
documents share costs no more than its hits; those of a larger one meet the documents' seeds in a shuffled join, whose
hot keys adaptive execution splits, and only documents with hits are read again. The result is the same. Texts and items
longer than ``SEGMENT`` tokens are cut into segments that overlap by a window.

Tokens are runs of letters and digits, lower-cased.

Edge cases: null and empty texts have no tokens; items of fewer tokens than the shortest mask (7) have no
seeds and match nothing, and those of fewer than 20 are found if a seed of theirs is intact;
rows with null ids are matched like others; repeated rows count once in the matches and are all
removed; an empty table gives an empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import materialize, table

MASKS = ("11101011", "1101111", "1011001101")
WINDOW, SEGMENT, BLOCK_TOKENS = 20, 4096, 500_000
#: Contexts of the benchmark (about 450 bytes each) up to this many are broadcast; more are joined by shuffle.
BROADCAST_CONTEXTS = 100_000
#: Tenths of a window's tokens that must agree.
TENTHS = 8
_TOKEN = r"[\p{L}\p{N}]+"


def _tokens() -> Column:
    return F.transform(F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0)), lambda w: F.xxhash64(w))


def _seed(tokens: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(MASKS.index(mask)), *(F.get(tokens, at + o) for o, on in enumerate(mask) if on == "1"))


def _seeds_of_all(mask: str) -> Column:
    """A seed for each position of column t; those that reach over its end hash fewer tokens and match nothing."""
    return F.transform("t", lambda _, i: _seed(F.col("t"), i, mask))


def _need(n: Column) -> Column:
    """Agreeing tokens that a window over an item of ``n`` tokens needs."""
    return F.ceil(F.least(F.lit(WINDOW), n) * TENTHS / F.lit(10)).cast("int")


def _starts() -> Column:
    """Where the overlapping segments of column tokens begin, from 1."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - (WINDOW - 1)), F.lit(SEGMENT - WINDOW + 1))


def _segment() -> Column:
    return F.slice("tokens", F.col("at"), F.lit(SEGMENT))


def _key() -> Column:
    """With doc_id, what tells rows apart."""
    return F.xxhash64(F.lit(1), "text", F.lit(2))


def _segments(benchmark: DataFrame) -> DataFrame:
    """item_id, tokens, need: items in overlapping segments."""
    items = benchmark.select("item_id", _tokens().alias("tokens")).where(F.size("tokens") >= min(map(len, MASKS)))
    cut = items.select("item_id", "tokens", _need(F.size("tokens")).alias("need"), F.explode(_starts()).alias("at"))
    return cut.select("item_id", "need", _segment().alias("tokens"))


def _context(tokens: Column, at: Column, span: Column, outside: int) -> Column:
    """The tokens that windows through ``span`` places from ``at`` can cover; places outside of the text hold ``outside``."""
    places = F.sequence(at - (WINDOW - 1), at + span + (WINDOW - 2))
    return F.transform(places, lambda i: F.when(i >= 0, F.coalesce(F.get(tokens, i), F.lit(outside))).otherwise(F.lit(outside)).cast("long"))


def _best_run(a: Column, b: Column) -> Column:
    """The most places in which any ``WINDOW`` consecutive ones of two contexts agree."""
    same = lambda i: F.when(i >= 0, (F.get(a, i) == F.get(b, i)).cast("int")).otherwise(0)
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        run = acc["run"] + same(i) - same(i - WINDOW)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), start, step, lambda acc: acc["best"])


def _item_seeds(segments: DataFrame) -> DataFrame:
    """item_id, need, seed, span, item_context: distinct contexts of every seed of the benchmark."""
    parts = []
    for m in MASKS:
        at = F.explode(F.sequence(F.lit(0), F.size("tokens") - len(m)))
        rows = segments.where(F.size("tokens") >= len(m)).select("item_id", "need", "tokens", at.alias("q"))
        parts.append(rows.select("item_id", "need", _seed(F.col("tokens"), F.col("q"), m).alias("seed"), F.lit(len(m)).alias("span"), _context(F.col("tokens"), F.col("q"), F.lit(len(m)), 1).alias("item_context")))
    return reduce(DataFrame.unionByName, parts).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, key (a hash of id and text), item_id, n_matched: every document and item that match."""
    segments = materialize(_segments(benchmark.select("item_id", "text")).distinct(), "benchmark-segments")
    small = segments.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0] <= block_tokens
    items = materialize(_item_seeds(segments), "benchmark-seeds")
    known = items.count()
    wanted = items.select("seed", "span").distinct()
    whole = docs.select("doc_id", _key().alias("key"), _tokens().alias("tokens"))
    rows = whole.select("doc_id", "key", "tokens", F.explode_outer(_starts()).alias("at")).select("doc_id", "key", "at", _segment().alias("t"))
    seeds = rows.select("doc_id", "key", "at", "t", F.concat(*map(_seeds_of_all, MASKS)).alias("seeds"))
    # The outer forms, as Spark would put a filter on the inner ones' sizes below, where it makes tokens and seeds again.
    seeds = seeds.select("doc_id", "key", "at", "t", F.posexplode_outer("seeds").alias("n", "seed"))
    if small:
        hits = seeds.join(F.broadcast(wanted), "seed")
    else:
        met = seeds.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("at").alias("_at"), "n", "seed").join(wanted, "seed").distinct()
        hits = rows.join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at")))
    own = hits.select("doc_id", "key", "seed", "span", _context(F.col("t"), (F.col("n") % F.size("t")).cast("int"), F.col("span"), 0).alias("context")).distinct()
    pairs = own.join(F.broadcast(items) if known <= BROADCAST_CONTEXTS else items, ["seed", "span"])
    best = pairs.select("doc_id", "key", "item_id", "need", _best_run(F.col("context"), F.col("item_context")).alias("best")).where("best >= need")
    return best.groupBy("doc_id", "key", "item_id").agg(F.max("best").cast("long").alias("n_matched"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that match any item."""
    found = find_contamination(docs, benchmark).select(F.col("doc_id").alias("_dc_id"), F.col("key").alias("_dc_key")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_dc_id"]) & (_key() == found["_dc_key"]), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that match."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"))


def contaminated_sql(docs: str = "documents") -> str:
    """DuckDB SQL for doc_id, item_id, n_matched, of a table or parenthesised query with unique ids."""
    seeds = lambda t: " UNION ALL ".join(
        f"SELECT id, {k} AS m, p, [{', '.join(f'w[p + {o + 1}]' for o, on in enumerate(m) if on == '1')}] AS k FROM (SELECT id, w, unnest(range(0, len(w) - {len(m)} + 1)) AS p FROM {t} WHERE len(w) >= {len(m)})"
        for k, m in enumerate(MASKS)
    )
    return f"""WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM {docs}),
b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM benchmark),
ds AS ({seeds('d')}), bs AS ({seeds('b')}),
hits AS (SELECT DISTINCT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS shift FROM ds JOIN bs ON ds.m = bs.m AND ds.k = bs.k),
cells AS (SELECT doc_id, item_id, shift, i, len(b.w) AS n, CASE WHEN i + shift >= 0 AND d.w[i + shift + 1] = b.w[i + 1] THEN 1 ELSE 0 END AS same
  FROM (SELECT hits.*, unnest(range(0, (SELECT len(w) FROM b WHERE b.id = hits.item_id))) AS i FROM hits) h JOIN d ON d.id = doc_id JOIN b ON b.id = item_id),
runs AS (SELECT *, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i ROWS {WINDOW - 1} PRECEDING) AS run FROM cells)
SELECT doc_id, item_id, CAST(max(run) AS BIGINT) AS n_matched FROM runs GROUP BY doc_id, item_id HAVING max(run) >= (least({WINDOW}, any_value(n)) * {TENTHS} + 9) // 10"""


ORACLE = contaminated_sql()
