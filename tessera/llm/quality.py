"""Quality classifier: an interpolated modified Kneser-Ney model of word pairs for each language.

Trained on the whole texts of trusted documents (quality 1), as a start mark, words (runs without white space, A-Z
lowered) and an end mark. Map tasks count pairs, Spark sums them, and the rest are joins and aggregations of
sharded counts: words count the different words before them, contexts give totals and back-off weights, discounts
come from counts of counts by language and order, and the pairs' probabilities join those of their second words.

The logarithm of a text's probability is a sum over its words and pairs. With p0 a language's probability of an unknown word,
p1(w) of a word, b(w) the back-off weight of a word as context, and p2(v, w) of a pair, every word adds
log p1(w) / p0 + log b(w) and every pair log p2(v, w) / (b(v) p1(w)), each nothing where the model doesn't have it, and every place
adds log p0. So the model is one table of keys and values, and one join of the documents' words and pairs with
it, shard by shard, gives each document's perplexity. Rows neither need an order of back-off nor ever meet on the driver.

Words and pairs that make up at least ``HEAVY`` of the training text, of which there can be no more than 2 / ``HEAVY``, are
looked up where documents are read, and are the only part of the model that is broadcast; they are most of a text, and its hot keys.
The documents are scored in ``WAVES`` of whole documents, one after the other, which bounds the disk that the join takes.

Every document's perplexity a word is compared with a quantile of its language, taken over trusted
documents that the model wasn't trained on. Ids' crc32 modulo 5 deals labelled documents: 0 is
held out, 1 calibrates, the rest train.

Edge cases: null, empty and blank texts have no perplexity and are kept; so are documents of a language without
trusted text or calibration; a null language is one of its own; texts are read whole; rows with null ids are
scored and never trained on; repeated rows are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shingles import mix, text_words
from tessera.runtime import materialize, release, ship, table

QUANTILE = 0.99
#: Share of the training text that a word or pair must have to be looked up where documents are read.
HEAVY = 1e-6
WAVES = 10
#: Ids of trusted documents up to this many (8 bytes each), and languages, are broadcast; more are joined by shuffle.
BROADCAST_IDS, BROADCAST_LANGS = 4_000_000, 100_000
#: Rows of words and pairs passed on at once.
PIECE = 1 << 20
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sequence(text: pa.Scalar, lang: int) -> np.ndarray:
    """Keys of a text's start, words and end in a language (a hash); empty without words."""
    raw = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8) if text.is_valid else np.zeros(0, np.uint8)
    words = text_words(raw)
    if not len(words):
        return words
    return mix(np.concatenate([[_START], words, [_END]]) ^ np.uint64(lang % 2**64))


def pair_keys(keys: np.ndarray) -> np.ndarray:
    return mix(keys[:-1] * _LEFT + keys[1:] * _RIGHT)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each batch and language, counted."""
    for b in batches:
        loose: dict[tuple, list[np.ndarray]] = {}
        for lang, of, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            keys = sequence(text, of)
            if len(keys):
                loose.setdefault(lang, []).append(np.stack([keys[:-1], keys[1:]]))
        for lang, parts in loose.items():
            left, right = np.concatenate(parts, axis=1)
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            first = np.flatnonzero(np.append(True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])))
            n = np.diff(np.append(first, len(left)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(left[first].view(np.int64)), pa.array(right[first].view(np.int64)), pa.array(n)], ["lang", "v", "w", "n"])


def _by_lang(rows: DataFrame) -> DataFrame:
    """A row for each language, to be joined with larger tables."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_LANGS else rows


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3, types, mass, total: of a language's counts c, by counts of counts."""
    of = lambda i: F.sum((F.col("c") == i).cast("double"))
    n = counts.groupBy("lang").agg(*(of(i).alias(f"n{i}") for i in range(1, 5)), F.count("*").alias("types"), F.sum("c").alias("total"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    discount = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.least(F.lit(float(i)), F.greatest(F.lit(0.05 * i), i - (i + 1) * y * F.col(f"n{i + 1}") / F.nullif(f"n{i}", F.lit(0.0))))).otherwise(0.5 * i)
    n = n.withColumns({f"d{i}": discount(i) for i in (1, 2, 3)})
    rest = F.col("types") - F.col("n1") - F.col("n2")
    mass = F.col("n1") * F.col("d1") + F.col("n2") * F.col("d2") + rest * F.col("d3")
    return materialize(n.select("lang", "d1", "d2", "d3", "types", "total", mass.alias("mass")), "kn-discounts")


def _cut() -> Column:
    return F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model (key, value, c: occurrences) of ``texts`` (lang, of: the language's hash, text), and lang, p0 for each language."""
    ship(texts.sparkSession)

    def run(batches):
        from tessera.llm.quality import _count_batches

        yield from _count_batches(batches)

    found = texts.select("lang", "of", "text").mapInArrow(run, "lang string, v long, w long, n long")
    pairs = materialize(found.groupBy("lang", "v", "w").agg(F.sum("n").alias("c")), "kn-pairs")
    words = materialize(pairs.groupBy("lang", "w").agg(F.count("*").alias("c")), "kn-words")
    of_pairs, of_words = _discounts(pairs), _discounts(words)
    # One place more than there are words stands for all unknown ones.
    base = of_words.select("lang", (F.col("mass") / F.col("total") / (F.col("types") + 1)).alias("p0"))
    base = materialize(base, "kn-base")
    known = words.join(_by_lang(of_words.join(base, "lang")), "lang").select("w", F.log((F.col("c") - _cut()) / F.col("total") + F.col("p0")).alias("log_p1"), F.log("p0").alias("log_p0"))
    known = materialize(known, "kn-p1")
    contexts = pairs.join(_by_lang(of_pairs.drop("total")), "lang").groupBy("v").agg(F.sum("c").alias("total"), F.sum(_cut()).alias("cut"))
    contexts = materialize(contexts.select("v", "total", F.log(F.col("cut") / F.col("total")).alias("log_b")), "kn-contexts")

    halves = pairs.join(_by_lang(of_pairs.select("lang", "d1", "d2", "d3")), "lang").select("v", "w", "c", _cut().alias("cut")).join(contexts, "v")
    halves = materialize(halves.select("v", "w", F.col("c").cast("int").alias("c"), ((F.col("c") - F.col("cut")) / F.col("total")).cast("float").alias("own"), F.col("log_b").cast("float").alias("log_b")), "kn-halves")
    release(pairs)
    whole = halves.join(known.select("w", "log_p1"), "w")
    gain = F.log1p(F.col("own") / F.exp(F.col("log_b") + F.col("log_p1")))  # p2 over what backing off gives
    schema = "key long, value float, c int"

    def keyed(batches):
        from tessera.llm.quality import _LEFT, _RIGHT, mix

        for b in batches:
            v, w = (b.column(c).to_numpy().view(np.uint64) for c in ("v", "w"))
            yield pa.RecordBatch.from_arrays([pa.array(mix(v * _LEFT + w * _RIGHT).view(np.int64)), b.column("value"), b.column("c")], ["key", "value", "c"])

    second = materialize(whole.select("v", "w", gain.cast("float").alias("value"), "c").mapInArrow(keyed, schema), "kn-model-2")
    release(halves)
    first = known.join(contexts, known["w"] == contexts["v"], "full")
    value = F.coalesce(F.col("log_p1") - F.col("log_p0"), F.lit(0.0)) + F.coalesce("log_b", F.lit(0.0))
    first = materialize(first.select(F.coalesce("w", "v").alias("key"), value.cast("float").alias("value"), F.coalesce("total", F.lit(0)).cast("int").alias("c")), "kn-model-1")
    return first.unionByName(second), base


class Lookup:
    """Numbers by 44-bit keys, in an open-addressing table read by whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, math.ceil(math.log2(max(1, len(keys)) * 2)))
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self._values = np.zeros(1 << bits, dtype=np.float32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            at = slot[rest]
            free = self._keys[at] == -1
            self._keys[at[free]] = keys[rest[free]]  # of several for one slot, one stays
            won = self._keys[at] == keys[rest]
            self._values[at[won]] = values[rest[won]]
            rest = rest[~won]
            slot[rest] = (slot[rest] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys were found."""
        at = self._slot(keys)
        found = self._keys[at] == keys
        out = np.where(found, self._values[at], np.float32(0))
        rest = np.flatnonzero(~found & (self._keys[at] != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & self._mask
            here = self._keys[at[rest]]
            hit = here == keys[rest]
            out[rest[hit]], found[rest[hit]] = self._values[at[rest[hit]]], True
            rest = rest[~hit & (here != -1)]
        return out, found


_tables: dict[int, tuple] = {}


def lookup_of(value: tuple[np.ndarray, np.ndarray]) -> Lookup:
    """The table of a broadcast value, made once in each worker."""
    if id(value) not in _tables:
        _tables.clear()
        _tables[id(value)] = (value, Lookup(*value))
    return _tables[id(value)][1]


def _score_batches(batches: Iterator[pa.RecordBatch], heavy: Lookup) -> Iterator[pa.RecordBatch]:
    """id, print, key, direct, n: a row for each document with words (direct: what ``heavy`` gives; n: places) and one for each other word and pair (n is 0)."""

    def flush(held: list) -> pa.RecordBatch:
        sizes = np.array([2 * len(k) - 1 for _, _, k in held])
        keys = np.concatenate([x for _, _, k in held for x in (k, pair_keys(k))]).view(np.int64)
        of = np.repeat(np.arange(len(held)), sizes)
        value, known = heavy.get(keys)
        ids, prints = (np.array([x[c] for x in held], dtype=t) for c, t in ((0, np.int64), (1, np.int32)))
        direct = np.bincount(of, weights=value, minlength=len(held))
        rest = ~known
        n = int(rest.sum())
        own = mix(ids.view(np.uint64) + _END).view(np.int64)  # spreads the documents' own rows over all shards
        columns = [np.concatenate([ids, ids[of[rest]]]), np.concatenate([prints, prints[of[rest]]]), np.concatenate([own, keys[rest]]), np.concatenate([direct, np.zeros(n)]).astype(np.float32), np.concatenate([(sizes - 1) // 2, np.zeros(n, np.int64)]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "print", "key", "direct", "n"])

    for b in batches:
        held, size = [], 0
        for i, p, of, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            keys = sequence(text, of)
            if len(keys):
                held.append((i, p, keys))
                size += 2 * len(keys)
            if size >= PIECE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)


def score(texts: DataFrame, model: DataFrame, heavy_share: float = HEAVY, waves: int = WAVES) -> DataFrame:
    """id, print, n (places), total: sums of the model's values over every document of ``texts`` (id, print, of, text)."""
    spark = texts.sparkSession
    ship(spark)
    # c of the first order adds up to the training text's places.
    places = model.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0] / 2
    heavy = model.where(F.col("c") >= F.lit(max(1.0, heavy_share * places))).select("key", "value").toArrow()  # 2 / heavy_share rows at most
    shared = spark.sparkContext.broadcast((heavy.column("key").to_numpy(), heavy.column("value").to_numpy()))

    def run(batches):
        from tessera.llm.quality import _score_batches, lookup_of

        yield from _score_batches(batches, lookup_of(shared.value))

    values = model.select("key", "value")
    parts = None
    for wave in range(waves):
        mine = texts.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave).select("id", "print", "of", "text")
        rows = mine.mapInArrow(run, "id long, print int, key long, direct float, n int")
        met = rows.join(values, "key", "left").withColumn("x", F.col("direct").cast("double") + F.when(F.col("n") == 0, F.coalesce("value", F.lit(0.0))).otherwise(0.0))
        totals = materialize(met.groupBy("id", "print").agg(F.sum("x").alias("total"), F.sum("n").alias("n")), f"kn-scores-{wave}")
        parts = totals if parts is None else parts.unionByName(totals)
    return parts


def score_quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, heavy_share: float = HEAVY, waves: int = WAVES) -> DataFrame:
    """doc_id, lang, held_out, n_bytes, perplexity, threshold, keep of every row of ``docs`` (doc_id, text, lang)."""
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    own = F.when(F.col("lang").isNull(), "?").otherwise(F.concat(F.lit("="), "lang"))
    texts = docs.select("doc_id", F.col("lang").alias("_lang"), own.alias("lang"), "text")
    texts = texts.withColumns({"of": F.xxhash64("lang"), "print": F.hash("lang", "text"), "id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("lang", "text"))})
    ids = materialize(trusted.where(fold(F.col("doc_id")) > 1), "kn-trusted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids  # else texts are dealt by id
    model, base = train(texts.join(ids, "doc_id", "left_semi"))
    totals = score(texts, model, heavy_share, waves)
    rows = texts.select("doc_id", "_lang", "lang", "id", "print", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    scored = rows.join(totals, ["id", "print"], "left").join(_by_lang(base), "lang", "left")
    scored = scored.select("doc_id", "_lang", "lang", "n_bytes", F.exp(-(F.col("total") / F.col("n") + F.log("p0"))).alias("perplexity"))
    scored = materialize(scored, "kn-scores")
    calibration = scored.join(trusted.where(fold(F.col("doc_id")) == 1), "doc_id", "left_semi")
    limits = materialize(calibration.groupBy("lang").agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")), "kn-limits")
    out = scored.join(_by_lang(limits), "lang", "left")
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", F.col("_lang").alias("lang"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "n_bytes", "perplexity", "threshold", keep.alias("keep"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and decision for every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
