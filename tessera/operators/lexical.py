"""Lexical retrieval: an inverted index with positions, phrase and prefix matches, BM25."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import phrases, tokens

LEXICAL_K, K1, B, LEAST_IDF = 50, 1.2, 0.75, 1e-6


def tokenised(chunks: DataFrame, text: str = "content", keep: bool = False) -> DataFrame:
    """chunk_id (or, with ``keep``, all columns), terms, n_tokens of every chunk, empty ones too."""
    terms = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    return chunks.select("*" if keep else "chunk_id", terms.alias("terms")).withColumn("n_tokens", F.size("terms"))


def postings(tokenised_chunks: DataFrame) -> DataFrame:
    """term, pos and the other columns but terms and n_tokens, of every token.

    The outer form: Spark would put a filter on the inner one's size below the tokeniser and run that twice.
    """
    others = [c for c in tokenised_chunks.columns if c not in ("terms", "n_tokens")]
    found = tokenised_chunks.select(*others, F.posexplode_outer("terms").alias("pos", "term")).where("term IS NOT NULL")
    return found.select("term", *others, "pos")


def term_counts(tokenised_chunks: DataFrame) -> DataFrame:
    """term, df, cf: chunks with each term, and occurrences, summed by task before they are dealt by term.

    Terms of a chunk are sorted, so that the first of equal ones counts for df, and a frequent term is one row for each task.
    """
    own = tokenised_chunks.select(F.sort_array("terms").alias("own"))
    first = F.transform("own", lambda t, i: F.struct(t.alias("term"), ((i == 0) | (F.get("own", i - 1) != t)).cast("int").alias("first")))
    found = own.select(F.explode_outer(first).alias("t")).where("t IS NOT NULL")
    return found.groupBy("t.term").agg(F.sum("t.first").alias("df"), F.count("*").alias("cf"))


def occurrences(wanted: list[list[str]]) -> Column:
    """How often each of ``wanted`` occurs in column terms, as an array."""

    def times(p: list[str]) -> Column:
        if len(p) == 1:
            return F.size(F.filter("terms", lambda t: t.startswith(p[0])))
        ends = F.transform("terms", lambda t, i: t.startswith(p[-1]) & (i >= len(p) - 1) & reduce(lambda a, b: a & b, (F.get("terms", i - len(p) + 1 + j) == w for j, w in enumerate(p[:-1]))))
        return F.size(F.filter(ends, lambda x: x))

    return F.array(*map(times, wanted)) if wanted else F.array().cast("array<int>")


def search_counted(counted: DataFrame, query: str, k: int = LEXICAL_K, digits: int | None = None) -> DataFrame:
    """What ``search`` gives, of chunks that have no postings yet: chunk_id, n_tokens and f (``occurrences`` of the query) of every chunk.

    ``counted`` should be a written table, as it is read twice: for a row of statistics, and for the scores.
    """
    weights = list(Counter(tuple(p) for p in phrases(query)).values())
    if not weights:
        return counted.select("chunk_id", F.lit(0.0).alias("score")).where("false")
    hit = lambda i: F.sum((F.get("f", F.lit(i)) > 0).cast("long"))
    ndocs, average, *nhit = counted.agg(F.count("*"), F.avg("n_tokens"), *(hit(i) for i in range(len(weights)))).first()
    score = F.lit(0.0)
    for i, (weight, n) in enumerate(zip(weights, nhit, strict=True)):
        idf = math.log((ndocs - n + 0.5) / (n + 0.5)) if n else 0.0
        f = F.get("f", F.lit(i))
        score = score + F.when(f > 0, weight * (idf if idf > 0 else LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / (average or 1.0)))).otherwise(0.0)
    best = counted.where(F.exists("f", lambda x: x > 0)).select("chunk_id", (score if digits is None else F.round(score, digits)).alias("score"))
    return best.orderBy(F.desc("score"), "chunk_id").limit(max(0, k))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """ndocs, total_tokens, avgdl in one row."""
    return lengths.agg(F.count("*").alias("ndocs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("avgdl"))


def phrase_hits(index: DataFrame, wanted: list[list[str]]) -> DataFrame:
    """phrase, chunk_id, f: occurrences of each of ``wanted`` (the last word of each is a prefix).

    Single words are one scan with prefix filters that reach sorted Parquet files; a longer
    phrase joins postings of adjacent positions.
    """
    single = [(i, p[0]) for i, p in enumerate(wanted) if len(p) == 1]
    parts = []
    if single:
        any_of = reduce(lambda a, b: a | b, (F.col("term").startswith(w) for _, w in single))
        which = F.filter(F.array(*(F.when(F.col("term").startswith(w), F.lit(i)) for i, w in single)), lambda x: x.isNotNull())
        parts.append(index.where(any_of).select("chunk_id", F.explode(which).alias("phrase")))
    for i, p in enumerate(wanted):
        if len(p) > 1:
            at = index.where(F.col("term") == p[0]).select("chunk_id", "pos")
            for d, w in enumerate(p[1:], 1):
                match = F.col("term").startswith(w) if d == len(p) - 1 else F.col("term") == w
                at = at.join(index.where(match).select("chunk_id", (F.col("pos") - d).alias("pos")), ["chunk_id", "pos"])
            parts.append(at.select("chunk_id", F.lit(i).alias("phrase")))
    return reduce(DataFrame.unionByName, parts).groupBy("phrase", "chunk_id").agg(F.count("*").alias("f"))


def bm25(index: DataFrame, lengths: DataFrame, query: str) -> DataFrame:
    """chunk_id, score of every chunk with a match; larger is better. A word that is repeated counts as often."""
    times = Counter(tuple(p) for p in phrases(query))
    if not times:
        return lengths.select("chunk_id", F.lit(0.0).alias("score")).where("false")
    wanted = [list(p) for p in times]
    hits = phrase_hits(index, wanted)
    weight = F.element_at(F.array(*(F.lit(float(n)) for n in times.values())), F.col("phrase") + 1)
    stats = F.broadcast(corpus_stats(lengths))  # one row
    found = hits.groupBy("phrase").agg(F.count("*").alias("nhit")).crossJoin(stats)
    idf = F.log((F.col("ndocs") - F.col("nhit") + 0.5) / (F.col("nhit") + 0.5))
    found = F.broadcast(found.select("phrase", "avgdl", F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf).alias("idf")))  # a row for each phrase
    scored = hits.join(found, "phrase").join(lengths.select("chunk_id", "n_tokens"), "chunk_id")
    part = weight * F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n_tokens") / F.col("avgdl")))
    return scored.groupBy("chunk_id").agg(F.sum(part).alias("score"))


def search(index: DataFrame, lengths: DataFrame, query: str, k: int = LEXICAL_K, digits: int | None = None) -> DataFrame:
    """chunk_id, score of the ``k`` best chunks, ties by id; none for a query without words or k <= 0."""
    best = bm25(index, lengths, query)
    if digits is not None:
        best = best.withColumn("score", F.round("score", digits))
    return best.orderBy(F.desc("score"), "chunk_id").limit(max(0, k))


def bm25_in_memory(rows: dict[int, list[str]], query: str) -> dict[int, float]:
    """The same over a small dict of tokens, as a check."""
    times = Counter(tuple(p) for p in phrases(query))
    average = sum(map(len, rows.values())) / max(1, len(rows))
    out: dict[int, float] = {}
    for p, n in times.items():
        f = {i: c for i, t in rows.items() if (c := sum(tuple(t[j : j + len(p) - 1]) == p[:-1] and j + len(p) <= len(t) and t[j + len(p) - 1].startswith(p[-1]) for j in range(len(t))))}
        idf = math.log((len(rows) - len(f) + 0.5) / (len(f) + 0.5)) if f else 0
        for i, c in f.items():
            out[i] = out.get(i, 0.0) + n * (idf if idf > 0 else LEAST_IDF) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(rows[i]) / average))
    return out
