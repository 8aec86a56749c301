"""Named queries over the driver's tables, and their DuckDB SQL.

Documents play the files (path = source/doc_id, content = text), embeddings the chunk vectors.
Scores are rounded to 9 digits before ranking on both sides, so that last bits don't swap rows.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as fx
from tessera.operators import code_chunks as cc
from tessera.operators import dense, fusion, lexical, sync
from tessera.operators.line_chunks import NOT_BLANK, line_windows, merge_small
from tessera.plans.hybrid import Tuning
from tessera.runtime import materialize, ship, table
from tessera.sources.corpus import EXTENSIONS, IGNORE_DIRS, CorpusSource, selects

SPAN = 1_000_000
PROBE = 3  # vec_id of the query vector
DIM = 16
HYBRID_QUERY = "the reading tion_er"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def _old_files(spark: SparkSession, d: str) -> DataFrame:
    """An earlier state: some documents missing, some different, some that are gone now."""
    now = _files(spark, d).select("file_id", "path", "content")
    old = now.where("file_id % 10 <> 0").withColumn("content", F.when(F.col("file_id") % 7 == 0, F.concat("content", F.lit(" before"))).otherwise(F.col("content")))
    gone = now.where("file_id % 11 = 0").select("file_id", F.concat(F.lit("gone/"), "path").alias("path"), "content")
    return old.union(gone).withColumn("content_hash", sync.content_hash(F.col("content")))


_OLD = """old AS (SELECT doc_id AS file_id, source || '/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN text || ' before' ELSE text END AS content FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT doc_id, 'gone/' || source || '/' || doc_id, text FROM documents WHERE doc_id % 11 = 0),
now AS (SELECT doc_id AS file_id, source || '/' || doc_id AS path, text AS content FROM documents)"""
_CHUNKS = """l AS (SELECT doc_id, string_split(regexp_replace(text, '\\n+$', ''), chr(10)) AS l FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, l, unnest(range(0, greatest(0, len(l) - {o} - 1) + 1, {s})) AS a FROM l),
c AS (SELECT doc_id, CAST(a // {s} AS INT) AS ordinal, CAST(a + 1 AS INT) AS start_line, CAST(least(a + {n}, len(l)) AS INT) AS end_line, array_to_string(l[a + 1 : a + {n}], chr(10)) AS chunk FROM w)"""


def _chunk_sql(n: int, o: int) -> str:
    return _CHUNKS.format(n=n, o=o, s=n - o)


# Scans and predicates


@query(
    f"""WITH p AS (SELECT page_id, split_part(split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1), '#', 1) AS path, CAST(octet_length(encode(html)) AS BIGINT) AS size FROM pages)
SELECT page_id, path, size FROM p WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ({", ".join(f"'{e}'" for e in EXTENSIONS)}) AND size > 0 AND size <= 1048576
AND NOT list_bool_or(list_transform(list_slice(string_split(path, '/'), 1, -2), lambda x: x IN ({", ".join(f"'{e}'" for e in IGNORE_DIRS)}) OR starts_with(x, '.')))"""
)
def file_scan_filter(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    pages = table(spark, d, "pages").select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("size"))
    return pages.where(selects(F.col("path"), F.col("size")))


@query()
def corpus_source(spark, d):
    """The custom source over this package's own folder."""
    ship(spark)
    spark.dataSource.register(CorpusSource)
    found = spark.read.format("corpus").load(os.path.dirname(os.path.abspath(__file__)))
    return found.select("path", "size", sync.content_hash(F.col("content")).alias("content_hash"), "error")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", sync.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN repeat(' ' || chr(9) || chr(10), CAST(doc_id % 3 AS INT)) ELSE text END AS text FROM documents) WHERE regexp_matches(text, '\\S')")
def blank_filter(spark, d):
    """Every tenth document is made empty or blank, and goes."""
    text = F.when(F.col("doc_id") % 10 == 0, F.expr("repeat(' \t\n', cast(doc_id % 3 as int))")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("text")).where(F.col("text").rlike(NOT_BLANK))


@query("SELECT doc_id, substring(text, 1, 1024) AS text FROM documents")
def truncate_runes(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.truncate_runes(F.col("text"), 1024).alias("text"))


@query(
    """WITH t AS (SELECT doc_id, text, range(0, length(text) + 1) AS r FROM documents),
n AS (SELECT doc_id, text, CASE WHEN strlen(text) <= 800 THEN length(text) ELSE list_max(list_filter(range(0, 801), lambda i: strlen(substring(text, 1, CAST(i AS INT))) <= 800)) END AS k FROM t)
SELECT doc_id, CASE WHEN strlen(text) <= 800 THEN text ELSE substring(text, 1, CAST(k AS INT)) || '…' END AS snippet FROM n"""
)
def snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", fx.snippet(F.col("text")).alias("snippet"))


# Chunks


def _line_chunks(spark, d, n, o):
    return line_windows(table(spark, d, "documents").select("doc_id", "text"), "text", n, o).select("doc_id", "ordinal", "start_line", "end_line", "chunk")


@query(f"WITH {_chunk_sql(60, 10)} SELECT * FROM c WHERE regexp_matches(chunk, '\\S')")
def line_chunks(spark, d):
    return _line_chunks(spark, d, 60, 10)


@query(f"WITH {_chunk_sql(5, 2)} SELECT * FROM c WHERE regexp_matches(chunk, '\\S')")
def line_chunks_small(spark, d):
    return _line_chunks(spark, d, 5, 2)


@query(f"WITH {_chunk_sql(5, 2)} SELECT d.doc_id, CAST(count(c.doc_id) AS INT) AS chunk_count FROM documents d LEFT JOIN (SELECT * FROM c WHERE regexp_matches(chunk, '\\S')) c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def chunk_count_per_file(spark, d):
    chunks = _line_chunks(spark, d, 5, 2).withColumnRenamed("doc_id", "file_id")
    return sync.chunk_counts(_files(spark, d), chunks).withColumnRenamed("file_id", "doc_id")


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN 'P' || i ELSE '' END AS symbol, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
m AS (SELECT doc_id, i, i AS start_line, i AS end_line, symbol, line AS content, 0 AS k FROM p WHERE i = 1
UNION ALL SELECT p.doc_id, p.i, CASE WHEN g THEN m.start_line ELSE p.i END, p.i, CASE WHEN g THEN '' ELSE p.symbol END, CASE WHEN g THEN m.content || chr(10) || p.line ELSE p.line END, CASE WHEN g THEN m.k ELSE m.k + 1 END
FROM m JOIN p ON p.doc_id = m.doc_id AND p.i = m.i + 1, LATERAL (SELECT p.symbol = '' AND m.symbol = '' AND m.end_line - m.start_line + 1 < 60 AS g))
SELECT doc_id, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line, symbol, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i DESC) AS last FROM m) WHERE last = 1"""
)
def merge_trivial(spark, d):
    """A chunk for each line, every third with a name; nameless neighbours merge."""
    lines = F.split("text", "\n")
    made = F.transform(lines, lambda x, i: F.struct((i + 1).alias("start_line"), (i + 1).alias("end_line"), F.when((i + 1) % 3 == 0, F.concat(F.lit("P"), (i + 1).cast("string"))).otherwise("").alias("symbol"), x.alias("content")))
    docs = table(spark, d, "documents").select("doc_id", made.alias("chunks"))
    return docs.select("doc_id", F.explode(merge_small(F.col("chunks"))).alias("c")).select("doc_id", "c.start_line", "c.end_line", "c.symbol", "c.content")


@query(
    r"""SELECT doc_id, CAST(i AS INT) AS ordinal, CAST(3 * i + 1 AS INT) AS start_line, CAST(3 * i + 3 AS INT) AS end_line, 'f_' || i AS symbol,
  'def f_' || i || '(x):' || chr(10) || '    # ' || regexp_replace(line, '[\x00-\x1f]', '', 'g') || chr(10) || '    return x' AS content
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)"""
)
def code_chunks(spark, d):
    """Declaration chunks of a Python file made of the whole text of each document, a function for each line."""
    lines = F.split(F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]", ""), "\n")
    body = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("def f_"), i.cast("string"), F.lit("(x):\n    # "), x, F.lit("\n    return x"))), "\n")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), body.alias("content"))
    return cc.code_chunks(docs, "doc_id").select("doc_id", "ordinal", "start_line", "end_line", "symbol", "content")


@query(f"WITH {_chunk_sql(6, 3)} SELECT * FROM c WHERE regexp_matches(chunk, '\\S')")
def line_chunks_options(spark, d):
    """An overlap of more than a window becomes half of one."""
    return _line_chunks(spark, d, 6, 9)


# Sync

_STATUS = f"WITH {_OLD}, s AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'new' WHEN sha256(n.content) = sha256(o.content) THEN 'unchanged' ELSE 'changed' END AS status FROM now n FULL JOIN old o ON n.path = o.path)"


def _diff(spark, d):
    scan = _files(spark, d).withColumn("content_hash", sync.content_hash(F.col("content")))
    return sync.diff(scan, _old_files(spark, d))


@query(f"{_STATUS} SELECT path, status FROM s")
def diff_status(spark, d):
    return _diff(spark, d)


@query(f"{_STATUS} SELECT path FROM s WHERE status = 'new'")
def diff_new(spark, d):
    return _diff(spark, d).where("status = 'new'").select("path")


@query(f"{_STATUS} SELECT path FROM s WHERE status = 'changed'")
def diff_changed(spark, d):
    return _diff(spark, d).where("status = 'changed'").select("path")


@query(f"{_STATUS} SELECT path FROM s WHERE status = 'unchanged'")
def diff_unchanged(spark, d):
    scan = _files(spark, d).withColumn("content_hash", sync.content_hash(F.col("content")))
    return sync.unchanged_files(scan, _old_files(spark, d)).select("path")


@query(f"{_STATUS} SELECT path FROM s WHERE status = 'deleted'")
def diff_deleted(spark, d):
    return sync.deleted_paths(_files(spark, d), _old_files(spark, d))


@query(f"WITH {_OLD} SELECT file_id, path, content FROM old WHERE file_id % 7 <> 0 UNION ALL SELECT file_id, path, content FROM now WHERE file_id % 7 = 0")
def replace_chunks(spark, d):
    old, new = _old_files(spark, d).select("file_id", "path", "content"), _files(spark, d).where("file_id % 7 = 0")
    return sync.replace_rows(old, new.select("file_id"), new)


@query(f"WITH {_OLD} SELECT path, '' AS content_hash FROM old")
def mark_stale(spark, d):
    return sync.mark_stale(_old_files(spark, d).select("path", "content_hash"))


# Dense

_V = f"""q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = {PROBE}),
v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT -1, list_transform(q, lambda x: 0.0::DOUBLE) FROM q UNION ALL SELECT -2, [1.0, 0.0, 0.0]::DOUBLE[]),
s AS (SELECT chunk_id, CASE WHEN list_dot_product(e, e) = 0 THEN 0.0 ELSE round(list_cosine_similarity(e, q), 9) END AS score FROM v, q WHERE len(e) = len(q))"""


def _vectors(spark, d):
    """The table's vectors, a zero vector and one of another dimension."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    probe = own.where(F.col("chunk_id") == PROBE).select(F.lit(-1).cast("long").alias("chunk_id"), F.transform("embedding", lambda x: x * 0).alias("embedding"))
    odd = own.where(F.col("chunk_id") == PROBE).select(F.lit(-2).cast("long").alias("chunk_id"), F.array(*(F.lit(x).cast("float") for x in (1, 0, 0))).alias("embedding"))
    return own.union(probe).union(odd)


def _probe(spark, d) -> list[float]:
    row = table(spark, d, "embeddings").where(F.col("vec_id") == PROBE).select("embedding").first()
    return list(row[0])


@query(f"WITH {_V} SELECT chunk_id, round(score, 6) AS score FROM s")
def cosine_all(spark, d):
    q = F.array(*(F.lit(float(x)) for x in _probe(spark, d)))
    rows = _vectors(spark, d).where(F.size("embedding") == F.size(q))
    return rows.select("chunk_id", F.round(F.round(fx.cosine(F.col("embedding"), q), 9), 6).alias("score"))


@query(f"WITH {_V} SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 50")
def dense_topk(spark, d):
    return dense.top_k(_vectors(spark, d), _probe(spark, d), 50, digits=9).withColumn("score", F.round("score", 6))


@query(f"WITH {_V} SELECT chunk_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, chunk_id LIMIT 50")
def dense_topk_fast(spark, d):
    return dense.fast_top_k(_vectors(spark, d), _probe(spark, d), 50).withColumn("score", F.round(F.round("score", 9), 6))


@query(f"WITH {_V} SELECT chunk_id, score FROM s WHERE chunk_id = -1")
def dense_zero_norm(spark, d):
    return dense.top_k(_vectors(spark, d).where("chunk_id = -1"), _probe(spark, d), 50)


@query(f"WITH {_V} SELECT count(*) AS n, count(*) FILTER (chunk_id = -2) AS n_odd FROM s")
def dim_mismatch_skip(spark, d):
    best = dense.top_k(_vectors(spark, d), _probe(spark, d), 2**31 - 1)
    return best.agg(F.count("*").alias("n"), F.count(F.when(F.col("chunk_id") == -2, 1)).alias("n_odd"))


@query(
    """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM p) WHERE r <= 10"""
)
def dense_batch_topk(spark, d):
    """Ten neighbours for every hundredth vector, among all vectors."""
    return _batch(spark, d, "vec_id % 100 = 0")


@query(f"WITH {_V} SELECT chunk_id, round(score, 6) AS score FROM s WHERE chunk_id % 10 <> 0 ORDER BY s.score DESC, chunk_id LIMIT 50")
def dense_null_vectors(spark, d):
    """Every tenth vector is null, and left out."""
    own = _vectors(spark, d).withColumn("embedding", F.when(F.col("chunk_id") % 10 != 0, F.col("embedding")))
    return dense.top_k(own, _probe(spark, d), 50, digits=9).withColumn("score", F.round("score", 6))


def _batch(spark, d, asked: str) -> DataFrame:
    own = table(spark, d, "embeddings")
    queries = own.where(asked).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return dense.batch_top_k(own.select(F.col("vec_id").alias("chunk_id"), "embedding"), queries, 10, digits=9).withColumn("score", F.round("score", 6))


@query(f"WITH {_V}, t AS (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 50) SELECT chunk_id, source || '/' || doc_id AS path, text AS content, round(score, 6) AS score FROM t JOIN documents ON doc_id = chunk_id")
def hydrate(spark, d):
    """Only the text of the best chunks is read; ids without a document drop out."""
    best = dense.top_k(_vectors(spark, d), _probe(spark, d), 50, digits=9)
    files = _files(spark, d).select(F.col("file_id").alias("chunk_id"), "path", "content")
    return files.join(F.broadcast(best), "chunk_id").select("chunk_id", "path", "content", F.round("score", 6).alias("score"))


# Lexical

_TOK = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+')"


def _bm25_sql(source: str, q: str, k: int | None = 50, name: str = "x") -> str:
    """CTEs ending in ``name`` (chunk_id, score) for a query over (chunk_id, text)."""
    wanted: dict[tuple, int] = {}
    for p in fx.phrases(q):
        wanted[tuple(p)] = wanted.get(tuple(p), 0) + 1
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    counts = []
    for i, p in enumerate(wanted):
        match = " AND ".join([f"t[i + {j}] = {lit(w)}" for j, w in enumerate(p[:-1])] + [f"starts_with(t[i + {len(p) - 1}], {lit(p[-1])})"])
        counts.append(f"SELECT {i} AS phrase, chunk_id, dl, len(list_filter(range(1, len(t) - {len(p) - 2}), lambda i: {match})) AS f FROM tok")
    weights = " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(wanted.values()))
    return f"""src AS ({source}), tok AS (SELECT chunk_id, coalesce({_TOK}, []) AS t, len(coalesce({_TOK}, [])) AS dl FROM src),
st AS (SELECT count(*) AS ndocs, avg(dl) AS avgdl FROM tok), h AS (SELECT * FROM ({" UNION ALL ".join(counts)}) WHERE f > 0),
n AS (SELECT phrase, count(*) AS nhit FROM h GROUP BY phrase),
idf AS (SELECT phrase, avgdl, CASE WHEN ln((ndocs - nhit + 0.5) / (nhit + 0.5)) <= 0 THEN 1e-6 ELSE ln((ndocs - nhit + 0.5) / (nhit + 0.5)) END AS idf FROM n, st),
b AS (SELECT chunk_id, round(sum((CASE phrase {weights} END) * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM h JOIN idf USING (phrase) GROUP BY chunk_id),
{name} AS (SELECT chunk_id, score FROM b {f"ORDER BY score DESC, chunk_id LIMIT {k}" if k else ""})"""


_DOC_SOURCE = "SELECT doc_id AS chunk_id, text FROM documents"
_CONV_SOURCE = f"SELECT conv_id * {SPAN} + turn AS chunk_id, text FROM conversations"


def _bm25(chunks: DataFrame, q: str, k: int = 50) -> DataFrame:
    return _ranked(chunks, q, k).withColumn("score", F.round("score", 6))


def _ranked(chunks: DataFrame, q: str, k: int) -> DataFrame:
    """Texts are read and tokenised once; a row of counts for each chunk is written, statistics and scores come from those."""
    wanted = list(map(list, dict.fromkeys(map(tuple, fx.phrases(q)))))
    counted = lexical.tokenised(chunks, "text").select("chunk_id", "n_tokens", lexical.occurrences(wanted).alias("f"))
    return lexical.search_counted(materialize(counted, "bm25"), q, k, digits=9)


def _doc_chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _conv_chunks(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * SPAN + F.col("turn")).alias("chunk_id"), "text")


@query(f"SELECT doc_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens, array_to_string({_TOK}, ' ') AS tokens FROM documents")
def fts_tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(fx.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.array_join(fx.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT count(*) AS ndocs, CAST(sum(n) AS BIGINT) AS total_tokens, round(avg(n), 6) AS avgdl FROM (SELECT len({_TOK}) AS n FROM documents)")
def corpus_stats(spark, d):
    return lexical.corpus_stats(lexical.tokenised(_doc_chunks(spark, d), "text")).withColumn("avgdl", F.round("avgdl", 6))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    """Document and corpus frequency of every term."""
    return lexical.term_counts(lexical.tokenised(_doc_chunks(spark, d), "text"))


@query(
    f"""WITH {_bm25_sql(_DOC_SOURCE, "license", None)}, p AS (SELECT chunk_id, count(*) AS f FROM (SELECT chunk_id, unnest(t) AS w FROM tok) WHERE starts_with(w, 'license') GROUP BY chunk_id)
SELECT chunk_id, f, round(score, 6) AS score FROM p JOIN b USING (chunk_id)"""
)
def postings_search(spark, d):
    """The same scores from an inverted index of every token, as indexes keep it, and the hits themselves."""
    counted = lexical.tokenised(_doc_chunks(spark, d), "text")
    index = materialize(lexical.postings(counted).sortWithinPartitions("term", "chunk_id"), "postings")
    scores = lexical.bm25(index, counted.select("chunk_id", "n_tokens"), "license")
    hits = lexical.phrase_hits(index, [["license"]]).select("chunk_id", "f")
    return hits.join(scores, "chunk_id").select("chunk_id", "f", F.round(F.round("score", 9), 6).alias("score"))


def _bm25_query(name: str, q: str, source: str, chunks) -> None:
    def run(spark, d):
        return _bm25(chunks(spark, d), q)

    run.__name__ = name
    query(f"WITH {_bm25_sql(source, q)} SELECT chunk_id, round(score, 6) AS score FROM x")(run)


_bm25_query("bm25_single", "license", _DOC_SOURCE, _doc_chunks)
_bm25_query("bm25_or", "idiot stupid token contact", _DOC_SOURCE, _doc_chunks)
_bm25_query("bm25_prefix", "thorn", _DOC_SOURCE, _doc_chunks)
_bm25_query("bm25_phrase", "all_rights creative_comm", _DOC_SOURCE, _doc_chunks)
_bm25_query("bm25_dup_terms", "clown clown loser", _DOC_SOURCE, _doc_chunks)
_bm25_query("bm25_idf_floor", "the of", _DOC_SOURCE, _doc_chunks)
_bm25_query("bm25_accents", "Etre", _DOC_SOURCE, _doc_chunks)
_bm25_query("bm25_conversations", "the reading and", _CONV_SOURCE, _conv_chunks)

# Fusion


@query(
    f"""WITH {_V}, dn AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 50)),
{_bm25_sql(_DOC_SOURCE, "the reading")}, lx AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM x)
SELECT coalesce(dn.chunk_id, lx.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (60 + dn.r), 0) + coalesce(1.0::DOUBLE / (60 + lx.r), 0), 9) AS score FROM dn FULL JOIN lx ON dn.chunk_id = lx.chunk_id"""
)
def rrf_fuse(spark, d):
    near = dense.top_k(_vectors(spark, d), _probe(spark, d), 50, digits=9)
    return fusion.fuse(near, _ranked(_doc_chunks(spark, d), "the reading", 50)).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {_V}, dn AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM (SELECT * FROM s ORDER BY score DESC, chunk_id LIMIT 20)),
{_bm25_sql(_DOC_SOURCE, "the reading", 5)}, lx AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM x)
SELECT coalesce(dn.chunk_id, lx.chunk_id) AS chunk_id, round(coalesce(1.0::DOUBLE / (10 + dn.r), 0) + coalesce(1.0::DOUBLE / (10 + lx.r), 0), 9) AS score FROM dn FULL JOIN lx ON dn.chunk_id = lx.chunk_id"""
)
def rrf_tuned(spark, d):
    """Other numbers of candidates and another rank constant."""
    tuned = Tuning(dense_k=20, lexical_k=5, rrf_k=10.0)
    near = dense.top_k(_vectors(spark, d), _probe(spark, d), tuned.dense_k, digits=9)
    return fusion.fuse(near, _ranked(_doc_chunks(spark, d), "the reading", tuned.lexical_k), tuned.rrf_k).withColumn("score", F.round("score", 9))


@query(f"""SELECT doc_id, CAST(h AS INT) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest(list_transform({_TOK}, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM})) AS h FROM documents) GROUP BY ALL""")
def hash_embed(spark, d):
    """Nonzero buckets of each document's hashed vector."""
    v = table(spark, d, "documents").select("doc_id", fx.hash_embedding(fx.tokens(F.col("text")), DIM).alias("v"))
    return v.select("doc_id", F.posexplode("v").alias("bucket", "n")).where("n > 0").select("doc_id", "bucket", F.col("n").cast("long").alias("n"))


def hybrid(spark: SparkSession, d: str, q: str = HYBRID_QUERY, top_n: int = 10, n: int = 60, o: int = 10) -> DataFrame:
    """Line windows of documents, hashed vectors, BM25 and cosine, fused; text is joined to the best only."""
    windows = _line_chunks(spark, d, n, o).withColumn("chunk_id", F.col("doc_id") * SPAN + F.col("ordinal"))
    wanted = list(map(list, dict.fromkeys(map(tuple, fx.phrases(q)))))
    counted = lexical.tokenised(windows, "chunk")
    lean = materialize(counted.select("chunk_id", "n_tokens", lexical.occurrences(wanted).alias("f"), fx.hash_embedding(F.col("terms"), DIM).alias("embedding")), "hybrid")
    words = [w for p in fx.phrases(q) for w in p]
    vector = spark.range(1).select(fx.hash_embedding(F.array(*(F.lit(w) for w in words)), DIM)).first()[0]
    near = dense.top_k(lean.select("chunk_id", "embedding"), vector, 50, digits=9)
    best = fusion.fuse(near, lexical.search_counted(lean, q, 50, digits=9)).limit(top_n)
    ranks = Window.orderBy(F.desc("score"), "chunk_id")
    best = best.withColumn("rank", F.row_number().over(ranks))
    return windows.join(F.broadcast(best), "chunk_id").select("rank", "chunk_id", "doc_id", "start_line", "end_line", F.round("score", 9).alias("score"), fx.snippet(F.col("chunk")).alias("snippet")).orderBy("rank")


_QV = [w for p in fx.phrases(HYBRID_QUERY) for w in p]


@query(
    f"""WITH {_chunk_sql(60, 10)}, k AS (SELECT doc_id * {SPAN} + ordinal AS chunk_id, * FROM c WHERE regexp_matches(chunk, '\\S')),
{_bm25_sql("SELECT chunk_id, chunk AS text FROM k", HYBRID_QUERY)},
hv AS (SELECT chunk_id, list_transform(range(0, {DIM}), lambda i: len(list_filter(t, lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} = i))::DOUBLE) AS v FROM tok),
qv AS (SELECT list_transform(range(0, {DIM}), lambda i: len(list_filter([{", ".join(f"'{w}'" for w in _QV)}], lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % {DIM} = i))::DOUBLE) AS q),
ds AS (SELECT chunk_id, CASE WHEN list_dot_product(v, v) = 0 THEN 0.0 ELSE round(list_cosine_similarity(v, q), 9) END AS score FROM hv, qv),
dn AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM (SELECT * FROM ds ORDER BY score DESC, chunk_id LIMIT 50)),
lx AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM x),
fu AS (SELECT coalesce(dn.chunk_id, lx.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + dn.r), 0) + coalesce(1.0::DOUBLE / (60 + lx.r), 0) AS score FROM dn FULL JOIN lx ON dn.chunk_id = lx.chunk_id),
tp AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM fu)
SELECT CAST(rank AS INT) AS rank, k.chunk_id, doc_id, start_line, end_line, round(score, 9) AS score,
  CASE WHEN strlen(chunk) <= 800 THEN chunk ELSE substring(chunk, 1, CAST(list_max(list_filter(range(0, 801), lambda i: strlen(substring(chunk, 1, CAST(i AS INT))) <= 800)) AS INT)) || '…' END AS snippet
FROM tp JOIN k ON k.chunk_id = tp.chunk_id WHERE rank <= 10"""
)
def hybrid_search(spark, d):
    return hybrid(spark, d)


@query("SELECT * FROM (VALUES ('blank query', 0::BIGINT), ('no results asked for', 0::BIGINT), ('less than none asked for', 0::BIGINT), ('one asked for', 1::BIGINT)) t(what, n)")
def search_guards(spark, d):
    """Searches that must be empty, and one that must not."""
    chunks = _doc_chunks(spark, d)
    counted = lexical.tokenised(chunks, "text")
    cases = {"blank query": (" _ -", 5), "no results asked for": ("the", 0), "less than none asked for": ("the", -1), "one asked for": ("the", 1)}
    found = [lexical.search(lexical.postings(counted), counted.select("chunk_id", "n_tokens"), q, k).agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, (q, k) in cases.items()]
    return reduce(DataFrame.unionByName, found)
