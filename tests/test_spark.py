"""The index on Spark: search operators, incremental runs, snapshots, streaming, and the catalogue against DuckDB."""

import hashlib
import importlib.util
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.functions.text import cosine, phrases, snippet
from tessera.operators import dense, fusion, lexical
from tessera.operators.code_chunks import line_chunks
from tessera.operators.embed import Embedder
from tessera.operators.line_chunks import line_windows
from tessera.plans.engine import Engine
from tessera.plans.hybrid import Tuning
from tessera.plans.snapshot import ConcurrentCommit, ModelMismatch, Snapshot
from tessera.settings import Settings
from tessera.streaming.upsert import index_stream
from tests.test_core import tree

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>")


@pytest.mark.parametrize("top", [dense.top_k, dense.fast_top_k])
def test_dense(spark, top):
    v = vectors(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [2.0, 0.0])])
    assert [(r.chunk_id, round(r.score, 9)) for r in top(v, [1.0, 0.0]).collect()] == [(1, 1.0), (7, 1.0), (2, 0.0), (5, 0.0), (3, -1.0)]
    assert [r.chunk_id for r in top(v, [1.0, 0.0], 1).collect()] == [1] and top(v, [1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        top(v, [])
    with pytest.raises(ValueError):
        Tuning(dense_k=-1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_batch_search_of_every_hundredth_vector(spark):
    rows = sorted(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect())
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in np.flatnonzero(ids % 100 == 0):
        s = np.round(x @ x[q], 9)
        want[ids[q]] = [(ids[i], n + 1, pytest.approx(s[i], abs=1e-6)) for n, i in enumerate(np.lexsort((ids, -s))[:10])]
    got = {}
    for r in sorted(__spark_entry__.queries()["dense_batch_topk"](spark, "/root/testdata/sf0.1").collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.chunk_id, r["rank"], r.score))
    assert len(got) == 20 and got == want


def test_batch_search_in_blocks(spark):
    """Ties, zero vectors, other dimensions and nulls, with queries and vectors in several blocks."""
    rows = [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(200)] + [(300, [0.0] * 3), (301, [1.0, 0.0]), (302, None), (303, [None, 1.0, 1.0])]
    v = vectors(spark, rows)
    queries = v.where("chunk_id % 10 = 0 or chunk_id = 301").selectExpr("chunk_id AS query_id", "embedding AS query")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in dense.batch_top_k(v, queries, 7, 9, least=60, most=30).collect())
    good, want = [(i, np.array(e)) for i, e in rows if e and None not in e], []
    for i, q in ((i, e) for i, e in good if i % 10 == 0 or i == 301):
        near = sorted((-round(float(q @ e / (np.linalg.norm(q) * np.linalg.norm(e) or 1)), 9), j) for j, e in good if len(e) == len(q))[:7]
        want += [(i, n + 1, j) for n, (_, j) in enumerate(near)]
    assert got == sorted(want)


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "chunk_id long, score double") for x in ([(1, 0.9), (2, 0.5)], [(2, 7.0), (3, 3.0)])]
    want = [(2, 1 / 61 + 1 / 62), (1, 1 / 61), (3, 1 / 62)]
    assert [(r.chunk_id, r.score) for r in fusion.fuse(*lists).collect()] == [(i, pytest.approx(s, abs=1e-12)) for i, s in want]
    assert [r.chunk_id for r in fusion.fuse(*lists, k=0).collect()] == [2, 1, 3]


def test_lexical(spark):
    texts = [(1, "func ParseConfig(path string)"), (2, "parse the config, parse again"), (3, "def parse_config(x): return x"), (4, ""), (5, None), (6, "Café parse")]
    counted = lexical.tokenised(spark.createDataFrame(texts, "chunk_id long, content string"))
    rows = {r.chunk_id: list(r.terms) for r in counted.collect()}
    for q in ("parse", "parse_config", "parse parse café", "Config", "zzz"):
        got = {r.chunk_id: r.score for r in lexical.bm25(lexical.postings(counted), counted, q).collect()}
        assert got == {i: pytest.approx(s, abs=1e-9) for i, s in lexical.bm25_in_memory(rows, q).items()}, q
        f = counted.select("chunk_id", "n_tokens", lexical.occurrences([list(p) for p in dict.fromkeys(map(tuple, phrases(q)))]).alias("f"))
        assert {r.chunk_id: r.score for r in lexical.search_counted(f, q).collect()} == {i: pytest.approx(s, abs=1e-9) for i, s in got.items()}, q
    assert lexical.search(lexical.postings(counted), counted, " _ -").count() == 0
    df = {r.term: (r.df, r.cf) for r in lexical.term_counts(counted).collect()}
    assert df == {w: (sum(w in t for t in rows.values()), sum(t.count(w) for t in rows.values())) for w in {w for t in rows.values() for w in t}}
    plan = lexical.postings(counted)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1, plan


def test_windows_and_snippets(spark):
    text = "\n".join(f"é{i}" if i % 9 else "" for i in range(137)) + "\n\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n\u00a0\n"), (5, "x\r\ny")], "id long, content string")
    got = [(r.id, r.start_line, r.end_line, r.chunk) for r in line_windows(df, max_lines=20, overlap=6).orderBy("id", "ordinal").collect()]
    want = [(i, c.start_line, c.end_line, c.content) for i, t in ((1, text), (5, "x\r\ny")) for c in line_chunks(t, max_lines=20, overlap=6)]
    assert got == want
    cut = [r[0] for r in df.select(snippet(F.lit("é" * 500)), snippet(F.lit("日" * 400))).first().asDict().items()]
    assert len(cut) == 2
    row = spark.range(1).select(snippet(F.lit("a" + "é" * 500)).alias("a"), snippet(F.lit("日" * 400)).alias("b"), snippet(F.lit("short")).alias("c"), snippet(F.lit("🤖" * 300)).alias("d")).first()
    assert row.a == "a" + "é" * 399 + "…" and row.b == "日" * 266 + "…" and row.c == "short" and row.d == "🤖" * 200 + "…"
    row = spark.range(1).select(cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("x")).first()
    assert row.x == 0


class Flaky(Embedder):
    """Constant vectors, which fail for texts with the word FAIL."""

    model, dim = "flaky", 3

    def embed(self, texts):
        if any("FAIL" in t for t in texts):
            raise RuntimeError("no vector")
        return [[1.0, 0.0, 0.0] for _ in texts]


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Settings(index_dir=str(tmp_path / "index")))


def paths(engine, root):
    return sorted(r.path for r in engine.handle(root).store.read("files").collect())


def test_engine(spark, engine, tmp_path):
    root = str(tmp_path / "src")
    tree(root, {"server.go": "package main\n\nfunc Serve(addr string) error {\n\treturn nil\n}\n", "parser.py": "def parse_config(p):\n    return p\n", "a/__init__.py": "x = 1\n"})
    assert engine.search_code(root, "anything")["results"] == []
    engine.index(root)
    assert engine.status(root) == {"root": root, "phase": "done", "running": False, "total": 3, "done": 3}
    best = engine.search_code(root, "parse_config")["results"][0]
    assert (best["path"], best["symbol"], best["start_line"], best["end_line"]) == ("parser.py", "parse_config", 1, 2)
    before = {r.chunk_id for r in engine.handle(root).store.read("chunks").collect()}
    version = engine.handle(root).store.version()
    engine.index(root)
    assert {r.chunk_id for r in engine.handle(root).store.read("chunks").collect()} == before and engine.handle(root).store.version() == version + 1
    os.remove(os.path.join(root, "server.go"))
    tree(root, {"parser.py": "def other(p):\n    return p\n"})
    engine.index(root)
    assert paths(engine, root) == ["a/__init__.py", "parser.py"]
    found = engine.search_code(root, "parse_config other Serve")["results"]
    assert {r.get("symbol") for r in found} == {"other", None} and engine.search(root, "x", 0).count() == engine.search(root, "").count() == 0
    assert engine.handle(root).store.read("postings").where("term = 'serve'").count() == 0
    engine.handle(root).begin()
    assert engine.index(root)["started"] is False and engine.clear(root)["cleared"] is False
    engine.handle(root)._running = False
    assert engine.clear(root)["cleared"] and engine.search_code(root, "other")["results"] == []
    with pytest.raises(ValueError):
        engine.search_code(root, "")
    with pytest.raises(ValueError):
        engine.index(str(tmp_path / "missing"))
    assert engine.status(str(tmp_path / "missing"))["errors"]


def test_background_run(spark, engine, tmp_path):
    root = str(tmp_path / "src")
    tree(root, {f"d{i % 3}/f{i}.py": f"def f{i}():\n    return {i}\n" for i in range(30)})
    assert engine.index(root, background=True)["started"]
    assert engine.index(root, background=True)["message"] == "indexing already in progress"
    until = time.time() + 120
    while engine.status(root)["running"] and time.time() < until:
        time.sleep(0.2)
    assert engine.status(root)["phase"] == "done" and engine.status(root)["done"] == 30 and len(paths(engine, root)) == 30


def test_a_failed_run_changes_nothing(spark, tmp_path):
    engine = Engine(spark, Settings(index_dir=str(tmp_path / "index"), embed_dim=3), Flaky())
    root = str(tmp_path / "src")
    tree(root, {"a.txt": "fine\n"})
    engine.index(root)
    tree(root, {"b.txt": "FAIL\n"})
    with pytest.raises(Exception, match="no vector"):
        engine.index(root)
    assert paths(engine, root) == ["a.txt"] and engine.status(root)["errors"] and not engine.status(root)["running"]
    tree(root, {"b.txt": "works now\n"})
    engine.index(root)
    assert paths(engine, root) == ["a.txt", "b.txt"]


def test_snapshot_meta(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        s.reconcile("", 3)
    s.reconcile("m", 3, "1")
    row = [("1", "a", 0, 1, "hash", 1)]
    s.commit(files=spark.createDataFrame(row, s.read("files").schema))
    s.reconcile("m", 3, "1")
    assert s.read("files").first().content_hash == "hash"
    for model, dim in (("other", 3), ("m", 4)):
        with pytest.raises(ModelMismatch):
            s.reconcile(model, dim, "1")
    s.reconcile("m", 3, "2")
    assert s.read("files").first().content_hash == "" and s.meta()["chunker_version"] == "2"
    s.clear()
    assert s.read("files").count() == 0 and s.meta()["model"] == "m"
    s.clear(reset_model=True)
    s.reconcile("other", 4)


def test_streaming(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    put = lambda rows, mode: spark.createDataFrame(rows, "path string, content string").coalesce(1).write.mode(mode).json(source)
    put([("a.txt", "alpha"), ("b.txt", "beta")], "overwrite")
    for rows in ([], [("b.txt", "gamma"), ("c.txt", "delta")]):
        if rows:
            put(rows, "append")
        stream = spark.readStream.schema("path string, content string").json(source)
        index_stream(engine, "stream", stream, str(tmp_path / "ck")).awaitTermination()
        status = engine.status("stream")
        assert status["total"] == status["done"] == 2 and "errors" not in status
    assert paths(engine, "stream") == ["a.txt", "b.txt", "c.txt"]
    assert engine.search_code("stream", "gamma")["results"][0]["path"] == "b.txt" and "beta" not in str(engine.search_code("stream", "beta")["results"])


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_segments_merge_and_a_change_writes_little(spark, tmp_path):
    """Files replaced and removed over many commits, against a dict; bytes of a one-file commit do not grow with the index."""
    s = Snapshot(spark, str(tmp_path / "s"))
    s.reconcile("m", 1, "1")
    want, rng = {}, np.random.default_rng(1)
    cost = []
    for step in range(20):
        n = 2000 if step == 9 else 1
        changed = {f"f{int(i)}" for i in rng.integers(0, 40 if n == 1 else 4000, n)}
        removed = {f"f{int(i)}" for i in rng.integers(0, 40, 2)} - changed
        before = size_of(s.folder)
        files = spark.createDataFrame([(k, k, 0, 1, f"h{step}", 1) for k in sorted(changed)], s.read("files").schema).coalesce(1)
        postings = spark.createDataFrame([(f"t{step}", k + ":0", k, 0) for k in sorted(changed)], s.read("postings").schema).coalesce(1)
        s.commit(gone=spark.createDataFrame([(k,) for k in sorted(changed | removed)], "file_id string").coalesce(1), files=files, postings=postings)
        cost.append(size_of(s.folder) - before)
        for k in changed | removed:
            want.pop(k, None)
        want |= {k: step for k in changed}
        if step % 6 == 5 or step > 17:
            assert {r.file_id: r.content_hash for r in s.read("files").collect()} == {k: f"h{v}" for k, v in want.items()}
            assert sorted((r.chunk_id, r.term) for r in s.read("postings").collect()) == sorted((k + ":0", f"t{v}") for k, v in want.items())
    assert len(s._now()["segments"]) <= 2 + 7 and s.version() == 21
    assert cost[10] < 3 * max(cost[:4]) < cost[9]
    again = Snapshot(spark, s.folder)
    again.reconcile("m", 1, "2")
    assert {r.content_hash for r in again.read("files").collect()} == {""}
    again.commit(files=spark.createDataFrame([("new", "new", 0, 1, "h", 1)], s.read("files").schema))
    assert [r.content_hash for r in again.read("files").where("file_id = 'new'").collect()] == ["h"]


def test_two_commits_at_once(spark, tmp_path):
    s = Snapshot(spark, str(tmp_path / "s"))
    s.reconcile("m", 1, "1")
    with pytest.raises(ConcurrentCommit):
        s._publish(s._now(), s.version())
    assert s.version() == 1 and not [x for x in os.listdir(s.folder) if x.endswith(".part")]


def test_every_failure_counts(spark, engine):
    """150 files that can't be read, and two rows of one path, of which the later counts."""
    rows = [(f"bad{i}.txt", 1, 0, None, f"bad{i}.txt: no") for i in range(150)] + [(f"a{i}.txt", 5, 0, b"alpha", None) for i in range(10)] + [("a3.txt", 4, 9, b"beta", None)]
    docs = spark.createDataFrame(rows, "path string, size long, mod_time long, content binary, error string")
    engine.index("/many", documents=docs)
    status = engine.status("/many")
    assert (status["total"], status["done"], len(status["errors"])) == (160, 10, 150)
    assert {r.content for r in engine.handle("/many").store.read("chunks").collect()} == {"alpha", "beta"}
    assert engine.search_code("/many", "beta")["results"][0]["path"] == "a3.txt"


def test_progress_while_files_are_cut(spark, engine, tmp_path, monkeypatch):
    from tessera.plans import engine as module

    seen = []
    real = module.embed.embed_chunks
    monkeypatch.setattr(module.embed, "embed_chunks", lambda *a: (seen.append(engine.status(root)["done"]), real(*a))[1])
    root = str(tmp_path / "src")
    tree(root, {f"f{i}.py": f"x = {i}\n" for i in range(12)})
    engine.index(root)
    tree(root, {"f0.py": "y = 1\n", "g.py": "z = 1\n"})
    engine.index(root)
    assert seen == [12, 13] and engine.status(root)["done"] == 13


def _cases():
    from tessera.queries import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", _cases())
def test_catalogue(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    got = duck.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    row = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted((row(r) for r in df.select(columns).collect()), key=repr) == sorted(map(row, got.fetchall()), key=repr)


def test_corpus_source_reads_what_is_there(spark):
    top = os.path.join(os.path.dirname(__spark_entry__.__file__), "tessera")
    want = {}
    for d, dirs, names in os.walk(top):
        dirs[:] = [x for x in dirs if not x.startswith(".") and x != "__pycache__"]
        for f in names:
            with open(os.path.join(d, f), "rb") as x:
                if f.endswith(".py") and (content := x.read()):
                    want[os.path.relpath(os.path.join(d, f), top)] = (len(content), hashlib.sha256(content).hexdigest(), None)
    assert {r.path: (r.size, r.content_hash, r.error) for r in __spark_entry__.queries()["corpus_source"](spark, SF).collect()} == want


def test_entry_without_llm(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name in ("tessera.llm", "corpus_pipeline") else real(name, *a))
    assert "hybrid_search" in __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())
    assert "hybrid_search" in __spark_entry__.oracle_sql()
