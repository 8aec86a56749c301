"""The pipeline against plain versions of its stages."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, line_dedup, toxicity
from tests.llm.test_operators import components, plain_contamination, shingles, toxic_rows, words


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    rows, labels = toxic_rows(rng, 240)
    items = [(j, " ".join(words(rng, 30))) for j in range(3)]
    rows = [(i, t, "en", f"s{i % 12}", len(t)) for i, t in rows]
    common = "This line is the same on many different sites."
    for i in range(1000, 1060):
        text = " ".join(words(rng, 40)) + (f"\n{common}" if i % 2 else "")
        rows.append((i, text, "en", f"s{i % 12}", len(text)))
    rows += [(2000 + i, rows[240 + i][1].split("\n")[0], "en", "s1", 0) for i in range(0, 20, 2)]
    rows += [(3000 + j, "before " + t + " after", "en", "s2", 0) for j, t in items]
    rows += [(4000, None, None, None, None), (4001, "", "en", "s3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_run(spark, tables):
    from tokenizers import Tokenizer

    d, rows, items = tables
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score_toxicity(docs, labels).where("predicted = 1").collect()}
    assert toxic and all(i < 240 and i % 4 == 0 for i in toxic)
    left = {r[0]: r for r in rows if r[0] not in toxic}

    sites, first = defaultdict(set), {}
    for i, r in sorted(left.items()):
        for line in (r[1] or "").split("\n"):
            if len(line.strip(" ")) >= line_dedup.MIN_CHARS:
                sites[line.strip(" ")].add(r[3])
                first.setdefault(line.strip(" "), i)
    bad = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    assert len(bad) == 1
    texts = {i: r[1] if r[1] is None else "\n".join(x for x in r[1].split("\n") if x.strip(" ") not in bad or first[x.strip(" ")] == i) for i, r in left.items()}

    sets = {i: shingles(t, 5) for i, t in texts.items()}
    links = [(a, b) for a, p in sets.items() for b, q in sets.items() if a < b and p and q and 100 * len(p & q) >= 80 * len(p | q)]
    root = components(sets, links)
    assert len(links) >= 10
    texts = {i: t for i, t in texts.items() if root[i] == i}
    leaked = {i for i, _ in plain_contamination(list(texts.items()), items)}
    assert len(leaked) == 3
    texts = {i: t for i, t in texts.items() if i not in leaked}

    assert set(got) == set(texts)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    for i, t in texts.items():
        assert got[i].ids == library.encode(t or "", add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids)


def test_stages_return_the_columns_of_documents(spark, tables):
    d, _, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).dtypes == docs.dtypes
        clashing = docs.withColumns({c: F.lit(7) for c in ("n_lines", "n_removed", "key", "size", "bucket", "component", "tokens", "score", "part", "seed", "n")})
        left = stage(spark, clashing, d)
        assert left.dtypes == clashing.dtypes and {tuple(r) for r in left.select(*clashing.columns[len(docs.columns) :]).distinct().collect()} == {(7,) * 11}
        assert stage(spark, docs.where("false"), d).count() == 0
    lines = {r.doc_id: r for r in corpus_pipeline.STAGES[1][1](spark, docs, d).collect()}
    changed = [r for r in lines.values() if r.text is not None and r.doc_id in range(1003, 1060, 2)]
    assert changed and all(r.n_chars == len(r.text) and not re.search("many different sites", r.text) for r in changed)
    assert np.unique([r.doc_id for r in lines.values()]).size == docs.count()


def test_repeated_rows_and_long_texts(spark, tables, tmp_path):
    """Rows that share an id stay or go together, and very long texts pass whole."""
    d, rows, items = tables
    long = " ".join(f"v{i}" for i in range(60_000))
    more = [rows[1], rows[1], (9000, long, "en", "s1", len(long)), (9001, "x " + long, "en", "s2", 0), (9001, "x " + long, "en", "s2", 0), (None, None, None, None, None), (9002, " ".join([long, items[0][1]]), None, None, None)]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
    left = [(r.doc_id, len(r.text or "")) for r in docs.where("doc_id >= 9000 OR doc_id IS NULL OR doc_id = 1").collect()]
    assert sorted(left, key=repr) == sorted([(1, len(rows[1][1]))] * 3 + [(9000, len(long)), (None, 0)], key=repr)
    encoded = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()}
    assert encoded[9000] > 100_000 and encoded[None] == 0
