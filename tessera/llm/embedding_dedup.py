"""Embedding near-dedup by sorted projection passes.

Vectors that are equal form a class and are compared once. Each pass hashes every class by the signs of
``BITS`` random projections of its unit vector less the mean of its label, so a dense label is cut as evenly as any;
the signs are joined into one number, and close vectors agree in long prefixes. A pass is sorted by (label, dimension,
hash, id) and each vector is compared with the ``WINDOW`` that follow it, also across the sort's partitions, so neither a
frequent label nor a dense region is held by one task. Pairs that reach the threshold are verified by their
cosine; a task passes on a forest that joins them, and the union over all passes gives components. Within each
component all pairs are compared in blocks of bounded size, which counts every link of its vectors.

A window is a bound, so links between components may lie outside all windows. An exact check follows: every two classes of
a label that are in different components meet in a pair of blocks, and those that the passes have lost are counted and
join their components. That costs the square of a label's size, so most pairs are told apart by their distance in the few orthogonal axes in
which a block spreads most, in single precision with a margin for its rounding; what is left is decided by the cosine in double precision.
Pairs of blocks are dealt in waves, so that a wave sends a vector at most ``2 * SPREAD`` times.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with
a null label or id, link with nothing, and are their own component; vectors of different dimensions
don't link; rows that share an id count as one vector, the least by label and components, and each gets its result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components, in_blocks
from tessera.runtime import materialize, ship, table

#: Passes, those made in one job, and vectors that a window reaches ahead.
PASSES, TOGETHER, WINDOW, BITS = 24, 6, 48, 62
#: Numbers (vectors times dimension) in a block, at least and at most; rows that a task compares with a block at once.
LEAST, MOST, TILE = 1 << 16, 1 << 20, 256
#: Distances between blocks that a wave of the check covers; vectors of the other block that a tile of it holds.
SPREAD, WIDTH = 3, 4096
GROUP = ["label", "dim"]


def projection_hashes(x: np.ndarray, passes: int = PASSES, seed: int = 5) -> np.ndarray:
    """(vectors, passes): concatenated signs of random projections as numbers, the first on top."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], passes * BITS))
    signs = (x @ planes > 0).reshape(len(x), passes, BITS)
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _matrix(column: pd.Series, rows: np.ndarray) -> np.ndarray:
    return np.stack(column.to_numpy()[rows]).astype(np.float64)


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows reaches by links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            break
    return root


def _is_valid() -> Column:
    """Whether a row (vec_id, label, embedding) can link; never null."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = F.exists(x, lambda v: v != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and offsets of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), offsets


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _centres(classes: DataFrame) -> DataFrame:
    """label, dim, centre: the mean of a label's unit vectors, summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.embedding_dedup import _lists, _unit

        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            numbers, offsets = _lists(b.column("embedding"))
            keys = pd.Series(list(zip(b.column("label").to_pylist(), np.diff(offsets).tolist(), strict=True)))
            for (label, dim), rows in keys.groupby(keys).indices.items():
                x = _unit(numbers[offsets[rows][:, None] + np.arange(dim)])
                own = sums.setdefault((label, dim), np.zeros(dim + 1))
                own += np.append(x.sum(axis=0), len(x))
            if len(sums) > 4096:
                yield _sums(sums)
                sums.clear()
        yield _sums(sums)

    parts = classes.select("label", "embedding").mapInArrow(run, "label string, dim int, at int, total double, n double")
    places = parts.groupBy("label", "dim", "at").agg((F.sum("total") / F.sum("n")).alias("x"))
    return places.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("centre"))


def _sums(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    dims = [k[1] for k in sums]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in sums for _ in range(k[1])], pa.string()),
            pa.array([d for d in dims for _ in range(d)], pa.int32()),
            pa.array([i for d in dims for i in range(d)], pa.int32()),
            pa.array(np.concatenate([x[:-1] for x in sums.values()]) if sums else np.zeros(0)),
            pa.array(np.concatenate([np.full(len(x) - 1, x[-1]) for x in sums.values()]) if sums else np.zeros(0)),
        ],
        ["label", "dim", "at", "total", "n"],
    )


def _hashed(classes: DataFrame) -> DataFrame:
    """``classes`` with keys, a hash for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.embedding_dedup import PASSES, _lists, _unit, projection_hashes

        for b in batches:
            (numbers, offsets), (middle, at) = _lists(b.column("embedding")), _lists(b.column("centre"))
            sizes = np.diff(offsets)
            keys = np.zeros((b.num_rows, PASSES), dtype=np.int64)
            for d in np.unique(sizes):
                rows, places = np.flatnonzero(sizes == d), np.arange(d)
                keys[rows] = projection_hashes(_unit(numbers[offsets[rows][:, None] + places]) - middle[at[rows][:, None] + places])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "dim", "n", "embedding")), pa.array(list(keys), pa.list_(pa.int64()))], ["vec_id", "label", "dim", "n", "embedding", "keys"])

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.join(_centres(classes), GROUP).select("vec_id", "label", "dim", "n", "embedding", "centre").mapInArrow(run, f"vec_id long, label string, dim int, n long, embedding {kind}, keys array<long>")


def _window_forest(ids: np.ndarray, kinds: np.ndarray, numbers: np.ndarray, offsets: np.ndarray, seen: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids a, b of a forest of the linked pairs of equal kind up to a window apart, of rows in order; pairs of the first ``seen`` rows were compared before."""
    a, b = [], []
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1), len(kinds)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi <= seen or hi - lo < 2:
            continue
        x = _unit(numbers[offsets[lo] : offsets[hi]].reshape(hi - lo, -1))
        for w in range(1, min(WINDOW, hi - lo - 1) + 1):
            hit = np.flatnonzero(np.einsum("ij,ij->i", x[:-w], x[w:]) >= threshold)
            a.append(lo + hit)
            b.append(lo + hit + w)
    root = _local_roots(len(ids), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(ids))
    joined = root != np.arange(len(ids))
    return ids[joined], ids[root[joined]]


def _pass_links(hashed: DataFrame, passes: range, threshold: float) -> DataFrame:
    """a, b: links that the windows of ``passes`` find, as a forest of each task's rows."""
    kind = hashed.schema["embedding"].dataType.simpleString()
    schema = f"a long, b long, border long, side int, seq int, pass int, label string, embedding {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.embedding_dedup import WINDOW, _lists, _window_forest

        def edge(rows: pa.Table, side: int, part: int) -> pa.RecordBatch:
            n = rows.num_rows
            columns = [rows["vec_id"], pa.nulls(n, pa.int64()), pa.array([part - side] * n, pa.int64()), pa.array([side] * n, pa.int32()), pa.array(range(n), pa.int32()), rows["pass"], rows["label"], rows["embedding"]]
            return pa.table(columns, names).combine_chunks().to_batches()[0]

        names = ["a", "b", "border", "side", "seq", "pass", "label", "embedding"]
        held = first = part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            part = batch.column("part")[0].as_py()
            seen = held.num_rows if held is not None else 0
            rows = pa.concat_tables([held, new]).combine_chunks() if seen else new
            numbers, offsets = _lists(rows["embedding"])
            kinds = pd.MultiIndex.from_arrays([rows["pass"].to_numpy(), pd.factorize(rows["label"].to_pandas())[0], np.diff(offsets)])
            a, b = _window_forest(rows["vec_id"].to_numpy(), pd.factorize(kinds)[0], numbers, offsets, seen, threshold)
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.int32()) for _ in range(3)), pa.nulls(n, pa.string()), pa.nulls(n, rows["embedding"].type)], names)
            if first is None or first.num_rows < WINDOW:
                first = pa.concat_tables([first, new]).slice(0, WINDOW) if first is not None else new.slice(0, WINDOW)
            held = rows.slice(max(0, rows.num_rows - WINDOW))
        if held is not None:
            yield edge(first, 1, part)
            yield edge(held, 0, part)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        from tessera.llm.embedding_dedup import _window_forest

        pdf = pdf.sort_values(["side", "seq"], ignore_index=True)
        sizes = pdf["embedding"].map(len).to_numpy()
        kinds = pd.MultiIndex.from_arrays([pdf["pass"], pd.factorize(pdf["label"])[0], sizes])
        numbers = np.concatenate(pdf["embedding"].to_numpy()).astype(np.float64)
        a, b = _window_forest(pdf["a"].to_numpy(), pd.factorize(kinds)[0], numbers, np.cumsum([0, *sizes]), int((pdf["side"] == 0).sum()), threshold)
        return pd.DataFrame({"a": a, "b": b})

    keys = F.array(*(F.struct(F.lit(p).alias("pass"), F.get("keys", F.lit(p)).alias("key")) for p in passes))
    rows = hashed.select("vec_id", "label", "dim", "embedding", F.explode(keys).alias("k")).select("vec_id", "label", "dim", "embedding", "k.pass", "k.key")
    order = ["pass", "label", "dim", "key", "vec_id"]
    rows = rows.repartitionByRange(int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    found = materialize(rows.select("vec_id", "pass", "label", "embedding", F.spark_partition_id().alias("part")).mapInArrow(run, schema), "vec-windows")
    borders = found.where("border IS NOT NULL").groupBy("border").applyInPandas(across, "a long, b long")
    return found.where("border IS NULL").select("a", "b").union(borders).distinct()


def _block_links(vectors: DataFrame, group: list[str], threshold: float, least: int, most: int) -> DataFrame:
    """vec_id, n_links, root: of every vector that a pair of blocks links within a group, its links there and the vector that stands for those it reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tessera.llm.embedding_dedup import TILE, _local_roots, _matrix, _unit

        ids, block, weight = pdf["vec_id"].to_numpy(), pdf["b"].to_numpy(), pdf["n"].to_numpy()
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        kinds = pdf.groupby(group, sort=False).ngroup().to_numpy()
        n, root = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))
        order = np.argsort(kinds, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1):
            x = _unit(_matrix(pdf["embedding"], at))
            q, p = np.flatnonzero(block[at] == j), np.flatnonzero(block[at] == i)
            y, own = x[q].T, np.arange(len(at))
            for lo in range(0, len(p), TILE):
                t = p[lo : lo + TILE]
                linked = x[t] @ y >= threshold
                linked &= t[:, None] != q
                n[at[t]] += linked @ weight[at[q]]
                if i != j:
                    n[at[q]] += weight[at[t]] @ linked
                a, b = np.nonzero(linked)
                own = _local_roots(len(at), np.concatenate([np.arange(len(at)), t[a]]), np.concatenate([own, q[b]])) if len(a) else own
            root[at] = at[own]
        hit = n > 0
        return pd.DataFrame({"vec_id": ids[hit], "n_links": n[hit], "root": ids[root[hit]]})

    sizes = vectors.groupBy(*group).agg(F.sum("dim").alias("size"))
    rows = materialize(vectors.join(sizes, group), "vec-sized")
    numbers = rows.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0]
    block = min(max(least, numbers // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), most)
    blocks = in_blocks(rows, F.concat_ws(":", *group), F.col("vec_id"), F.col("size"), F.col("dim").cast("long"), block)
    return blocks.groupBy("bin", "i", "j").applyInPandas(run, "vec_id long, n_links long, root long")


def _close_pairs(x: np.ndarray, p: np.ndarray, q: np.ndarray, component: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a of ``p`` and b of ``q`` (the same rows, or none of them) of all pairs of unit vectors ``x`` in different components that reach the threshold, each pair once.

    Half the squared distance of linked vectors is at most 1 - threshold, in any orthogonal axes and in some of them too.
    The axes are those in which ``p`` spreads most, as many as set its vectors eight times as far apart on average; all of them once
    too many pairs of a tile are left. Rows go in the order of the first axis, which leaves out those too far along it.
    """
    dim, far, same = x.shape[1], 1 - threshold, len(p) == len(q) and bool((p == q).all())
    middle, axes, k = x[p].mean(axis=0), np.eye(dim), dim
    if min(len(p), len(q)) > 4 * dim:
        spread, axes = np.linalg.eigh(np.cov(x[p], rowvar=False, bias=True).reshape(dim, dim))
        axes = axes[:, ::-1]
        k = min(dim, int(np.searchsorted(np.cumsum(spread[::-1]), 8 * far)) + 1)
    along = x @ axes[:, 0]
    p, q = p[np.argsort(along[p], kind="stable")], q[np.argsort(along[q], kind="stable")]
    ahead, reach = along[q], max(2 * far, 0) ** 0.5 + 1e-6

    def side(rows: np.ndarray, k: int, half: int) -> np.ndarray:
        out = np.ones((len(rows), k + 2), dtype=np.float32)
        for lo in range(0, len(rows), WIDTH):
            z = (x[rows[lo : lo + WIDTH]] - middle) @ axes[:, :k]
            out[lo : lo + WIDTH, :k] = z
            out[lo : lo + WIDTH, half] = np.einsum("ij,ij->i", z, z) / -2
        return out

    def sides(k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Factors whose products are minus half the squared distances, and the least product of a link: k + 2 terms of at most 8 together, each rounded by 2**-24."""
        return side(p, k, k), side(q, k, k + 1).T, -far - 1e-6 * (k + 8)

    left, right, least = sides(k)
    step = max(1, MOST // dim)
    for lo in range(0, len(p), TILE):
        ends = along[p[lo]] - reach, along[p[min(lo + TILE, len(p)) - 1]] + reach
        first, last = np.searchsorted(ahead, ends[0], "left"), np.searchsorted(ahead, ends[1], "right")
        for at in range(max(first, lo) if same else first, last, WIDTH):
            width = min(WIDTH, last - at)
            hit = np.flatnonzero(left[lo : lo + TILE] @ right[:, at : at + width] >= least)
            if k < dim and len(hit) > TILE * WIDTH // 64:
                k = dim
                left, right, least = sides(k)
                hit = np.flatnonzero(left[lo : lo + TILE] @ right[:, at : at + width] >= least)
            a, b = lo + hit // width, at + hit % width
            apart = component[p[a]] != component[q[b]]
            if same:
                apart &= a < b
            a, b = p[a[apart]], q[b[apart]]
            for i in range(0, len(a), step):
                c, d = a[i : i + step], b[i : i + step]
                linked = np.einsum("ij,ij->i", x[c], x[d]) >= threshold
                if linked.any():
                    yield c[linked], d[linked]


def _links_between(vectors: DataFrame, threshold: float, least: int, most: int) -> DataFrame:
    """vec_id, n_links, root: of every vector that a pair of blocks links with one of its label in another component, these links and the vector that stands for those it reaches."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from tessera.llm.embedding_dedup import GROUP, _close_pairs, _local_roots, _matrix, _unit

        ids, block, weight, component = (pdf[c].to_numpy() for c in ("vec_id", "b", "n", "component"))
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        kinds = pdf.groupby(GROUP, sort=False).ngroup().to_numpy()
        n, root = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))
        order = np.argsort(kinds, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(kinds[order])) + 1):
            p, q, own = np.flatnonzero(block[at] == i), np.flatnonzero(block[at] == j), np.arange(len(at))
            if not len(p) or not len(q):
                continue
            for a, b in _close_pairs(_unit(_matrix(pdf["embedding"], at)), p, q, component[at], threshold):
                np.add.at(n, at[a], weight[at[b]])
                np.add.at(n, at[b], weight[at[a]])
                own = _local_roots(len(at), np.concatenate([np.arange(len(at)), a]), np.concatenate([own, b]))
            root[at] = at[own]
        hit = n > 0
        return pd.DataFrame({"vec_id": ids[hit], "n_links": n[hit], "root": ids[root[hit]]})

    sizes = vectors.groupBy(*GROUP).agg(F.count("*").alias("size"), F.sum("dim").alias("numbers")).where("size > 1")
    rows = materialize(vectors.join(sizes.drop("size"), GROUP), "vec-between")
    # tasks of equal size, four for each partition where the least and the most allow it
    work = sizes.agg(F.coalesce(F.sum(F.col("numbers").cast("double") ** 2), F.lit(0.0))).first()[0]
    block = min(max(least, int((work / (4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))) ** 0.5)), most)
    blocks = F.ceil(F.col("numbers") / F.lit(block)).cast("long")
    rows = rows.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    small = F.col("blocks") == 1
    top, units = rows.agg(F.coalesce(F.max("blocks"), F.lit(1)), F.coalesce(F.sum(F.when(small, F.col("dim"))), F.lit(0))).first()
    shared = F.pmod(F.xxhash64(*GROUP), F.lit(max(1, -(-units // block)))).cast("string")
    rows = rows.withColumn("bin", F.when(small, shared).otherwise(F.concat_ws(":", F.lit("g"), *GROUP)))

    def wave(first: int) -> DataFrame:
        """Links of all pairs of blocks b and b + k, the last followed by the first, for k from ``first`` to ``first + SPREAD - 1``."""
        others = F.expr(f"array_distinct(flatten(transform(sequence({first}L, least({first + SPREAD - 1}L, blocks div 2)), k -> array(pmod(b + k, blocks), pmod(b - k, blocks)))))")
        dealt = rows.where(F.expr(f"blocks div 2 >= {first}")).withColumn("_o", F.explode(others))
        dealt = dealt.withColumns({"i": F.least("b", "_o"), "j": F.greatest("b", "_o")}).select("bin", "i", "j", "b", *GROUP, "vec_id", "n", "component", "embedding")
        return materialize(dealt.groupBy("bin", "i", "j").applyInPandas(run, "vec_id long, n_links long, root long"), "vec-missed")

    return reduce(DataFrame.union, (wave(k) for k in range(0, top // 2 + 1, SPREAD)))


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.98, sample: int = 0, least: int = LEAST, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding, label).

    ``sample`` is accepted for earlier callers and changes nothing: all vectors are compared.
    """
    ship(rows.sparkSession)
    typed = rows.where(_is_valid()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    one = typed.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    one = materialize(one.withColumn("print", F.xxhash64("label", "embedding")), "vec-valid")
    equal = one.groupBy("label", "print", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = materialize(equal.withColumn("dim", F.size("embedding")).select("vec_id", "label", "dim", "n", "embedding", "print"), "vec-classes")

    hashed = materialize(_hashed(classes), "vec-hashed")
    links = reduce(DataFrame.union, (_pass_links(hashed, range(p, min(p + TOGETHER, PASSES)), threshold) for p in range(0, PASSES, TOGETHER)))
    joined = materialize(connected_components(links), "vec-components")
    members = classes.join(joined.withColumnRenamed("node", "vec_id"), "vec_id").select("vec_id", "component", "dim", "n", "embedding")
    within = _block_links(members, ["component"], threshold, least, most).groupBy("vec_id").agg(F.sum("n_links").alias("n_links"))
    within = materialize(within, "vec-counts")

    parts = classes.drop("print").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left").withColumn("component", F.coalesce("component", "vec_id"))
    missed = _links_between(parts, threshold, least, most)
    if not missed.isEmpty():
        within = materialize(within.union(missed.select("vec_id", "n_links")).groupBy("vec_id").agg(F.sum("n_links").alias("n_links")), "vec-counts")
        more = missed.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).where("a <> b")
        joined = connected_components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").union(more).distinct())

    found = classes.join(within, "vec_id", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    found = found.select("label", "print", "embedding", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    by_id = one.join(found, ["label", "print", "embedding"]).select(F.col("vec_id").alias("_id"), "n_links", "component_id")
    keyed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), _is_valid().alias("ok"))
    out = keyed.join(by_id, F.col("ok") & (F.col("vec_id") == F.col("_id")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal labels at cosine 0.98."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), 0.98)


def oracle(threshold: float = 0.98) -> str:
    """DuckDB SQL of the same by comparing all pairs of a label, of a table with unique ids that fits one machine."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {threshold}),
r AS (SELECT a AS id, a AS other FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT id, min(other) AS component FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id"""
