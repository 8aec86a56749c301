"""The service: index a folder or a table, search it, clear it, ask for its status."""

from __future__ import annotations

import os
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import snippet
from tessera.operators import code_chunks, embed, lexical, sync
from tessera.plans import hybrid
from tessera.plans.snapshot import Snapshot
from tessera.runtime import materialize, ship
from tessera.settings import Settings
from tessera.sources.corpus import CorpusSource

DEFAULT_TOP_N = 10
#: Failures whose messages a status shows; all of them are counted.
SHOWN_ERRORS = 1_000


class AlreadyRunning(RuntimeError):
    """A run over this corpus is under way."""


@dataclass
class Status:
    phase: str = "idle"  # idle, walking, indexing, pruning, done
    total: int = 0
    done: int = 0
    errors: list[str] = field(default_factory=list)
    failed: int = 0


class Index:
    """One corpus: its snapshot, and one run at a time."""

    def __init__(self, spark: SparkSession, settings: Settings, root: str, embedder: embed.Embedder, max_lines: int, overlap: int) -> None:
        self.spark, self.settings, self.root, self.embedder = spark, settings, root, embedder
        self.max_lines, self.overlap = max_lines, overlap
        self.store = Snapshot(spark, settings.index_path(root))
        self.store.reconcile(embedder.model, embedder.dim)
        self._lock, self._running, self._status = threading.Lock(), False, Status()
        self._group, self._cancelled, self._cut = "", False, None

    def running(self) -> bool:
        with self._lock:
            return self._running

    def status(self) -> Status:
        with self._lock:
            s = self._status
            # While files are cut, those that tasks have finished count.
            done = min(s.total, s.done + self._cut.value) if self._cut is not None else s.done
            return Status(s.phase, s.total, done, list(s.errors), s.failed)

    def _set(self, **values) -> None:
        with self._lock:
            for k, v in values.items():
                setattr(self._status, k, v)

    def begin(self) -> None:
        with self._lock:
            if self._running:
                raise AlreadyRunning("indexing already in progress")
            self._running, self._status, self._cancelled = True, Status("walking"), False
            self._group = f"tessera-{uuid.uuid4().hex}"

    def cancel(self) -> None:
        """Stop the run's jobs; the snapshot stays as it was."""
        self._cancelled = True
        self.spark.sparkContext.cancelJobGroup(self._group)

    def run(self, documents: DataFrame | None = None, prune: bool = True) -> None:
        """Index after begin(): everything new or changed is chunked and embedded, and with ``prune`` what is not among ``documents`` goes."""
        try:
            self.spark.sparkContext.setJobGroup(self._group, f"index {self.root}", interruptOnCancel=True)
            self._index(documents if documents is not None else self._scan(), prune)
        except Exception as e:
            with self._lock:
                self._status.errors.append(str(e)[:500])
                self._status.failed += 1
            raise
        finally:
            with self._lock:
                self._running, self._cut, self._status.phase = False, None, "done"

    def _scan(self) -> DataFrame:
        if not os.path.isdir(self.root):
            raise ValueError(f"not a folder: {self.root}")
        ship(self.spark)
        self.spark.dataSource.register(CorpusSource)
        return self.spark.read.format("corpus").load(os.path.realpath(self.root))

    def _index(self, found: DataFrame, prune: bool) -> None:
        ship(self.spark)
        scan = found.withColumn("content_hash", sync.content_hash(F.col("content")))
        # Of several rows of a path, the one changed last counts, then the one of the greatest hash.
        others = [c for c in ("mod_time", "content_hash", "size", "content", "error") if c in scan.columns]
        scan = scan.groupBy("path").agg(F.max(F.struct(*others)).alias("x")).select("path", "x.*", sync.file_id(F.col("path")).alias("file_id"))
        scan = materialize(scan, "scan")
        files = self.store.read("files")
        total, unread = scan.agg(F.count("*"), F.count("error")).first()
        shown = [r.error for r in scan.where("error IS NOT NULL").select("error").limit(SHOWN_ERRORS).collect()]
        readable = scan.where("error IS NULL")
        known = files.select(F.col("path").alias("_path"), F.col("content_hash").alias("_hash"))
        todo = materialize(readable.join(known, (F.col("path") == F.col("_path")) & (F.col("content_hash") == F.col("_hash")), "left_anti"), "changed")
        self._set(phase="indexing", total=total, failed=unread, errors=shown, done=total - unread - todo.count())

        self._cut = self.spark.sparkContext.accumulator(0)
        cut = materialize(code_chunks.code_chunks(todo, "file_id", self.max_lines, self.overlap, self._cut), "chunked")
        failed = cut.where("error IS NOT NULL").select("file_id", "error")
        n_failed = failed.count()
        shown += [r.error for r in failed.limit(SHOWN_ERRORS - len(shown)).collect()]
        good = todo.join(failed.select("file_id"), "file_id", "left_anti")
        rows = lexical.tokenised(cut.where("error IS NULL").withColumn("chunk_id", F.concat_ws(":", "file_id", "ordinal")), keep=True)
        of_settings = isinstance(self.embedder, embed.HashingEmbedder) or self.settings.embed_provider != "hashing"
        new_chunks = materialize(embed.embed_chunks(rows, self.settings if of_settings and self.embedder.dim == self.settings.embed_dim else self.embedder), "embedded")
        wrong = new_chunks.where(F.size("embedding") != self.embedder.dim).count()
        if wrong:
            raise ValueError(f"{wrong} vectors don't have {self.embedder.dim} dimensions")
        self._cut = None
        self._set(done=total - unread - n_failed, failed=unread + n_failed, errors=shown, phase="pruning")
        if self._cancelled:
            raise RuntimeError("cancelled")

        replaced = good.select("file_id")
        if prune:  # a path that was read in an earlier run but can't be read now keeps what it has
            replaced = replaced.union(sync.deleted_paths(scan.select("path"), files).select(sync.file_id(F.col("path")).alias("file_id")))
        replaced = materialize(replaced, "replaced")
        fresh = good.select("file_id", "path", "mod_time", "size", "content_hash").join(sync.chunk_counts(good, new_chunks), "file_id")
        broken = todo.join(failed.select("file_id"), "file_id", "left_semi").join(files.select("path"), "path", "left_anti")
        broken = broken.select("file_id", "path", "mod_time", "size", F.lit("").alias("content_hash"), F.lit(0).alias("chunk_count"))
        new_files = materialize(fresh.unionByName(broken), "new-files")
        if replaced.isEmpty() and new_files.isEmpty():
            self.store.commit()
        else:
            self.store.commit(gone=replaced, files=new_files, chunks=new_chunks, postings=lexical.postings(new_chunks.select("chunk_id", "file_id", "terms")))


class Engine:
    """Indexes by root; the four calls return plain dicts, ``search`` a frame."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, embedder: embed.Embedder | None = None, max_lines: int = code_chunks.MAX_LINES, overlap: int = code_chunks.OVERLAP) -> None:
        self.spark, self.settings = spark, settings or Settings.from_env()
        self.embedder = embedder or embed.create(self.settings)
        self.options = (max_lines, overlap)
        self._indexes: dict[str, Index] = {}
        self._lock = threading.Lock()

    def handle(self, path: str) -> Index:
        if not path:
            raise ValueError("path is required")
        root = os.path.abspath(path)
        with self._lock:
            if root not in self._indexes:
                self._indexes[root] = Index(self.spark, self.settings, root, self.embedder, *self.options)
            return self._indexes[root]

    def index(self, path: str, background: bool = False, documents: DataFrame | None = None) -> dict:
        """Index a folder, or ``documents`` (path, content binary or text, size, mod_time, error) under the name ``path``."""
        index = self.handle(path)
        try:
            index.begin()
        except AlreadyRunning as e:
            return {"root": index.root, "started": False, "message": str(e)}
        if background:

            def run() -> None:
                try:
                    index.run(documents)
                except Exception:  # kept in the status, where the caller looks
                    return

            threading.Thread(target=run, daemon=True).start()
        else:
            index.run(documents)
        return {"root": index.root, "started": True, "message": "indexing started" if background else "indexed"}

    def search(self, path: str, query: str, top_n: int = DEFAULT_TOP_N, tuning: hybrid.Tuning = hybrid.Tuning()) -> DataFrame:
        store = self.handle(path).store
        vector = self.embedder.embed([query])[0] if query else []
        return hybrid.search(store.read("chunks"), store.read("files"), store.read("postings"), query, vector, top_n, tuning, vectors=store.vectors())

    def search_code(self, path: str, query: str, top_n: int = DEFAULT_TOP_N) -> dict:
        if not query:
            raise ValueError("query is required")
        top_n = top_n if top_n > 0 else DEFAULT_TOP_N
        hits = self.search(path, query, top_n).withColumn("snippet", snippet(F.col("content"))).collect()  # top_n rows
        results = [{"path": h.path, "start_line": h.start_line, "end_line": h.end_line, **({"symbol": h.symbol} if h.symbol else {}), "score": h.score, "snippet": h.snippet} for h in hits]
        return {"root": self.handle(path).root, "results": results}

    def clear(self, path: str, reset_model: bool = False) -> dict:
        if reset_model:
            root = os.path.abspath(path)
            Snapshot(self.spark, self.settings.index_path(root)).clear(True)
            self._indexes.pop(root, None)
            return {"root": root, "cleared": True, "message": "index cleared"}
        index = self.handle(path)
        if index.running():
            return {"root": index.root, "cleared": False, "message": "indexing is in progress"}
        index.store.clear()
        return {"root": index.root, "cleared": True, "message": "index cleared"}

    def status(self, path: str) -> dict:
        index = self.handle(path)
        s = index.status()
        return {"root": index.root, "phase": s.phase, "running": index.running(), "total": s.total, "done": s.done, **({"errors": s.errors} if s.errors else {}), **({"failed": s.failed} if s.failed > len(s.errors) else {})}

    def cancel(self, path: str) -> None:
        self.handle(path).cancel()
