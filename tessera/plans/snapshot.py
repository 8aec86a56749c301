"""The stored index: immutable Parquet segments, and numbered manifests that say which of them make a version.

A commit writes one segment with the new rows of files, chunks and postings and the ids of the files that they
replace or that are gone; rows of those files in earlier segments no longer count. So what a commit writes is as large as the
change, whatever the index holds. ``FANOUT`` last segments of one level are merged into one of the next, which writes each row
a logarithmic number of times and leaves a logarithmic number of segments to read.

A version is the manifest with the highest number, which appears by renaming a whole file to a name that didn't exist. A reader
that has read a manifest sees one version throughout, a failed run changes nothing, and of two commits at once the second fails.
All files are reached by Hadoop's file systems, so an index may live where Spark's tables do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema
from tessera.operators.code_chunks import CHUNKER_VERSION
from tessera.runtime import file_system

SCHEMA_VERSION = "2"
TABLES = {"files": schema.FILES, "chunks": schema.CHUNKS, "postings": schema.POSTINGS}
KEEP_VERSIONS, FANOUT = 2, 8
_EMPTY: dict = {"meta": {}, "segments": [], "stale": -1}


class ModelMismatch(ValueError):
    """The index was built with another model or dimension."""


class ConcurrentCommit(RuntimeError):
    """Another commit has made the version that this one was to make."""


class Snapshot:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs, self._top = file_system(spark, self.folder)
        self._fs.mkdirs(self._top)
        self._vectors: tuple[int, DataFrame] | None = None

    # Manifests

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts) if parts else self._top
        return [x.getPath().getName() for x in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _versions(self) -> list[int]:
        return sorted(int(x[9:-5]) for x in self._names() if x.startswith("manifest-") and x.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"manifest-{version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _now(self) -> dict:
        versions = self._versions()
        return self._manifest(versions[-1]) if versions else json.loads(json.dumps(_EMPTY))

    def _publish(self, manifest: dict, version: int) -> int:
        part = self._path(f".{uuid.uuid4().hex}.part")
        out = self._fs.create(part)
        out.write(json.dumps(manifest, indent=1).encode())
        out.close()
        target = self._path(f"manifest-{version:012d}.json")
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise ConcurrentCommit(f"version {version} exists")
        self._forget()
        return version

    def _forget(self) -> None:
        """Delete manifests before the last KEEP_VERSIONS, and older segments that none of those names."""
        versions = self._versions()
        for v in versions[:-KEEP_VERSIONS]:
            self._fs.delete(self._path(f"manifest-{v:012d}.json"), False)
        kept = [s["id"] for v in versions[-KEEP_VERSIONS:] for s in self._manifest(v)["segments"]]
        newest = max(kept, default=-1)
        for name in (*TABLES, "gone"):
            for x in self._names(name):
                if x.startswith("seg=") and int(x[4:]) not in kept and int(x[4:]) < newest:
                    self._fs.delete(self._path(name, x), True)

    def version(self) -> int:
        return max(self._versions(), default=0)

    def meta(self) -> dict[str, str]:
        return self._now()["meta"]

    def reconcile(self, model: str, dim: int, chunker_version: str = CHUNKER_VERSION) -> None:
        """Check what the index was built with; another chunker makes all files stale, which writes a manifest and no rows."""
        if not model or dim <= 0 or not chunker_version:
            raise ValueError("model, a positive dimension and a chunker version are required")
        now = self._now()
        meta = now["meta"]
        if not meta:
            now["meta"] = {"schema_version": SCHEMA_VERSION, "model": model, "dim": str(dim), "chunker_version": chunker_version}
            self._publish(now, self.version() + 1)
            return
        if meta.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"index schema is {meta.get('schema_version')}, not {SCHEMA_VERSION}")
        if meta.get("model") != model or meta.get("dim") != str(dim):
            raise ModelMismatch(f"index has {meta.get('model')} of {meta.get('dim')} dimensions, not {model} of {dim}")
        if meta.get("chunker_version") != chunker_version:
            meta["chunker_version"] = chunker_version
            now["stale"] = max([now["stale"], *(s["id"] for s in now["segments"])])
            self._publish(now, self.version() + 1)

    # Rows

    def _rows(self, name: str, kind: T.StructType, segments: list[dict]) -> DataFrame:
        """Rows of a table's segments with the number of theirs, seg."""
        full = T.StructType([*kind, T.StructField("seg", T.IntegerType())])
        paths = [f"{self.folder}/{name}/seg={s['id']}" for s in segments if name in s["tables"]]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def _live(self, name: str, segments: list[dict], stale: int) -> DataFrame:
        rows = self._rows(name, TABLES[name], segments)
        if any("gone" in s["tables"] for s in segments[1:]):
            gone = self._rows("gone", schema.GONE, segments[1:]).groupBy(F.col("file_id").alias("_gone")).agg(F.max("seg").alias("_since"))
            rows = rows.join(gone, F.col("file_id") == F.col("_gone"), "left").where(F.col("_since").isNull() | (F.col("seg") >= F.col("_since")))
        if name == "files" and stale >= 0:
            rows = rows.withColumn("content_hash", F.when(F.col("seg") <= stale, F.lit("")).otherwise(F.col("content_hash")))
        return rows.select(TABLES[name].fieldNames())

    def read(self, name: str) -> DataFrame:
        now = self._now()
        return self._live(name, now["segments"], now["stale"])

    def vectors(self) -> DataFrame:
        """chunk_id, embedding of the current version, kept in executors' memory and disk until there is another."""
        version = self.version()
        if self._vectors is None or self._vectors[0] != version:
            if self._vectors is not None:
                self._vectors[1].unpersist()
            self._vectors = (version, self.read("chunks").select("chunk_id", "embedding").persist())
        return self._vectors[1]

    def _write(self, segment: int, tables: dict[str, DataFrame]) -> list[str]:
        for name, df in tables.items():
            kind = TABLES.get(name, schema.GONE)
            df = df.select(*(F.col(f.name).cast(f.dataType) for f in kind))
            # Postings in order of terms: a prefix filter skips row groups.
            df = df.sortWithinPartitions("term", "chunk_id") if name == "postings" else df
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}/seg={segment}")
        return list(tables)

    def commit(self, gone: DataFrame | None = None, **tables: DataFrame) -> int:
        """A version with the rows of ``tables`` more, and without earlier rows of the files in ``gone`` (file_id)."""
        now, version = self._now(), self.version() + 1
        segment = 1 + max([-1, *(int(x[4:]) for name in (*TABLES, "gone") for x in self._names(name) if x.startswith("seg="))])
        given = tables if gone is None else {**tables, "gone": gone.select("file_id").distinct()}
        segments = now["segments"]
        if given:
            segments.append({"id": segment, "level": 0, "tables": self._write(segment, given)})
        while len(segments) >= FANOUT and len({s["level"] for s in segments[-FANOUT:]}) == 1:
            segment += 1
            last, before = segments[-FANOUT:], segments[:-FANOUT]
            merged = {name: self._live(name, last, now["stale"]) for name in TABLES}
            if before:
                merged["gone"] = self._rows("gone", schema.GONE, last).select("file_id").distinct()
            segments = [*before, {"id": segment, "level": last[0]["level"] + 1, "tables": self._write(segment, merged)}]
        return self._publish({**now, "segments": segments}, version)

    def clear(self, reset_model: bool = False) -> None:
        """An empty version; meta stays, unless another model is to be used."""
        self._publish({**json.loads(json.dumps(_EMPTY)), "meta": {} if reset_model else self.meta()}, self.version() + 1)
