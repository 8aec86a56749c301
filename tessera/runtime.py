"""Session helpers that every operator shares: shipping code, shared storage, table reads."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()  # ids of applications; a name can be added to one only once
_OWN_DIR = "/tmp/tessera-checkpoints"
#: Rows of text that Python workers and executors hold at once.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, which may be any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application, and bound the batches of this session.

    The package goes out as a zip through Spark's own file server, so executors need
    neither the repository nor a shared folder.
    """
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera"), "tessera_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(top):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run on one machine, our own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (given or _OWN_DIR).rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A written table survives lost executors, is column pruned when read, and gives
    adaptive execution true sizes. What was shuffled for it goes once it is written; its own files go
    when the application's JVM exits, or earlier by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    fs, target = file_system(spark, path)
    fs.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` made and nothing reads any more."""
    fs, target = file_system(df.sparkSession, df._tessera_path)
    fs.delete(target, True)
