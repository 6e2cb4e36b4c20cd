"""Shared helpers: the folder all executors see, bounded Arrow batches, word expressions."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows that travel to a Python worker at once; texts may be long.
BATCH_ROWS = 400
#: Whether a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI under ``spark.checkpoint.dir``; where that is unset (tests), a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _test_dir()
    return f"{base.rstrip('/')}/tracefold/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def _test_dir() -> str:
    """Only for a single local process, as in tests."""
    return "file://" + tempfile.mkdtemp(prefix="tracefold-")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends at files that outlive executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator, each written to the shared folder and deleted when it isn't needed any more.
    Shuffle files go as soon as their table is written, not when the driver next collects garbage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again; a former table of this name goes once the new one is there."""
        path = shared_dir(self.spark, f"{self.name}-{name}")
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            drop_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_path(spark: SparkSession, uri: str) -> None:
    """Delete a finished intermediate folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch holds, and let workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_resident: dict = {}


def resident(key: object, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker. Workers are reused by later stages, so only the latest operator's
    tables and caches stay: others' go when ``key`` changes, before the new ones are made."""
    if key not in _resident:
        _resident.clear()
        trim()  # also of what stages that keep nothing have left
        _resident[key] = make()
    return _resident[key]


def release() -> None:
    """For workers of operators that keep nothing: drop what an earlier stage's left, and give its memory back to the system."""
    if _resident:
        _resident.clear()
        trim()


def trim() -> None:
    """Hand freed memory back to the system: allocators keep it else, and a worker idles between stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc's alone
        libc.malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words, by the JVM's matcher; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
