"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import threading
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than the six ASCII white-space ones. bytes.split() separates at exactly these.
SPACES = " \t\n\r\x0b\x0c"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def scratch(spark: SparkSession) -> str:
    """A new folder below the application's own one in the shared folder that spark.checkpoint.dir names; drop_scratch() of
    wayfarer.operators.graph deletes all of the application's, once no result that reads them is needed. Where that is unset, one machine alone (a local
    master) uses its own temporary folder; a cluster can't, and raises ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "wayfarer-scratch")
    return f"{root.rstrip('/')}/wayfarer-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None
_writing = threading.Lock()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, is computed once, and outlives the executors that made it.

    The shuffle files behind it are given up as soon as it is written, so that steps don't pile them up."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    with _writing:  # the setting is the session's: threads that share it take turns
        before = spark.conf.get(_CLEANUP, None)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives memory that a task has freed back to the system, as its worker process lives on."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_KEPT: dict[str, tuple[object, int | None]] = {}


def _task() -> int | None:
    """The task that this worker process runs; None on the driver."""
    task = TaskContext.get()
    return None if task is None else task.taskAttemptId()


def kept(key: str, make: Callable[[], object]):
    """What make() returns, kept by the worker process for later tasks, until a task takes slices() that has not asked for it."""
    value = _KEPT[key][0] if key in _KEPT else make()
    _KEPT[key] = value, _task()
    return value


def _forget_others() -> None:
    """Workers are handed from stage to stage, and would hold the tables of each operator that they ever ran."""
    task = _task()
    others = [k for k, (_, last) in _KEPT.items() if task is not None and last != task]
    for k in others:
        del _KEPT[k]
    if others:
        release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> "F.Column":
    """True for the documents that no model may learn from: crc32 of the decimal id, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The whole texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def crc_ids(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def slices(batches: Iterator[pa.RecordBatch], chars: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about so many bytes of text, so that a task's memory doesn't follow the rows in a batch."""
    _forget_others()
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(column)
        rows = max(1, int(b.num_rows * min(1.0, chars / max(1, col.nbytes))))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    release()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64); wraps around."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
