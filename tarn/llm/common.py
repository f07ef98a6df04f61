"""Shared pieces of the training-data operators: scratch tables, worker state, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one Python step handles together, and of an Arrow batch between
#: executor and worker (a longer text is alone): both bound memory.
SLICE_BYTES, BATCH_BYTES = 1_000_000, 8_000_000
_HELD: dict[tuple, object] = {}


class _Blocks(threading.local):
    """Driver: paths of the tables made in each temporary() block that a thread has open."""

    def __init__(self):
        self.paths: list[list[str]] = []


_BLOCKS = _Blocks()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is set and
    driver and executors are one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarn-scratch-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def byte_count(setting: str) -> int:
    """Bytes that a setting names as Spark writes them: 1024, 64m, 1gb, 8000000b; -1 is no limit."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", setting.lower()).groups()
    return int(number) << (10 * "_kmgtp".index(unit or "_"))


def bounded_batches(df: DataFrame) -> None:
    """Keep the session's Arrow batches within BATCH_BYTES from now on; a lower setting stays.
    (Plans are lazy, so the setting must outlive the call.)"""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < byte_count(df.sparkSession.conf.get(key)) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back. Inside a
    temporary() block it goes at the end of the block (`keep`: of the block around that one)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tarn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _BLOCKS.paths[keep:]:
        _BLOCKS.paths[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession):
    """Tables that are stored() inside are removed at the end; nothing may read them later."""
    _BLOCKS.paths.append([])
    try:
        yield
    finally:
        dropped(spark, _BLOCKS.paths.pop())


def dropped(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def held(key: tuple, make: Callable[[], object]) -> object:
    """A worker's one model or cache. Workers are reused by later stages, so what an earlier
    operator held goes as soon as another one needs its own."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drop what this worker still holds for earlier operators."""
    if _HELD:
        _HELD.clear()
        tidy()


def tidy() -> None:
    """At the end of a task: give unused memory back to the system. Idle workers are kept,
    and tasks take turns with all of them."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library: it keeps what it keeps
        pass


def text_slices(batch: pa.RecordBatch, column: str = "text"):
    """Split a record batch into slices of bounded text size; a longer text is a slice of its own."""
    for part, texts in array_slices(batch.column(column)):
        yield batch.slice(part.start, part.stop - part.start), texts


def array_slices(column: pa.Array):
    """Ranges of a text column whose texts are of bounded size together, and these texts (null: empty)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(size):
        done = int(size[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(size, done + SLICE_BYTES, "right")))
        yield range(start, stop), [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def binary_array(data: bytes, ends) -> pa.Array:
    """Binary array over one buffer, cut at the byte offsets `ends` (first must be 0)."""
    offsets = np.ascontiguousarray(ends, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
