"""Tables written to the shared checkpoint folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables that the innermost open temporary() block of this thread owns.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset and driver
    and executors are one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarn-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame, **options: str) -> DataFrame:
    """The same rows, written to the shared folder (with options of the writer) and read back. Inside a temporary() block the table goes at its end."""
    spark = df.sparkSession
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    if (owned := _OWNED.get()) is not None:
        owned.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def lasting() -> Iterator[None]:
    """Tables stored inside stay, whatever temporary() block is open around."""
    token = _OWNED.set(None)
    try:
        yield
    finally:
        _OWNED.reset(token)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stores inside are removed at the end; write what is to stay before it."""
    paths: list[str] = []
    token = _OWNED.set(paths)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has fewer partitions than cores (a few small
    files); large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
