"""Sinks of streams that may run a batch again: each batch owns one folder and writes it whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def batches_to(path: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: batch i replaces path/batch=i, so a second run of it changes nothing."""

    def write(rows: DataFrame, i: int) -> None:
        change(rows).write.mode("overwrite").parquet(f"{path}/batch={i}")

    return write


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What batches_to has written, with the number of the batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)


def run_available(rows: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", name: str | None = None) -> StreamingQuery:
    """Run a stream over all that is there, in as many batches as its source makes, and wait for its end."""
    writer = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination()
    return query
