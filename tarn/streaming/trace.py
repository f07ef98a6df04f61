"""The event trace: its tail, its events by name, and a live roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(events: DataFrame, limit: int = 200, seq: str = "event_id") -> DataFrame:
    """The last `limit` events."""
    return events.orderBy(F.desc(seq)).limit(limit)


def by_name(events: DataFrame, name: str, column: str = "event_type") -> DataFrame:
    return events.filter(F.col(column) == name)


def counts(events: DataFrame, column: str = "event_type") -> DataFrame:
    return events.groupBy(F.col(column).alias("event")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def stream(spark: SparkSession, path: str, schema, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Live counts by event and window from a folder that events are appended to."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    spans = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return spans.select(F.col("window.start").alias("start"), F.col("event_type").alias("event"), "n")
