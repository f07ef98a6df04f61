"""The events of a run as a table that grows, and observers that follow it.

Events are written as they come about, one folder a step of a run, so that a step that is run again
replaces its own rows. Observers are functions of a batch of events; one that fails is noted
and stops neither the others nor the stream.
"""

from __future__ import annotations

import traceback
from collections import deque
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from .sinks import run_available

#: Columns of the events; the last two name the folders.
SCHEMA = "event string, query_id string, payload string, run string, seq long"
#: A handler: the events of its name (all for "*") that a batch brings, and the number of the batch.
Handler = Callable[[DataFrame, int], None]


class EventLog:
    """Where a run writes its events. Call it with rows of event, query_id, payload (debate.run does);
    seq counts the calls, so a query's events are in order of seq."""

    def __init__(self, path: str, run: str = "0"):
        self.path, self.run, self.seq = path, run, 0

    def __call__(self, rows: DataFrame) -> None:
        own = rows.select("event", F.col("query_id").cast("string").alias("query_id"), "payload")
        own.write.mode("overwrite").parquet(f"{self.path}/run={self.run}/seq={self.seq}")
        self.seq += 1

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).option("basePath", self.path).parquet(self.path)

    def stream(self, spark: SparkSession, files_a_batch: int = 1000) -> DataFrame:
        return spark.readStream.schema(SCHEMA).option("basePath", self.path).option("maxFilesPerTrigger", files_a_batch).parquet(self.path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(at)


def observers(handlers: Mapping[str, Handler], ledger: str) -> Handler:
    """A foreachBatch function that hands a batch's events to the handlers of their names and of "*".

    ledger/handler=h/batch=i says how handler h fared with batch i; a batch that is run again after a
    loss goes only to handlers without such an entry."""

    def each(rows: DataFrame, i: int) -> None:
        spark = rows.sparkSession
        kept = rows.persist()
        for n, (name, handler) in enumerate(handlers.items()):
            entry = f"{ledger}/handler={n}/batch={i}"
            if _exists(spark, f"{entry}/_SUCCESS"):
                continue
            error = None
            try:
                handler(kept if name == "*" else kept.filter(F.col("event") == name), i)
            except Exception:  # a handler's own fault, whatever it is
                error = traceback.format_exc(limit=3)
            spark.createDataFrame([(name, error is None, error)], "name string, ok boolean, error string").coalesce(1).write.mode("overwrite").parquet(entry)
        kept.unpersist()

    return each


def observe(events: DataFrame, handlers: Mapping[str, Handler], ledger: str, checkpoint: str) -> StreamingQuery:
    """Follow a stream of events up to its present end."""
    return run_available(events, observers(handlers, ledger), checkpoint, "append")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    return spark.read.schema("name string, ok boolean, error string, handler int, batch long").option("basePath", ledger).parquet(ledger)


class Lifecycle(StreamingQueryListener):
    """The last `limit` events in the life of streaming queries: (event, id, name, batch, rows, state rows)."""

    def __init__(self, limit: int = 1000):
        self.seen: deque[tuple] = deque(maxlen=limit)

    def onQueryStarted(self, event) -> None:
        self.seen.append(("started", str(event.id), event.name, None, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.seen.append(("progress", str(p.id), p.name, p.batchId, p.numInputRows, sum(s.numRowsTotal for s in p.stateOperators)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.seen.append(("failed" if event.exception else "ended", str(event.id), None, None, None, None))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.seen), "event string, id string, name string, batch long, rows long, state_rows long")
