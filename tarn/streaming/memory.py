"""Memory as state of a stream: the working window of each session, and episodes that are forgotten.

Both keep their state in RocksDB under the query's checkpoint, so that a restart goes on where the
last batch ended. Before the shuffle every task trims what it holds of a session to what can
still count, so a hot session sends a bounded number of rows a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import Memory
from ..operators import memory

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """The state store that list and map states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class _LastTurns(StatefulProcessor):
    """The last turns of a session, as a list state of at most `size` rows."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "seq long, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(list(self.turns.get()), columns=["seq", "text"])
        for more in rows:
            kept = pd.concat([kept, more[["seq", "text"]]]).sort_values("seq", kind="stable").tail(self.size)
        self.turns.put([(int(s), t) for s, t in kept.itertuples(index=False)])
        yield pd.DataFrame({"session_id": key[0], "slot": range(1, len(kept) + 1), "seq": kept["seq"].astype("int64"), "text": kept["text"]})

    def close(self) -> None:
        pass


def working_window(turns: DataFrame, config: Memory = Memory()) -> DataFrame:
    """From a stream of session_id, seq, text: session_id, slot, seq, text, the whole window of each
    session that a batch has touched (update mode). Turns may come late; they are placed by seq."""
    size = config.working_size

    def trim(batches):
        for rows in batches:
            yield rows.sort_values("seq", kind="stable").groupby("session_id", sort=False).tail(size)

    own = memory.remembered(turns).select("session_id", "seq", "text")
    return own.mapInPandas(trim, own.schema).groupBy("session_id").transformWithStateInPandas(
        _LastTurns(size), "session_id long, slot int, seq long, text string", "Update", "None"
    )


class _Episodes(StatefulProcessor):
    """Episodes by the hour in which they become too weak; a timer drops the hour as a whole."""

    def __init__(self, hour_ms: int):
        self.hour_ms = hour_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episodes = handle.getMapState("episodes", "due long", "ids array<long>, salience array<double>, created_us array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, count = timerValues.getCurrentWatermarkInMs(), 0
        for more in rows:
            more = more[more["weak_ms"] > watermark]
            due = -(-more["weak_ms"] // self.hour_ms) * self.hour_ms
            for at, part in more.groupby(due):
                at = int(at)
                new = [part[c].tolist() for c in ("episode_id", "salience", "created_us")]
                if self.episodes.containsKey((at,)):
                    new = [[*old, *more] for old, more in zip(self.episodes.getValue((at,)), new, strict=True)]
                else:
                    self.handle.registerTimer(at)
                self.episodes.updateValue((at,), tuple(new))
                count += len(part)
        yield pd.DataFrame({"session_id": [key[0]], "event": ["remembered"], "n": [count], "due_ms": [watermark]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        gone = len(self.episodes.getValue((at,))[0]) if self.episodes.containsKey((at,)) else 0
        self.episodes.removeKey((at,))
        yield pd.DataFrame({"session_id": [key[0]], "event": ["forgotten"], "n": [gone], "due_ms": [at]})

    def close(self) -> None:
        pass


def forgetting(episodes: DataFrame, threshold: float = 0.05, config: Memory = Memory(), late: str = "0 seconds", hour_ms: int = 3_600_000) -> DataFrame:
    """From a stream of session_id, episode_id, salience, created: session_id, event, n, due_ms, one
    row for what a session remembers in a batch and for each hour of episodes that it forgets.

    An episode weakens below the threshold at a time that is known when it comes. The event-time
    timer of its hour takes it out of the state once the watermark has passed; an episode that
    is weak by then never enters."""
    weak_h = F.log(F.greatest(F.col("salience"), F.lit(1e-300)) / threshold) / config.decay_lambda
    weak_ms = F.floor(F.unix_micros("created") / 1000 + weak_h * 3_600_000).cast("long") + 1
    own = episodes.withWatermark("created", late).select("session_id", "episode_id", "salience", "created", F.unix_micros("created").alias("created_us"), weak_ms.alias("weak_ms"))
    return own.filter("weak_ms > created_us div 1000").groupBy("session_id").transformWithStateInPandas(
        _Episodes(hour_ms), "session_id long, event string, n long, due_ms long", "Update", "EventTime"
    )


def remembered_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """session_id, due_ms, episode_id, salience, created: the episodes in the state of a stopped or running query."""
    state = spark.read.format("statestore").option("stateVarName", "episodes").load(checkpoint)
    value = F.arrays_zip(*(F.col(f"user_map_value.{c}").alias(c) for c in ("ids", "salience", "created_us")))
    rows = state.select(F.col("key.session_id").alias("session_id"), F.col("user_map_key.due").alias("due_ms"), F.explode(value).alias("r"))
    return rows.select("session_id", "due_ms", F.col("r.ids").alias("episode_id"), "r.salience", F.timestamp_micros("r.created_us").alias("created"))


def latest(snapshots: DataFrame, key: str = "session_id", batch: str = "batch") -> DataFrame:
    """The rows of each key's last batch."""
    last = F.max(batch).over(Window.partitionBy(key))
    return snapshots.withColumn("__last", last).filter(F.col(batch) == F.col("__last")).drop("__last")


def lifetime_hours(salience: float, threshold: float = 0.05, config: Memory = Memory()) -> float:
    """Hours until an episode of that salience is too weak."""
    return max(0.0, math.log(max(salience, 1e-300) / threshold) / config.decay_lambda)
