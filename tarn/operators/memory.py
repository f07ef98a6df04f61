"""Three-layer memory: the working window, decaying episodes, distilled facts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Memory
from ..functions import text as T
from ..functions import vector as V
from ..sources.scratch import stored
from . import search


def remembered(turns: DataFrame) -> DataFrame:
    """Turns (session_id, seq, text, ...) whose text is not blank, stripped."""
    return turns.withColumn("text", T.strip(F.col("text"))).filter("text <> ''")


def working(turns: DataFrame, config: Memory = Memory()) -> DataFrame:
    """session_id, slot, seq, text: the last turns of each session, oldest first."""
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    kept = remembered(turns).withColumn("last", last).filter(F.col("last") <= config.working_size)
    slot = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    return kept.select("session_id", slot.alias("slot"), "seq", "text")


def strength(salience: Column, created: Column, now: Column, decay: float) -> Column:
    """Salience after forgetting; times are timestamps."""
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 3_600_000_000
    return salience * V.forgetting(hours, decay)


def recall(episodes: DataFrame, queries: DataFrame, now: Column, k: int = 5, config: Memory = Memory()) -> DataFrame:
    """query_id, episode_id, score, rk. episodes: session_id, episode_id, salience, created, v;
    queries: query_id, session_id, v. A query recalls from its own session."""
    pairs = queries.withColumnRenamed("v", "qv").join(episodes, "session_id")
    alike = 0.5 + 0.5 * F.greatest(F.lit(0.0), V.cosine(F.col("qv"), F.col("v")))
    scored = pairs.select("query_id", "episode_id", F.round(strength(F.col("salience"), F.col("created"), now, config.decay_lambda) * alike, 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "episode_id")
    return scored.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def recall_hits(recalled: DataFrame) -> DataFrame:
    """episode_id, hits: how often each was recalled."""
    return recalled.groupBy("episode_id").agg(F.count("*").alias("hits"))


def forget(episodes: DataFrame, now: Column, threshold: float = 0.05, config: Memory = Memory()) -> DataFrame:
    """The episodes still stronger than the threshold, with their strength (6 places)."""
    kept = episodes.withColumn("strength", strength(F.col("salience"), F.col("created"), now, config.decay_lambda))
    return kept.filter(F.col("strength") >= threshold).withColumn("strength", F.round("strength", 6))


def _settle(config: Memory):
    """Greedy leaders among the first rows of one session: one row of leaders (seq, unit vectors) and how many
    joined each; everything is bounded by the block."""

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by([("seq", "ascending"), ("row", "ascending")])
        m = _unit(group.column("v").combine_chunks())
        leaders, size = [], []
        for i, v in enumerate(m):
            near = np.flatnonzero(np.round(m[leaders] @ v, 9) >= config.cluster_threshold) if leaders else ()
            if len(near):
                size[near[0]] += 1
            else:
                leaders.append(i)
                size.append(1)
        one = pa.array([0, len(leaders)], pa.int32())
        seqs = pa.ListArray.from_arrays(one, group.column("row").combine_chunks().take(pa.array(leaders, pa.int64())))
        return pa.table({"session_id": group.column("session_id")[:1], "leaders": seqs, "sizes": pa.ListArray.from_arrays(one, pa.array(size, pa.int64())), "lm": pa.array([m[leaders].tobytes()], pa.binary())})

    return solve


def _unit(v: pa.Array) -> np.ndarray:
    m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _join_leaders(config: Memory):
    """row, leader: for each row of a block the first leader that it is near to, or null."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, leaders = batch.column("ids")[i].values, batch.column("leaders")[i].values
                m = np.frombuffer(batch.column("m")[i].as_buffer()).reshape(len(ids), -1)
                near = np.round(m @ np.frombuffer(batch.column("lm")[i].as_buffer()).reshape(len(leaders), -1).T, 9) >= config.cluster_threshold
                first = np.where(near.any(axis=1), near.argmax(axis=1), -1)
                yield pa.RecordBatch.from_arrays([ids, leaders.take(pa.array(first, mask=first < 0))], ["row", "leader"])

    return run


def distill(episodes: DataFrame, known: DataFrame | None = None, config: Memory = Memory(), block: int = 1000) -> DataFrame:
    """session_id, seq, text, support: leaders of clusters. episodes: session_id, seq, text, v.

    In order of seq, an episode that no leader before it is near to leads a cluster; others
    join the first such leader. Round by round the first `block` open episodes of every session settle among
    themselves (a bounded task a session); all later episodes that are near to one of these leaders
    join it, in blocks that are spread over all tasks, however many one session has; the rest stays open.
    A session takes as many rounds as its leaders fill blocks. Facts already known by text are left out."""
    spark = episodes.sparkSession
    rows = stored(episodes.select("session_id", "seq", "text", "v").withColumn("row", F.monotonically_increasing_id()))
    open_, parts = rows.select("session_id", "seq", "row", "v"), []
    joined = []
    while not open_.isEmpty():
        order = Window.partitionBy("session_id").orderBy("seq", "row")
        first = stored(open_.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= block))  # partial limits before the shuffle
        settled = stored(first.groupBy("session_id").applyInArrow(_settle(config), f"session_id {rows.schema['session_id'].dataType.simpleString()}, leaders array<long>, sizes array<long>, lm binary"))
        parts.append(settled.select(F.explode(F.arrays_zip("leaders", "sizes")).alias("l")).select(F.col("l.leaders").alias("leader"), F.col("l.sizes").alias("n")))
        later = open_.join(first.select("row"), "row", "left_anti")
        blocks = search._blocks(later.select(F.col("row").alias("id"), "v", "session_id"), search.ROW_BLOCK, "session_id")
        met = stored(blocks.join(settled.select("session_id", "leaders", "lm"), "session_id").mapInArrow(_join_leaders(config), "row long, leader long"))
        joined.append(met.filter("leader is not null").groupBy("leader").agg(F.count("*").alias("n")))
        open_ = stored(open_.join(met.filter("leader is null").select("row"), "row", "left_semi"))
    none = spark.createDataFrame([], "leader long, n long")
    size = reduce(DataFrame.unionByName, [*parts, *joined], none).groupBy("leader").agg(F.sum("n").alias("support")).filter(F.col("support") >= config.min_support)
    found = rows.join(size, F.col("row") == F.col("leader")).select("session_id", "seq", "text", "support")
    # one fact a text and session
    first = F.row_number().over(Window.partitionBy("session_id", "text").orderBy("seq"))
    found = found.withColumn("n", first).filter("n = 1").drop("n")
    return found if known is None else found.join(known.select("session_id", "text"), ["session_id", "text"], "left_anti")


def stats(turns: DataFrame, facts: DataFrame, config: Memory = Memory()) -> DataFrame:
    """session_id, working, episodic, semantic: sizes of the layers."""
    n = remembered(turns).groupBy("session_id").agg(F.count("*").alias("episodic"))
    f = facts.groupBy("session_id").agg(F.count("*").alias("semantic"))
    return n.join(f, "session_id", "left").select("session_id", F.least(F.col("episodic"), F.lit(config.working_size).cast("long")).alias("working"), "episodic", F.coalesce("semantic", F.lit(0)).alias("semantic"))
