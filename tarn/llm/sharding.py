"""Sharding along a Hilbert curve over document metadata.

Language, source and size are quantised to a few bits each; a cell's index on the Hilbert
curve orders the documents, and the curve is cut into runs of equal row counts (law
`rows`). Shards, and the files within them, then cover small boxes of all dimensions at
once, so readers prune files by any of them. Positions come from one range shuffle on
(curve index, text hash, id): each partition numbers its rows, and the partitions' row
counts, one number each, give the offsets. A hot language or source is many ranges, not
one task, since the text hash and id are part of the sort key.

Defined results: a null text counts as empty (size 1), null metadata is a value of its own;
equal texts with equal metadata are neighbours; repeated rows each get a slot; an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stored


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with `bits` bits in each dimension.

    Gray-code form: from the highest bit down, axes whose bit is set invert the lower bits
    of the first axis, others swap them with it; the interleaved bits are then Gray decoded.
    """
    x = [np.asarray(a, np.int64).copy() for a in axes]
    n = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, low = 1 << shift, (1 << shift) - 1
        for i in range(n):
            inverted = (x[i] & bit) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << shift), (1 << shift) - 1, 0)
    index = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for a in x:
            index = (index << 1) | (((a ^ flip) >> shift) & 1)
    return index


def curve(docs: DataFrame, *, bits: int = 5, id_col: str = "doc_id", text_col: str = "text", keys=("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, one bin for each dimension, and the curve index."""
    top = (1 << bits) - 1

    @F.pandas_udf("long")
    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    bins = {f"{k}_bin": F.pmod(F.xxhash64(F.col(k).cast("string")), F.lit(top + 1)) for k in keys}
    bins["size_bin"] = F.least(F.floor(F.log2(size.cast("double")) * 2), F.lit(top)).cast("long")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        *(c.alias(k) for k, c in bins.items()),
    )
    return rows.withColumn("hilbert", index(*bins))


def shard(docs: DataFrame, n_shards: int = 8, **kw) -> DataFrame:
    """The rows of curve() with law, shard, slot and grown_shard (null under law `rows`)."""
    key = ["hilbert", "text_hash", "doc_id", "size"]
    ordered = curve(docs, **kw).repartitionByRange(*key).sortWithinPartitions(*key)
    ordered = stored(ordered.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    spark = docs.sparkSession
    counts = sorted((r.part, r["count"]) for r in ordered.groupBy("part").count().collect())  # a number for each partition
    total = sum(n for _, n in counts)
    starts = dict(zip((p for p, _ in counts), np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    offsets = spark.createDataFrame(list(starts.items()) or [(0, 0)], "part int, start long")
    ranked = ordered.join(F.broadcast(offsets), "part")
    return (
        ranked.withColumn("rank", F.col("start") + F.col("at"))
        .withColumn("shard", F.expr(f"cast((rank * {n_shards}L) div {max(total, 1)}L as int)"))
        .withColumn("slot", F.expr(f"rank - (shard * {total}L + {n_shards - 1}L) div {n_shards}L"))
        .withColumn("law", F.lit("rows"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("part", "at", "start", "rank", "text_hash")
    )


def bounds(shards: DataFrame) -> DataFrame:
    """What a reader prunes by: each shard's range of every dimension."""
    bins = [c for c in shards.columns if c.endswith("_bin")]
    return shards.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), *(f(c).alias(f"{f.__name__}_{c}") for c in bins for f in (F.min, F.max))
    )


def digests(shards: DataFrame) -> DataFrame:
    return shards.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")
