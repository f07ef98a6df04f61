"""Exact cosine top-k that skips pairs of blocks by the triangle inequality of angles.

Vectors are dealt to the nearest of a bounded number of pivots and packed into blocks of one pivot and
near angles to it; so are the queries. An angle between a query and a vector is at least the angle of
their pivots less both their own angles, and at least the difference of their angles to one pivot.
1. Each query meets the blocks of its own pivot; its k-th score there is a floor.
2. A pair of blocks is scored besides if the bound on its cosines reaches the least floor of its queries.
What pairs are open is decided on one row a block; only then do matrices move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import search

#: Pivots, and vectors in a block.
PIVOTS, BLOCK = 64, 512


def _unit(v: pa.Array) -> np.ndarray:
    m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _packed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Blocks of rows (id, v): ids, m (unit rows), p (pivot), lo and hi (angles to it), block (a number). Zero vectors have
    an angle of a right angle to everything, whose cosine is theirs."""
    kind = search._kind(rows, "id")

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                angle = np.arccos(np.clip(_unit(batch.column("v")) @ pivots.T, -1, 1))
                p = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(p.astype(np.int32)), pa.array(angle.min(axis=1))], ["id", "v", "p", "angle"])

    def pack(batches):
        for batch in batches:
            p, angle = batch.column("p").to_numpy(), batch.column("angle").to_numpy()
            ends = sorted({*range(0, len(p), BLOCK), len(p), *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist()})
            for at, end in zip(ends[:-1], ends[1:], strict=True):
                ids = batch.column("id").slice(at, end - at)
                m = _unit(batch.column("v").slice(at, end - at))
                arrays = [pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([m.tobytes()], pa.binary()), pa.array(p[at : at + 1]), pa.array([angle[at:end].min()]), pa.array([angle[at:end].max()])]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "m", "p", "lo", "hi"])

    vector = rows.schema["v"].dataType.simpleString()
    placed = rows.filter("v is not null").mapInArrow(place, f"id {kind}, v {vector}, p int, angle double")
    # ranges end within a pivot too, so a pivot that many vectors are near to is spread
    near = placed.repartitionByRange("p", "angle", F.xxhash64("id")).sortWithinPartitions("p", "angle")
    return stored(near.mapInArrow(pack, f"ids array<{kind}>, m binary, p int, lo double, hi double").withColumn("block", F.monotonically_increasing_id()))


def search_bounded(vectors: DataFrame, queries: DataFrame, k: int, *, places: int = 6, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """query_id, span_id, score, rk as search.dense_search has them; and one row (pairs, scored): how many pairs of
    blocks there are and how many were scored."""
    spark = vectors.sparkSession
    some = vectors.filter("v is not null").select("v", F.xxhash64("span_id").alias("h")).orderBy("h").limit(pivots).collect()  # a bounded sample
    kinds = f"query_id {search._kind(queries, 'query_id')}, span_id {search._kind(vectors, 'span_id')}, score double"
    if not some:
        return spark.createDataFrame([], kinds + ", rk int"), spark.createDataFrame([(0, 0)], "pairs long, scored long")
    centre = _unit(pa.array([list(map(float, r.v)) for r in some], pa.list_(pa.float64())))
    rows = _packed(vectors.select(F.col("span_id").alias("id"), "v"), centre)
    asked = _packed(queries.select(F.col("query_id").alias("id"), "v"), centre)
    best = search._best_of_pairs(k, places)
    sides = [F.col("q.ids").alias("qi"), F.col("q.m").alias("qm"), F.col("r.ids").alias("ri"), F.col("r.m").alias("rm")]
    own = stored(asked.alias("q").join(rows.alias("r"), F.col("q.p") == F.col("r.p")).select(*sides).mapInArrow(best, kinds))
    found = stored(search.top_k(own, k))
    floors = found.filter(F.col("rk") == k).select("query_id", F.col("score").alias("floor"))
    each = asked.select("block", F.explode("ids").alias("query_id")).join(floors, "query_id", "left")
    least = each.groupBy("block").agg(F.min(F.coalesce("floor", F.lit(-2.0))).alias("floor"))
    apart = np.arccos(np.clip(centre @ centre.T, -1, 1))
    table = spark.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(centre)) for j in range(len(centre))], "qp int, rp int, apart double")  # pivots squared
    q = asked.select(F.col("block").alias("qb"), F.col("p").alias("qp"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi")).join(least.withColumnRenamed("block", "qb"), "qb")
    r = rows.select(F.col("block").alias("rb"), F.col("p").alias("rp"), "lo", "hi")
    met = q.join(F.broadcast(table), "qp").join(r, "rp").filter("qp <> rp")
    angle = F.greatest(F.lit(0.0), F.col("apart") - F.col("qhi") - F.col("hi"), F.col("lo") - F.col("apart") - F.col("qhi"), F.col("qlo") - F.col("apart") - F.col("hi"))
    open_ = stored(met.filter(F.cos(F.least(angle, F.lit(float(np.pi)))) + 2e-6 >= F.col("floor")).select("qb", "rb"))
    more = open_.join(asked.alias("q"), F.col("qb") == F.col("q.block")).join(rows.alias("r"), F.col("rb") == F.col("r.block")).select(*sides).mapInArrow(best, kinds)
    one = asked.select("p").join(rows.select("p"), "p").agg(F.count("*").alias("one"))
    report = asked.agg(F.count("*").alias("a")).crossJoin(rows.agg(F.count("*").alias("b"))).crossJoin(one).crossJoin(open_.agg(F.count("*").alias("two")))  # one row each
    return search.top_k(found.drop("rk").unionByName(more), k), report.select((F.col("a") * F.col("b")).alias("pairs"), (F.col("one") + F.col("two")).alias("scored"))
