"""Index building and exact top-k search: BM25 and hashed vectors in scans of blocks, cosine over given vectors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..functions import text as T
from ..functions import vector as V
from ..sources.scratch import stored
from . import scans

K1, B = 1.5, 0.75
#: Vectors in a block of the corpus, and in a block of the queries.
ROW_BLOCK, QUERY_BLOCK = 4096, 512
#: Vectors of queries that are broadcast at most.
BROADCAST_BYTES = 64_000_000


@dataclass
class BM25:
    """spans (span_id, text), their blocks (functions.keys), terms(term, df, idf), stats(n, avgdl): one row."""

    spans: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        """span_id, term, dl, tf, counted anew."""
        words = self.spans.select("span_id", T.tokens(F.col("text")).alias("words"))
        listed = words.select("span_id", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
        return listed.groupBy("span_id", "term", "dl").agg(F.count("*").alias("tf"))


def top_k(scored: DataFrame, k: int, *, by: str = "query_id", score: str = "score", tie: str = "span_id") -> DataFrame:
    """The k best rows of each query with their rank rk; ties go to the lesser id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return scored.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def term_counts(spans: DataFrame) -> DataFrame:
    """term, df, tf of span_id, text; tasks add up what they read."""

    def run(batches):
        for part in keys.parts(batches):
            t = keys.tokens(part)
            own, first, code = np.unique(t.key, return_index=True, return_inverse=True)
            df = np.bincount(keys.counted(t.row, code, len(own))[1], minlength=len(own))
            yield pa.RecordBatch.from_arrays([keys.first_words(t, first), pa.array(df), pa.array(np.bincount(code, minlength=len(own)))], ["term", "df", "tf"])

    return keys.texts(spans).mapInArrow(run, "term string, df long, tf long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def weigh_terms(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf from the counts of terms and one row of n."""
    return df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", V.idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def build_bm25(spans: DataFrame, blocks: DataFrame | None = None) -> BM25:
    """From span_id, text. Nothing is stored here: terms are counted where they are asked for, scores need blocks only."""
    blocks = keys.blocks(spans) if blocks is None else blocks
    sizes = blocks.agg(F.coalesce(F.sum(F.size("n")), F.lit(0)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))
    stats = sizes.select("n", (F.col("total") / F.nullif("n", F.lit(0))).alias("avgdl"))
    return BM25(spans, blocks, weigh_terms(term_counts(spans), spans.agg(F.count("*").alias("n"))), stats)


def bm25_sum(joined: DataFrame) -> DataFrame:
    """query_id, span_id, score (6 places) from a row a shared term: query_id, span_id, idf, tf, dl, avgdl."""
    avg = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    dl = F.greatest(F.col("dl"), F.lit(1))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * dl / avg))
    return joined.groupBy("query_id", "span_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_search(index: BM25, queries: DataFrame, k: int) -> DataFrame:
    return scans.bm25(index.blocks, queries, k, K1, B)


def _blocks(rows: DataFrame, size: int, by: str | None = None) -> DataFrame:
    """Rows of (id, v) packed into blocks of at most `size`: the ids, and a matrix of float64 with
    rows of length 1. Rows without a vector go. With `by` a block holds rows of one value of it."""

    def cuts(batch):
        ends = {*range(0, batch.num_rows, size), batch.num_rows}
        if by:
            values = batch.column(by)
            ends |= {i for i in range(1, len(values)) if values[i] != values[i - 1]}
        ends = sorted(ends)
        return zip(ends[:-1], ends[1:], strict=True)

    def run(batches):
        for batch in batches:
            for at, end in cuts(batch):
                part = batch.slice(at, end - at)
                v = part.column("v")
                m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
                n = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
                ids = part.column("id")
                arrays = [pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([m.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays + ([part.column(by)[:1]] if by else []), ["ids", "m"] + ([by] if by else []))

    own = rows.filter("v is not null")
    own = own.sortWithinPartitions(by) if by else own
    return own.mapInArrow(run, f"ids array<{_kind(rows, 'id')}>, m binary" + (f", {by} {_kind(rows, by)}" if by else ""))


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _best_of_pairs(k: int, places: int):
    """For pairs of blocks (qi, qm, ri, rm): the k best rows of each query, query_id, span_id, score."""

    def run(batches):
        for batch in batches:
            qi, qm, ri, rm = (batch.column(c) for c in ("qi", "qm", "ri", "rm"))
            for i in range(batch.num_rows):
                asked, ids = qi[i].values, ri[i].values
                c = np.round(np.frombuffer(qm[i].as_buffer()).reshape(len(asked), -1) @ np.frombuffer(rm[i].as_buffer()).reshape(len(ids), -1).T, places) + 0.0
                place = np.argsort(np.argsort(np.array(ids.to_pylist())))
                least = max(0, len(ids) - k)
                q, r = np.nonzero(c >= np.partition(c, least, axis=1)[:, least, None])  # with all ties of the k-th
                order = np.lexsort((place[r], -c[q, r], q))
                q, r = q[order], r[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                q, r = q[first], r[first]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), ids.take(pa.array(r)), pa.array(c[q, r])], ["query_id", "span_id", "score"])

    return run


def dense_search(vectors: DataFrame, queries: DataFrame, k: int, *, places: int = 6, by: str | None = None) -> DataFrame:
    """Exact cosine top-k: query_id, span_id, score, rk. vectors: span_id, v; queries: query_id, v.
    Ids are of any type with an order. With `by`, a column of both, a query meets only vectors of its own value.

    The stated queries meet all vectors block by block; a block pair yields at most k rows a
    query, so nothing but blocks and candidates moves. The query blocks are broadcast up to
    BROADCAST_BYTES; beyond, partitions of both sides meet in tasks of their own."""

    also = [by] if by else []
    rows = _blocks(vectors.select(F.col("span_id").alias("id"), "v", *also), ROW_BLOCK, by).toDF("ri", "rm", *also)
    asked = stored(_blocks(queries.select(F.col("query_id").alias("id"), "v", *also), QUERY_BLOCK, by).toDF("qi", "qm", *also))
    size = asked.agg(F.sum(F.length("qm"))).first()[0] or 0
    # blocks, not rows
    pairs = rows.join(asked, by) if by else rows.crossJoin(F.broadcast(asked)) if size <= BROADCAST_BYTES else stored(rows).hint("shuffle_replicate_nl").crossJoin(asked)
    return top_k(pairs.mapInArrow(_best_of_pairs(k, places), f"query_id {_kind(queries, 'query_id')}, span_id {_kind(vectors, 'span_id')}, score double"), k)


def features(spans: DataFrame) -> DataFrame:
    """span_id, feature, tf: tokens and pairs of neighbouring tokens."""
    listed = spans.select("span_id", T.tokens(F.col("text")).alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("#"), b))
    every = listed.select("span_id", F.explode(F.concat("t", pairs)).alias("feature"))
    return every.groupBy("span_id", "feature").agg(F.count("*").alias("tf"))


def feature_idf(counted: DataFrame, spans: DataFrame) -> DataFrame:
    n = spans.agg(F.count("*").alias("n"))
    df = counted.groupBy("feature").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return df.select("feature", V.idf(F.col("n"), F.col("df")).alias("idf"))


def unseen_weight() -> Column:
    """Weight of a feature that none of n spans has."""
    return F.log(1 + (F.col("n") + 0.5) / 0.5)


def hash_vectors(counted: DataFrame, idf: DataFrame | None, unseen: DataFrame | None, dim: int) -> DataFrame:
    """span_id, idx, w: signed feature hashing, length 1 (sparse form).

    A feature's weight is its idf, else that of a feature in no span (`unseen`: one row n),
    and 1 without a fit."""
    if idf is None:
        weighted = counted.withColumn("idf", F.lit(1.0))
    else:
        weighted = counted.join(idf, "feature", "left").crossJoin(F.broadcast(unseen)).withColumn("idf", F.coalesce("idf", unseen_weight()))
    return hashed(weighted, dim)


def hashed(weighted: DataFrame, dim: int) -> DataFrame:
    """span_id, idx, w: unit vectors (sparse form) of span_id, feature, tf, idf."""
    feature = F.col("feature").cast("binary")
    sign = F.when(F.crc32(F.concat(F.col("feature"), F.lit("|s")).cast("binary")) % 2 == 0, 1.0).otherwise(-1.0)
    hashed = weighted.select("span_id", (F.crc32(feature) % dim).cast("int").alias("idx"), (sign * F.col("idf") * (1 + F.log(F.col("tf").cast("double")))).alias("w"))
    summed = hashed.groupBy("span_id", "idx").agg(F.sum("w").alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("span_id")))
    return summed.withColumn("size", size).select("span_id", "idx", F.when(F.col("size") == 0, F.col("w")).otherwise(F.col("w") / F.nullif("size", F.lit(0.0))).alias("w"))


def as_arrays(sparse: DataFrame, spans: DataFrame, dim: int) -> DataFrame:
    """span_id, v: dense arrays of all spans; a span without features is the zero vector."""

    def run(batches):
        for batch in batches:
            v = np.zeros((batch.num_rows, dim))
            entries = batch.column("e")
            rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(entries), 0).to_numpy(zero_copy_only=False))
            flat = entries.flatten()
            v[rows, flat.field("idx").to_numpy()] = flat.field("w").to_numpy()
            arrays = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("span_id"), arrays], ["span_id", "v"])

    entries = sparse.groupBy("span_id").agg(F.collect_list(F.struct("idx", "w")).alias("e"))
    listed = spans.select("span_id").join(entries, "span_id", "left").select("span_id", "e")
    return listed.mapInArrow(run, f"span_id {_kind(listed, 'span_id')}, v array<double>")


#: Rows of span_id, text to rows of span_id, v, all of one length; rows left out have no vector.
Embedder = Callable[[DataFrame], DataFrame]


@dataclass
class HashIndex:
    """Blocks with the document frequencies of their features: hashed vectors are made of them in the tasks that
    meet them, of queries under the weights of the n spans."""

    blocks: DataFrame
    n: int
    dim: int

    @property
    def vectors(self) -> DataFrame:
        return scans.vectors(self.blocks, self.n, self.dim)

    def embed(self, rows: DataFrame) -> DataFrame:
        return scans.embed(self.blocks, self.n, self.dim, rows)


@dataclass
class VectorIndex:
    """Vectors of a given embedder, of any length."""

    vectors: DataFrame
    embed: Embedder


def build_hash_index(spans: DataFrame, dim: int = 384, blocks: DataFrame | None = None) -> HashIndex:
    """`blocks`: those of the spans, where they are stored already."""
    blocks = scans.keep(keys.blocks(spans)) if blocks is None else blocks
    n = blocks.agg(F.sum(F.size("n"))).first()[0] or 0
    return HashIndex(scans.keep(scans.weighed(blocks)), n, dim)


def text_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]]) -> Embedder:
    """An embedder from a model that maps a list of texts to a matrix. `load` runs once a task and gives the
    model; texts reach it by Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch)."""

    def embed(rows: DataFrame) -> DataFrame:
        def run(batches):
            model = None
            for batch in batches:
                if batch.num_rows:
                    model = model or load()
                    v = np.asarray(model([t or "" for t in batch.column("text").to_pylist()]), np.float64)
                    yield pa.RecordBatch.from_arrays([batch.column("span_id"), pa.array(list(v), pa.list_(pa.float64()))], ["span_id", "v"])

        return rows.select("span_id", "text").mapInArrow(run, f"span_id {_kind(rows, 'span_id')}, v array<double>")

    return embed


def embed_queries(index: HashIndex | VectorIndex, queries: DataFrame) -> DataFrame:
    return index.embed(queries.select(F.col("query_id").alias("span_id"), "text")).withColumnRenamed("span_id", "query_id")


def vector_search(index: HashIndex | VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    asked = embed_queries(index, queries)
    return scans.nearest(index.blocks, index.n, index.dim, asked, k) if isinstance(index, HashIndex) else dense_search(index.vectors, asked, k)


def picked(spans: DataFrame, *ranked: DataFrame) -> DataFrame:
    """The spans that any of the ranked lists (stored ones: they are counted) holds. Their ids are broadcast up to
    BROADCAST_BYTES, so that no text moves; beyond, both sides meet by id."""
    ids = reduce(DataFrame.unionByName, (r.select("span_id") for r in ranked)).distinct()
    few = ids.count() * 64 <= BROADCAST_BYTES
    return spans.join(F.broadcast(ids) if few else ids, "span_id", "left_semi")


def found_sets(spans: DataFrame, *ranked: DataFrame) -> DataFrame:
    """span_id, st: the token set of every span that any of the ranked lists holds, made once for each."""
    return picked(spans, *ranked).select("span_id", T.token_set(F.col("text")).alias("st"))


def overlap_search(spans: DataFrame, queries: DataFrame, k: int, blocks: DataFrame | None = None) -> DataFrame:
    """Top-k by set cosine of the token sets: query_id, span_id, score, rk. `blocks`: those of the spans, where
    they are stored already."""
    return scans.overlap(keys.blocks(spans) if blocks is None else blocks, queries, k)
