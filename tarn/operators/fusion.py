"""Fusion of two ranked lists: retrieval signals, adaptive weights, weighted reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

MARGIN_SCALE = 0.20


def six_places(x: Column) -> Column:
    """Six places of a number of 0 or more by its product with a million: sums of such numbers are often
    halves, which a rounding of their printed digits would put up or down as noise in the last bits has it."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def entropy(ranked: DataFrame) -> DataFrame:
    """query_id, entropy: Shannon entropy of the positive scores over its maximum; 0 for one or none."""
    v = F.when(F.col("score") > 0, F.col("score"))
    sums = ranked.groupBy("query_id").agg(F.sum(v).alias("s"), F.sum(v * F.log(v)).alias("vl"), F.count(v).alias("n"))
    h = (F.log("s") - F.col("vl") / F.col("s")) / F.log(F.col("n").cast("double"))
    return sums.select("query_id", F.round(F.when(F.col("n") <= 1, 0.0).otherwise(h), 6).alias("entropy"))


def margin(ranked: DataFrame) -> DataFrame:
    """query_id, margin: lead of the first score over the second on a scale of 0.2, at most 1."""
    score = lambda rk: F.max(F.when(F.col("rk") == rk, F.col("score")))
    lead = (score(1) - score(2)) / MARGIN_SCALE
    return ranked.groupBy("query_id").agg(F.round(F.coalesce(F.least(F.lit(1.0), F.greatest(lead, F.lit(0.0))), F.lit(0.0)), 6).alias("margin"))


def lexical(queries: DataFrame, ranked: DataFrame, sets: DataFrame) -> DataFrame:
    """query_id, lexical: share of the query's tokens that occur in any of its ranked spans. sets: span_id,
    st (search.found_sets)."""
    asked = queries.select("query_id", T.token_set(F.col("text")).alias("qt"))
    pairs = ranked.select("query_id", "span_id").join(asked, "query_id").join(sets, "span_id")
    there = pairs.select("query_id", F.explode(F.array_intersect("qt", "st")).alias("term")).distinct().groupBy("query_id").agg(F.count("*").alias("c"))
    share = F.coalesce(F.col("c") / F.nullif(F.size("qt"), F.lit(0)), F.lit(0.0))
    return asked.join(there, "query_id", "left").select("query_id", F.round(share, 6).alias("lexical"))


def adaptive_weights(queries: DataFrame, dense: DataFrame, sparse: DataFrame, sets: DataFrame, adaptive: bool = True) -> DataFrame:
    """query_id, entropy, margin, lexical, w_dense, w_sparse. Entropy is that of the sparse
    scores, margin and the lexical share those of the dense list."""
    if not adaptive:
        zero = {k: F.lit(0.0) for k in ("entropy", "margin", "lexical")}
        return queries.select("query_id").withColumns(zero | {"w_dense": F.lit(0.5), "w_sparse": F.lit(0.5)})
    joined = lexical(queries, dense, sets).join(entropy(sparse), "query_id", "left").join(margin(dense), "query_id", "left").fillna(0.0)
    raw = 0.5 + 0.25 * F.col("lexical") - 0.20 * F.col("entropy") - 0.15 * F.col("margin")
    w = six_places(F.greatest(F.lit(0.1), F.least(F.lit(0.9), raw)))
    return joined.select("query_id", "entropy", "margin", "lexical", F.round(1 - w, 6).alias("w_dense"), w.alias("w_sparse"))


def weighted_rrf(dense: DataFrame, sparse: DataFrame, weights: DataFrame | None = None, *, k: int = 60, top: int = 8) -> DataFrame:
    """query_id, span_id, fused, rk of the union of two ranked lists."""
    d = dense.select("query_id", "span_id", F.col("rk").alias("rd"))
    s = sparse.select("query_id", "span_id", F.col("rk").alias("rs"))
    both = d.join(s, ["query_id", "span_id"], "full")
    if weights is None:
        both = both.withColumns({"w_dense": F.lit(0.5), "w_sparse": F.lit(0.5)})
    else:
        both = both.join(weights.select("query_id", "w_dense", "w_sparse"), "query_id")
    part = lambda w, r: F.coalesce(F.col(w) / (k + F.col(r)), F.lit(0.0))
    scored = both.select("query_id", "span_id", six_places(part("w_dense", "rd") + part("w_sparse", "rs")).alias("fused"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "span_id")
    return scored.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= top)
