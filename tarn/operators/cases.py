"""Many small corpora in one plan: a query sees only the spans of its own case.

Counts, lengths, document frequencies and weights are kept by case, so every result is that of an engine
that holds just this case; no table is built or read case by case. Span and query ids are unique over
all cases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions import vector as V
from ..sources.scratch import stored
from . import fusion, rerank, search


@dataclass
class Cases:
    """spans (case_id, span_id, text), postings (case_id, span_id, term, tf, dl), terms (case_id, term, df, idf),
    stats (case_id, n, avgdl), weights (case_id, feature, idf), vectors (case_id, span_id, v)."""

    spans: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    weights: DataFrame
    vectors: DataFrame
    dim: int

    def embed(self, rows: DataFrame) -> DataFrame:
        """case_id, span_id, v of rows of case_id, span_id, text, under the weights of their cases."""
        return _embedded(stored(search.features(rows)), rows, self.weights, self.stats, self.dim)


def _embedded(counted: DataFrame, rows: DataFrame, weights: DataFrame, stats: DataFrame, dim: int) -> DataFrame:
    own = rows.select("case_id", "span_id")
    weighted = counted.join(own, "span_id").join(weights, ["case_id", "feature"], "left").join(stats.select("case_id", "n"), "case_id", "left")
    weighted = weighted.withColumn("idf", F.coalesce("idf", search.unseen_weight(), F.lit(1.0)))  # 1 where the case has no spans
    return search.as_arrays(search.hashed(weighted, dim), rows, dim).join(own, "span_id")


def build(spans: DataFrame, settings: Settings = Settings()) -> Cases:
    """From case_id, span_id, text."""
    spans = stored(spans.select("case_id", "span_id", "text"))
    words = spans.select("case_id", "span_id", T.tokens(F.col("text")).alias("words"))
    stats = stored(words.groupBy("case_id").agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl")))
    listed = words.select("case_id", "span_id", F.size("words").cast("long").alias("dl"), F.explode("words").alias("term"))
    postings = stored(listed.groupBy("case_id", "span_id", "term", "dl").agg(F.count("*").alias("tf")))
    df = postings.groupBy("case_id", "term").agg(F.count("*").alias("df")).join(stats, "case_id")
    terms = stored(df.select("case_id", "term", "df", V.idf(F.col("n"), F.col("df")).alias("idf")))
    counted = stored(search.features(spans))
    found = counted.join(spans.select("case_id", "span_id"), "span_id").groupBy("case_id", "feature").agg(F.count("*").alias("df")).join(stats, "case_id")
    weights = stored(found.select("case_id", "feature", V.idf(F.col("n"), F.col("df")).alias("idf")))
    dim = settings.retrieval.dim
    return Cases(spans, postings, terms, stats, weights, stored(_embedded(counted, spans, weights, stats, dim)), dim)


def bm25_search(cases: Cases, queries: DataFrame, k: int) -> DataFrame:
    """query_id, span_id, score, rk. queries: case_id, query_id, text."""
    wanted = queries.select("case_id", "query_id", F.explode(T.token_set(F.col("text"))).alias("term"))
    joined = cases.postings.join(wanted.join(cases.terms, ["case_id", "term"]), ["case_id", "term"]).join(cases.stats.select("case_id", "avgdl"), "case_id")
    return search.top_k(search.bm25_sum(joined).filter("score > 0"), k)


def dense_search(cases: Cases, queries: DataFrame, k: int) -> DataFrame:
    asked = cases.embed(queries.select("case_id", F.col("query_id").alias("span_id"), "text")).withColumnRenamed("span_id", "query_id")
    return search.dense_search(cases.vectors, asked, k, by="case_id")


def retrieve(cases: Cases, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Hits (case_id, query_id, rk, span_id, score, fused, rerank_z, rerank_raw, text) of case_id, query_id, text."""
    r = settings.retrieval
    pool = max(4 * r.top_k, r.candidate_pool)
    sparse, dense = stored(bm25_search(cases, queries, pool)), stored(dense_search(cases, queries, pool))
    sets = stored(search.found_sets(cases.spans, dense, sparse))
    fused = fusion.weighted_rrf(dense, sparse, fusion.adaptive_weights(queries, dense, sparse, sets, r.adaptive), k=r.rrf_k, top=pool)
    ranked = rerank.calibrated_rerank(rerank.overlap_scores(queries, fused, sets), settings.rerank).filter(F.col("rk") <= r.top_k)
    hits = ranked.join(cases.spans, "span_id")
    return hits.select("case_id", "query_id", "rk", "span_id", "score", "fused", "rerank_z", "rerank_raw", "text")
