"""Answer and retrieval metrics per query, and the report over all cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V


def _best(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, best: the largest align score of each left row (lt) over the right rows (rt) of its query."""
    pairs = left.join(right, "query_id", "left").withColumn("s", F.coalesce(T.align_score(F.col("lt"), F.col("rt")), F.lit(0.0)))
    return pairs.groupBy(*keys).agg(F.max("s").alias("best"))


def answer_sentences(answers: DataFrame) -> DataFrame:
    """query_id, ix, sentence."""
    return answers.select("query_id", F.posexplode(T.sentences(F.col("answer"))).alias("ix", "sentence"))


def faithfulness(answers: DataFrame, contexts: DataFrame, threshold: float = 0.30) -> DataFrame:
    """query_id, faithfulness: share of sentences that some context supports; 0 without sentences."""
    said = answer_sentences(answers).select("query_id", "ix", T.token_set(F.col("sentence")).alias("lt"))
    best = _best(said, contexts.select("query_id", T.token_set(F.col("text")).alias("rt")), ["query_id", "ix"])
    share = best.groupBy("query_id").agg(F.avg((F.col("best") >= threshold).cast("double")).alias("x"))
    return answers.select("query_id").join(share, "query_id", "left").select("query_id", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("faithfulness"))


def context_precision(contexts: DataFrame, gold: DataFrame, threshold: float = 0.30) -> DataFrame:
    """query_id, context_precision: share of contexts near the gold answer; 0 without contexts."""
    pairs = contexts.select("query_id", T.token_set(F.col("text")).alias("ct")).join(gold.select("query_id", T.token_set(F.col("answer")).alias("gt")), "query_id")
    share = pairs.groupBy("query_id").agg(F.avg((T.align_score(F.col("ct"), F.col("gt")) >= threshold).cast("double")).alias("x"))
    return gold.select("query_id").join(share, "query_id", "left").select("query_id", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("context_precision"))


def context_recall(contexts: DataFrame, gold_spans: DataFrame, queries: DataFrame, threshold: float = 0.55) -> DataFrame:
    """query_id, context_recall: share of gold spans that some context covers; 1 without gold spans."""
    gold = gold_spans.select("query_id", "ix", T.token_set(F.col("text")).alias("gt"))
    pairs = gold.join(contexts.select("query_id", T.token_set(F.col("text")).alias("ct")), "query_id", "left")
    best = pairs.withColumn("s", F.coalesce(T.align_score(F.col("ct"), F.col("gt")), F.lit(0.0))).groupBy("query_id", "ix").agg(F.max("s").alias("best"))
    share = best.groupBy("query_id").agg(F.avg((F.col("best") >= threshold).cast("double")).alias("x"))
    return queries.select("query_id").join(share, "query_id", "left").select("query_id", F.round(F.coalesce("x", F.lit(1.0)), 6).alias("context_recall"))


def keyword_recall(answers: DataFrame, keywords: DataFrame) -> DataFrame:
    """query_id, keyword_recall: share of keywords whose tokens, or themselves, are in the answer; 1 without keywords."""
    said = answers.select("query_id", "answer", T.token_set(F.col("answer")).alias("at"))
    pairs = said.join(keywords.select("query_id", "keyword", T.token_set(F.col("keyword")).alias("kt")), "query_id")
    hit = (F.size(F.array_except("kt", "at")) == 0) | F.contains("answer", "keyword")
    share = pairs.groupBy("query_id").agg(F.avg(hit.cast("double")).alias("x"))
    return answers.select("query_id").join(share, "query_id", "left").select("query_id", F.round(F.coalesce("x", F.lit(1.0)), 6).alias("keyword_recall"))


def answer_relevancy(query_vectors: DataFrame, sentence_vectors: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, answer_relevancy: mean cosine (0 at least) of the answer's sentences to the query."""
    pairs = sentence_vectors.select("query_id", "v").join(query_vectors.select("query_id", F.col("v").alias("qv")), "query_id")
    mean = pairs.groupBy("query_id").agg(F.avg(F.greatest(F.lit(0.0), V.cosine(F.col("qv"), F.col("v")))).alias("x"))
    return answers.select("query_id").join(mean, "query_id", "left").select("query_id", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("answer_relevancy"))


def cases(metrics: DataFrame) -> DataFrame:
    """metrics with passed: faithful, complete and with its keywords."""
    return metrics.withColumn("passed", (F.col("faithfulness") >= 0.6) & (F.col("context_recall") >= 0.5) & (F.col("keyword_recall") >= 0.6))


def report(metrics: DataFrame) -> DataFrame:
    """One row: total, passed and the mean of every metric."""
    names = [c for c in metrics.columns if c not in ("query_id", "passed")]
    return cases(metrics).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in names))
