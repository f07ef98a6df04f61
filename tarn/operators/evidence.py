"""Claims to evidence: alignment, the gate and what it prunes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Evidence
from ..functions import text as T


def extract_claims(texts: DataFrame) -> DataFrame:
    """query_id, claim_ix, claim of every assertion of query_id, text."""
    return texts.select("query_id", F.posexplode(T.claims(F.col("text"))).alias("claim_ix", "claim"))


def align(claims: DataFrame, hits: DataFrame, config: Evidence = Evidence()) -> DataFrame:
    """query_id, claim_ix, claim, verdict, evidence (span or null), support, anchored.

    hits: query_id, rk, span_id, text. The best span wins, the earlier one on ties; claims
    without any overlap, or without hits, have no evidence."""
    said = claims.withColumn("ct", T.token_set(F.col("claim")))
    found = hits.select("query_id", "rk", "span_id", T.token_set(F.col("text")).alias("st"))
    pairs = said.join(found, "query_id").withColumn("best", T.align_score(F.col("ct"), F.col("st"))).filter("best > 0")
    order = Window.partitionBy("query_id", "claim_ix").orderBy(F.desc("best"), "rk")
    top = pairs.withColumn("n", F.row_number().over(order)).filter("n = 1").select("query_id", "claim_ix", "span_id", "best")
    best = F.coalesce("best", F.lit(0.0))
    supported = best >= config.support_threshold
    return claims.join(top, ["query_id", "claim_ix"], "left").select(
        "query_id",
        "claim_ix",
        "claim",
        F.when(supported, "supported").otherwise("unsupported").alias("verdict"),
        F.when(supported, F.col("span_id")).alias("evidence"),
        F.round(best, 6).alias("support"),
        (supported & F.col("span_id").isNotNull()).alias("anchored"),
    )


def gate_report(aligned: DataFrame, config: Evidence = Evidence()) -> DataFrame:
    """query_id, total, anchored, unanchored, ratio, passed."""
    counts = aligned.groupBy("query_id").agg(F.count("*").alias("total"), F.count_if("anchored").alias("anchored"))
    ratio = F.col("unanchored") / F.col("total")
    return counts.withColumn("unanchored", F.col("total") - F.col("anchored")).select(
        "query_id", "total", "anchored", "unanchored", F.round(ratio, 6).alias("ratio"), (ratio <= config.max_unanchored_ratio).alias("passed")
    )


def gate_apply(aligned: DataFrame, config: Evidence = Evidence()) -> DataFrame:
    return aligned.filter("anchored") if config.prune_unanchored else aligned


def gate_enforce(aligned: DataFrame, config: Evidence = Evidence()) -> DataFrame:
    """The queries that fail the gate; none may be left where it is enforced."""
    return gate_report(aligned, config).filter("not passed")


class GateError(ValueError):
    """Queries fail the gate where it is enforced."""


def require_gate(aligned: DataFrame, config: Evidence = Evidence()) -> DataFrame:
    """The claims that gate_apply keeps, if every query passes the gate; else GateError, which counts
    the queries that fail and names the worst."""
    worst = gate_enforce(aligned, config).agg(F.count("*").alias("n"), F.max(F.struct("ratio", "query_id")).alias("worst")).first()
    if worst.n:
        raise GateError(f"{worst.n} queries fail the gate; query {worst.worst.query_id} has {worst.worst.ratio} of its claims without evidence")
    return gate_apply(aligned, config)


def unanchored(aligned: DataFrame) -> DataFrame:
    return aligned.filter("not anchored")
