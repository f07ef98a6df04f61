"""Calibrated reranking: standardised scores, blending behind a margin, a keep set."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Rerank
from ..functions import text as T


def z_score(value: str, by: str) -> Column:
    """Standard score in its group (population deviation); 0 where nothing varies. 9 places,
    so that noise in the last bits cannot turn ties."""
    group = Window.partitionBy(by)
    spread = F.stddev_pop(value).over(group)
    z = (F.col(value) - F.avg(value).over(group)) / F.nullif(spread, F.lit(0.0))
    return F.round(F.when(spread < 1e-12, 0.0).otherwise(F.coalesce(z, F.lit(0.0))), 9)


def overlap_scores(queries: DataFrame, fused: DataFrame, sets: DataFrame) -> DataFrame:
    """fused with raw: the set cosine of the query's and the span's tokens. sets: span_id, st (search.found_sets)."""
    asked = queries.select("query_id", T.token_set(F.col("text")).alias("qt"))
    joined = fused.join(asked, "query_id").join(sets, "span_id")
    return joined.withColumn("raw", T.set_cosine(F.col("qt"), F.col("st"))).drop("qt", "st")


#: A query's text and the texts of its candidates, in fused order, to one score a candidate.
ListScorer = Callable[[str, list[str]], Sequence[float]]


def listwise_scores(queries: DataFrame, fused: DataFrame, spans: DataFrame, load: Callable[[], ListScorer]) -> DataFrame:
    """fused with raw: what a scorer says that sees a query's whole list of candidates at once. A list is
    as long as the candidate pool, never longer; `load` gives the scorer, once a list."""
    asked = queries.select("query_id", F.col("text").alias("__query"))
    listed = fused.join(asked, "query_id").join(spans.select("span_id", F.col("text").alias("__span")), "span_id")
    columns = fused.columns

    def score(group: pa.Table) -> pa.Table:
        group = group.sort_by("rk")
        raw = load()(group.column("__query")[0].as_py() or "", [t or "" for t in group.column("__span").to_pylist()])
        return group.select(columns).append_column("raw", pa.array([float(x) for x in raw], pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fused.schema)
    return listed.select(*columns, "__query", "__span").groupBy("query_id").applyInArrow(score, f"{kinds}, raw double")


def by_scarcity() -> ListScorer:
    """A list-wise scorer: the share of the query's words that a text holds, a word counting the more the
    fewer of the candidates hold it. Words are runs of letters and digits (T.ASCII_WORD)."""

    def score(query: str, texts: list[str]) -> list[float]:
        word = re.compile(T.ASCII_WORD)
        asked, held = set(word.findall(query.lower())), [set(word.findall(t.lower())) for t in texts]
        weight = {w: 1 / n for w in asked if (n := sum(w in h for h in held))}
        whole = sum(weight[w] for w in sorted(weight))
        return [round(sum(weight[w] for w in sorted(weight) if w in h) / whole, 9) if whole else 0.0 for h in held]

    return score


def calibrated_rerank(scored: DataFrame, config: Rerank = Rerank()) -> DataFrame:
    """From query_id, span_id, fused, rk, raw: query_id, span_id, score, rerank_z, rerank_raw, rk.

    Where the scorer's best two differ by the margin, its standard scores are blended with
    the fused ones; else the fused order stands. Kept are spans above the floor, the scorer's
    and the fused first, and the next best until half of the spans (2 at least) are kept."""
    q = Window.partitionBy("query_id")
    by_z = q.orderBy(F.desc("zr"), "rk")
    z = scored.withColumns({"zr": z_score("raw", "query_id"), "zf": z_score("fused", "query_id")})
    z = z.withColumns({"n": F.count("*").over(q), "place": F.row_number().over(by_z)})
    place = lambda k: F.max(F.when(F.col("place") == k, F.col("zr"))).over(q)
    lead = place(1) - F.coalesce(place(2), F.lit(-9e9))
    blend = F.when(lead >= config.min_margin, config.alpha * F.col("zr") + (1 - config.alpha) * F.col("zf")).otherwise(F.col("zf"))
    kept = (F.col("n") < 4) | (F.col("zr") >= config.z_floor) | (F.col("place") == 1) | (F.col("rk") == 1)
    z = z.withColumns({"blend": F.round(blend, 9), "kept": kept})
    z = z.withColumn("n_kept", F.sum(F.col("kept").cast("int")).over(q))
    least = F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))
    spare = F.row_number().over(Window.partitionBy("query_id", "kept").orderBy(F.desc("zr"), "rk"))
    z = z.withColumn("spare", spare).filter(F.col("kept") | (F.col("spare") <= least - F.col("n_kept")))
    z = z.withColumn("pos", F.row_number().over(q.orderBy(F.desc("blend"), "rk"))).filter(F.col("pos") <= config.top_n)
    return z.select(
        "query_id", "span_id", F.round("blend", 6).alias("score"), F.round("zr", 6).alias("rerank_z"), F.round("raw", 6).alias("rerank_raw"), F.col("fused"), F.col("pos").alias("rk")
    )
