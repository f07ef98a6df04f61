"""The extractive roles of the debate as set operations, and the parsers of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Debate
from ..functions import text as T

#: Answer of a proposer without evidence (fixed value).
NO_EVIDENCE = "NO_EVIDENCE: 语料中没有与该问题相关的证据。"
#: Threshold of the checker (fixed value).
CHECKED = 0.30


def bodies(hits: DataFrame) -> DataFrame:
    """query_id, pos, span_id, body, bt: the lines of the hits in order. Only a hit's first
    line carries its span id, as in the rendered evidence block."""
    lines = F.filter(F.transform(F.split(T.strip(F.col("text")), "\n"), T.strip), lambda x: x != "")
    listed = hits.select("query_id", "rk", "span_id", F.posexplode(lines).alias("line", "body"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("rk", "line")) - 1
    return listed.select("query_id", pos.alias("pos"), F.when(F.col("line") == 0, F.col("span_id")).alias("span_id"), "body", T.plain_set(F.col("body")).alias("bt"))


def evidence_block(hits: DataFrame) -> DataFrame:
    """query_id, block: one line a hit, in order."""
    line = F.concat(F.lit("span::"), F.col("span_id").cast("string"), F.lit(" | "), F.coalesce("title", F.lit("untitled")), F.lit(" :: "), F.col("text"))
    listed = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rk", line.alias("line")))).alias("lines"))
    return listed.select("query_id", F.array_join(F.col("lines.line"), "\n").alias("block"))


def _related(queries: DataFrame, lines: DataFrame) -> DataFrame:
    asked = queries.select("query_id", T.plain_set(F.col("text")).alias("qt"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rel"), "pos")
    return lines.join(asked, "query_id").withColumn("rel", T.jaccard(F.col("qt"), F.col("bt"))).withColumn("place", F.row_number().over(order)).drop("qt")


def propose(queries: DataFrame, lines: DataFrame, config: Debate = Debate()) -> DataFrame:
    """query_id, proposal: the lines nearest to the query, or the first line, or none."""
    ranked = _related(queries, lines)
    picked = ranked.filter(((F.col("place") <= config.max_sentences) & (F.col("rel") > 0)) | (F.col("pos") == 0))
    listed = picked.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when((F.col("place") <= config.max_sentences) & (F.col("rel") > 0), F.struct("place", "body")))).alias("best"),
        F.max(F.when(F.col("pos") == 0, F.col("body"))).alias("first"),
    )
    joined = F.when(F.size("best") > 0, F.array_join(F.col("best.body"), " ")).otherwise(F.col("first"))
    return queries.select("query_id").join(listed, "query_id", "left").select("query_id", T.strip(F.coalesce(joined, F.lit(NO_EVIDENCE))).alias("proposal"))


def revise(proposals: DataFrame, lines: DataFrame, objections: DataFrame) -> DataFrame:
    """query_id, proposal: with up to three cited lines that it does not contain yet.
    objections: query_id, citation."""
    cited = lines.filter("span_id is not null").join(objections.select("query_id", F.col("citation").alias("span_id")).distinct(), ["query_id", "span_id"], "left_semi")
    missing = cited.join(proposals, "query_id").filter(~F.contains("proposal", "body"))
    order = Window.partitionBy("query_id").orderBy("pos")
    extra = missing.withColumn("n", F.row_number().over(order)).filter("n <= 3").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("n", "body"))).alias("x"))
    added = F.concat(F.col("proposal"), F.when(F.size("x") > 0, F.concat(F.lit(" "), F.array_join(F.col("x.body"), " "))).otherwise(""))
    return proposals.join(extra, "query_id", "left").select("query_id", T.strip(F.coalesce(added, F.col("proposal"))).alias("proposal"))


def fact_check(claims: DataFrame, lines: DataFrame) -> DataFrame:
    """query_id, claim_ix, checked, span (or 'none'), overlap (2 places)."""
    said = claims.select("query_id", "claim_ix", T.plain_set(F.col("claim")).alias("ct"))
    pairs = said.join(lines, "query_id").withColumn("s", T.jaccard(F.col("ct"), F.col("bt"))).filter("s > 0")
    order = Window.partitionBy("query_id", "claim_ix").orderBy(F.desc("s"), "pos")
    top = pairs.withColumn("n", F.row_number().over(order)).filter("n = 1").select("query_id", "claim_ix", "span_id", "s")
    s = F.coalesce("s", F.lit(0.0))
    return claims.select("query_id", "claim_ix").join(top, ["query_id", "claim_ix"], "left").select(
        "query_id", "claim_ix", F.when(s >= CHECKED, "SUPPORTED").otherwise("UNSUPPORTED").alias("checked"), F.coalesce(F.col("span_id").cast("string"), F.lit("none")).alias("span"), F.round(s, 2).alias("overlap")
    )


def critique(queries: DataFrame, proposals: DataFrame, lines: DataFrame, config: Debate = Debate()) -> DataFrame:
    """query_id, obj_ix, citation, excerpt, rel: relevant spans that the proposal leaves out."""
    said = proposals.select("query_id", T.plain_set(F.col("proposal")).alias("pt"))
    ranked = _related(queries, lines).join(said, "query_id").withColumn("top", F.max("rel").over(Window.partitionBy("query_id")))
    near = (F.col("top") <= 0) | (F.col("rel") >= config.relevance_gate * F.col("top"))
    open_ = ranked.filter(near & (T.coverage(F.col("bt"), F.col("pt")) < config.covered_gate) & F.col("span_id").isNotNull())
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return open_.withColumn("n", n).filter("n <= 3").select("query_id", (F.col("n") - 1).alias("obj_ix"), F.col("span_id").alias("citation"), F.substring("body", 1, 40).alias("excerpt"), F.round("rel", 2).alias("rel"))


def synthesize(claims: DataFrame) -> DataFrame:
    """query_id, answer: the claims in order without bullets."""
    clean = T.strip(F.regexp_replace("claim", T.BULLET, ""))
    listed = claims.withColumn("c", clean).filter("c <> ''").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("claim_ix", "c"))).alias("x"))
    return listed.select("query_id", F.array_join(F.col("x.c"), " ").alias("answer"))


def vote(samples: DataFrame) -> DataFrame:
    """query_id, text, votes: the commonest text; the one seen first wins ties. samples: query_id, ix, text."""
    counts = samples.groupBy("query_id", "text").agg(F.count("*").alias("votes"), F.min("ix").alias("first"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "first")
    return counts.withColumn("n", F.row_number().over(order)).filter("n = 1").select("query_id", "text", "votes")


def parse_objections(lines: DataFrame) -> DataFrame:
    """query_id, line_no, citations, reason of lines OBJECTION | citations | reason; a line of
    two columns has no citation."""
    line = T.strip(F.col("line"))
    parts = F.transform(F.split(line, r"\|"), T.strip)
    rows = lines.withColumn("line", line).filter(F.startswith("line", F.lit("OBJECTION"))).withColumn("p", parts).filter(F.size("p") >= 2)
    cites = F.filter(F.transform(F.split(F.when(F.size("p") >= 3, F.get("p", F.lit(1))).otherwise(""), ","), T.strip), lambda c: F.startswith(c, F.lit("span::")))
    rest = F.when(F.size("p") >= 3, F.slice("p", 3, F.size("p"))).otherwise(F.slice("p", 2, F.size("p")))
    return rows.select("query_id", "line_no", cites.alias("citations"), T.strip(F.array_join(rest, "|")).alias("reason"))


def parse_verdicts(lines: DataFrame) -> DataFrame:
    """query_id, claim_ix, verdict, span of lines CLAIM i | verdict | span; the last line of a claim wins."""
    line = T.strip(F.col("line"))
    parts = F.transform(F.split(line, r"\|"), T.strip)
    rows = lines.withColumn("line", line).filter(F.startswith(F.upper("line"), F.lit("CLAIM"))).withColumn("p", parts).filter(F.size("p") >= 3)
    ix = F.regexp_extract(F.get("p", F.lit(0)), r"^\S+\s+([+-]?\d+)(?:\s|$)", 1)
    rows = rows.withColumn("claim_ix", F.when(ix != "", ix.cast("int"))).filter("claim_ix is not null")
    span = F.when(F.lower(F.get("p", F.lit(2))) == "none", "").otherwise(F.get("p", F.lit(2)))
    last = F.row_number().over(Window.partitionBy("query_id", "claim_ix").orderBy(F.desc("line_no")))
    return rows.withColumn("last", last).filter("last = 1").select("query_id", "claim_ix", F.upper(F.get("p", F.lit(1))).alias("verdict"), span.alias("span"))


def filter_valid(objections: DataFrame, known: DataFrame) -> DataFrame:
    """Objections with their known citations only; without any they go. objections: query_id,
    obj_ix, citations, ...; known: query_id, citation."""
    cited = objections.select("query_id", "obj_ix", F.posexplode("citations").alias("at", "citation"))
    good = cited.join(known.select("query_id", "citation").distinct(), ["query_id", "citation"], "left_semi")
    kept = good.groupBy("query_id", "obj_ix").agg(F.sort_array(F.collect_list(F.struct("at", "citation"))).alias("x"))
    return objections.drop("citations").join(kept.select("query_id", "obj_ix", F.col("x.citation").alias("citations")), ["query_id", "obj_ix"])


def stalled(objections: DataFrame) -> DataFrame:
    """query_id, round, stalled: whether a round raises the objections of the one before.
    objections: query_id, round, text, citations."""
    sets = objections.groupBy("query_id", "round").agg(F.sort_array(F.collect_list(F.concat_ws("\x1f", "text", F.array_join("citations", ",")))).alias("s"))
    w = Window.partitionBy("query_id").orderBy("round")
    same = (F.lag("round").over(w) == F.col("round") - 1) & (F.lag("s").over(w) == F.col("s"))
    return sets.select("query_id", "round", F.coalesce(same, F.lit(False)).alias("stalled"))


def deltas(turns: DataFrame, distance) -> DataFrame:
    """turns with delta: distance to the turn before, within 0 and 1; 1 for the first."""
    w = Window.partitionBy("query_id").orderBy("round")
    d = F.least(F.lit(1.0), F.greatest(F.lit(0.0), distance(F.lag("v").over(w), F.col("v"))))
    return turns.withColumn("delta", F.round(F.when(F.lag("round").over(w).isNull(), 1.0).otherwise(d), 6))


def stability(turns: DataFrame) -> DataFrame:
    """query_id, stability: 1 less the mean change after the first turn; 1 if there is none."""
    return turns.withColumn("first", F.min("round").over(Window.partitionBy("query_id"))).groupBy("query_id").agg(
        F.round(1 - F.coalesce(F.avg(F.when(F.col("round") > F.col("first"), F.col("delta"))), F.lit(0.0)), 6).alias("stability")
    )
