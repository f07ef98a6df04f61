"""Retrieval end to end, and the bounded debate over a batch of queries.

Queries leave the loop as they converge or stall, so later rounds only carry the rest. Each
round's tables are written to the checkpoint folder: plans stay short, and a lost executor
costs a file read. Rounds are few (`max_rounds`), the loop itself runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Debate, Settings
from ..functions import text as T
from ..functions import vector as V
from ..sources.scratch import lasting, stored
from . import evidence, fusion, rerank, roles, search


@dataclass
class Corpus:
    """Indexes over spans (span_id of any type with an order, text), made when they are first asked for. Texts are
    read where they lie; what is stored are blocks of their tokens."""

    spans: DataFrame
    settings: Settings = field(default_factory=Settings)
    embedder: search.Embedder | None = None
    terms: DataFrame | None = None  # where they are counted already: term, df, tf

    @cached_property
    def blocks(self) -> DataFrame:
        with lasting():
            return search.scans.keep(search.keys.blocks(self.spans))

    @cached_property
    def bm25(self) -> search.BM25:
        index = search.build_bm25(self.spans, self.blocks)
        return replace(index, terms=search.weigh_terms(self.terms, index.stats)) if self.terms is not None else index

    @cached_property
    def dense(self) -> search.HashIndex | search.VectorIndex:
        with lasting():
            if self.embedder is not None:
                return search.VectorIndex(stored(self.embedder(self.spans)), self.embedder)
            return search.build_hash_index(self.spans, self.settings.retrieval.dim, self.blocks)

    @property
    def n_terms(self) -> DataFrame:
        """terms: how many distinct ones; one row."""
        terms = search.term_counts(self.spans) if self.terms is None else self.terms
        return terms.agg(F.count("*").alias("terms"))


def build(spans: DataFrame, settings: Settings = Settings(), embed: search.Embedder | None = None) -> Corpus:
    """Indexes of the spans; with `embed` the vectors are what it makes of texts, else hashed features."""
    if spans.isEmpty():
        raise ValueError("empty corpus")
    return Corpus(spans, settings, embed)


def retrieve(corpus: Corpus, queries: DataFrame, settings: Settings = Settings(), top_k: int = 0, scorer: Callable[[], rerank.ListScorer] | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, rk, span_id, score, fused, rerank_z, rerank_raw, text) and signals of query_id, text.
    `scorer` loads one that scores a query's list of candidates; without it the overlap of tokens counts."""
    r = settings.retrieval
    k = top_k or r.top_k
    pool = max(4 * k, r.candidate_pool)
    sparse = stored(search.bm25_search(corpus.bm25, queries, pool))
    dense = stored(search.vector_search(corpus.dense, queries, pool))
    found = stored(search.picked(corpus.spans.select("span_id", "text"), dense, sparse))
    sets = stored(found.select("span_id", T.token_set(F.col("text")).alias("st")))
    signals = fusion.adaptive_weights(queries, dense, sparse, sets, r.adaptive)
    fused = fusion.weighted_rrf(dense, sparse, signals, k=r.rrf_k, top=pool)
    if settings.rerank.enabled:
        raw = rerank.listwise_scores(queries, fused, found, scorer) if scorer else rerank.overlap_scores(queries, fused, sets)
        ranked = rerank.calibrated_rerank(raw, settings.rerank)
    else:
        ranked = fused.select("query_id", "span_id", F.col("fused").alias("score"), F.lit(0.0).alias("rerank_z"), F.lit(0.0).alias("rerank_raw"), "fused", "rk")
    hits = ranked.filter(F.col("rk") <= k).join(found, "span_id")
    return hits.select("query_id", "rk", "span_id", "score", "fused", "rerank_z", "rerank_raw", "text"), signals


Emitter = Callable[[DataFrame], None]


def event_rows(event: str, rows: DataFrame, *payload: str) -> DataFrame:
    """event, query_id, payload: one event a row."""
    return rows.select(F.lit(event).alias("event"), "query_id", F.to_json(F.struct(*payload)).alias("payload"))


Proposer = Callable[[DataFrame, DataFrame, Debate], DataFrame]
Critic = Callable[[DataFrame, DataFrame, DataFrame, Debate], DataFrame]


def agreed(queries: DataFrame, lines: DataFrame, config: Debate, propose: Proposer) -> DataFrame:
    """query_id, proposal: what most of `self_consistency` samples of a proposer say, the first of equals."""
    if config.self_consistency <= 1:
        return propose(queries, lines, config)
    samples = [propose(queries, lines, config).select("query_id", F.lit(i).alias("ix"), T.strip(F.col("proposal")).alias("text")) for i in range(config.self_consistency)]
    # stored: votes count what was said once, however often a lost task asks anew
    return roles.vote(stored(reduce(DataFrame.unionByName, samples))).select("query_id", F.col("text").alias("proposal"))


def run(corpus: Corpus, queries: DataFrame, settings: Settings = Settings(), propose: Proposer = roles.propose, critic: Critic = roles.critique, events: Emitter | None = None, scorer: Callable[[], rerank.ListScorer] | None = None) -> dict[str, DataFrame]:
    """Tables of a debate on query_id, text: answers (answer, converged, metrics), rounds,
    claims (of the last round, gated), hits, objections.

    propose (queries, lines, config) gives query_id, proposal; critic (queries, proposals, lines,
    config) gives query_id, obj_ix, citation, excerpt, rel. An objection that cites no hit of its
    query does not count. `events` takes rows of event, query_id, payload (JSON) as they come about:
    retrieval.done a query, debate.round a query and round, debate.done a query."""
    d = settings.debate
    found, signals = retrieve(corpus, queries, settings, scorer=scorer)
    hits, signals = stored(found.select("query_id", "rk", "span_id", "text")), stored(signals)
    emit = events or (lambda rows: None)
    n_hits = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("hits")), "query_id", "left").fillna(0, ["hits"])
    emit(event_rows("retrieval.done", n_hits, "hits"))
    active = queries
    rounds, claims, raised = [], [], []
    before = None
    for index in range(d.max_rounds):
        own = hits.join(active.select("query_id"), "query_id", "left_semi")
        lines = stored(roles.bodies(own))
        said = agreed(active, lines, d, propose)
        if before is not None:
            said = roles.revise(said, lines, before.join(active.select("query_id"), "query_id", "left_semi"))
        said = stored(said)
        aligned = evidence.align(evidence.extract_claims(said.withColumnRenamed("proposal", "text")), own, settings.evidence)
        checked = roles.fact_check(aligned.select("query_id", "claim_ix", "claim"), lines)
        swap = (F.col("checked") == "SUPPORTED") & (F.col("verdict") == "supported") & (F.col("span") != "none")
        aligned = aligned.join(checked.drop("overlap"), ["query_id", "claim_ix"], "left")
        aligned = stored(aligned.withColumn("evidence", F.when(swap, F.col("span").try_cast(corpus.spans.schema["span_id"].dataType)).otherwise(F.col("evidence"))).drop("checked", "span").withColumn("round", F.lit(index)))
        objections = critic(active, said, lines, d)
        if critic is not roles.critique:  # whose citations are hits
            objections = objections.join(own.select("query_id", F.col("span_id").alias("citation")).distinct(), ["query_id", "citation"], "left_semi")
        objections = stored(objections.withColumn("round", F.lit(index)))
        now = objections.groupBy("query_id").agg(F.sort_array(F.collect_list(F.concat_ws("|", "citation", "excerpt", "rel"))).alias("raised"))
        last = None if before is None else before.groupBy("query_id").agg(F.sort_array(F.collect_list(F.concat_ws("|", "citation", "excerpt", "rel"))).alias("last"))
        state = active.select("query_id").join(now, "query_id", "left")
        state = state.join(last, "query_id", "left") if last is not None else state.withColumn("last", F.lit(None).cast("array<string>"))
        state = stored(state.select("query_id", F.col("raised").isNull().alias("converged"), F.coalesce(F.col("raised") == F.col("last"), F.lit(False)).alias("stalled")))
        rounds.append(said.join(state, "query_id").withColumn("round", F.lit(index)))
        if events:
            checks = aligned.groupBy("query_id").agg(F.count("*").alias("claims"), F.count_if("anchored").alias("anchored"))
            counts = state.join(checks, "query_id", "left").join(objections.groupBy("query_id").agg(F.count("*").alias("objections")), "query_id", "left").fillna(0, ["claims", "anchored", "objections"])
            emit(event_rows("debate.round", counts.withColumn("round", F.lit(index)), "round", "claims", "anchored", "objections", "converged", "stalled"))
        claims.append(aligned)
        raised.append(objections)
        active = stored(active.join(state.filter("converged or stalled"), "query_id", "left_anti"))
        before = objections
        if index + 1 == d.max_rounds or active.isEmpty():
            break
        if d.gap_retrieval:
            gap = Window.partitionBy("query_id").orderBy("claim_ix")
            open_ = aligned.filter("not anchored").join(active.select("query_id"), "query_id", "left_semi").withColumn("n", F.row_number().over(gap)).filter("n <= 2")
            asked = stored(open_.select(F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("n").cast("string")).alias("gap_id"), "query_id", "n", F.col("claim").alias("text")))
            if not asked.isEmpty():
                more, _ = retrieve(corpus, asked.select(F.col("gap_id").alias("query_id"), "text"), settings)
                more = more.select(F.col("query_id").alias("gap_id"), "rk", "span_id", "text").join(asked.select("gap_id", "query_id", "n"), "gap_id")
                once = F.row_number().over(Window.partitionBy("query_id", "span_id").orderBy("n", "rk"))
                new = more.withColumn("once", once).filter("once = 1").join(hits, ["query_id", "span_id"], "left_anti")
                ends = hits.groupBy("query_id").agg(F.max("rk").alias("end"))
                place = F.row_number().over(Window.partitionBy("query_id").orderBy("n", "rk"))
                new = new.withColumn("place", place).join(ends, "query_id").select("query_id", (F.col("end") + F.col("place")).alias("rk"), "span_id", "text")
                hits = stored(hits.unionByName(new))
    every = stored(reduce(DataFrame.unionByName, rounds))
    final = every.groupBy("query_id").agg(F.max("round").alias("round"), F.max_by("converged", "round").alias("converged"))
    last = reduce(DataFrame.unionByName, claims).join(final.select("query_id", "round"), ["query_id", "round"], "left_semi")
    kept = stored(evidence.gate_apply(last, settings.evidence))
    spans = every.select(F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("round").cast("string")).alias("span_id"), F.col("proposal").alias("text"), "query_id", "round")
    turns = roles.deltas(corpus.dense.embed(spans).join(spans.select("span_id", "query_id", "round"), "span_id"), lambda a, b: 1 - V.cosine(a, b))
    report = evidence.gate_report(last, settings.evidence).select("query_id", "total", "anchored")
    answers = (
        final.join(roles.synthesize(kept), "query_id", "left").join(report, "query_id", "left").join(roles.stability(turns), "query_id", "left")
        .join(hits.groupBy("query_id").agg(F.count("*").alias("evidence_spans")), "query_id", "left").join(signals, "query_id", "left")
    )
    faithful = F.round(F.coalesce(F.col("anchored") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6)
    answers = answers.select(
        "query_id", F.coalesce("answer", F.lit("")).alias("answer"), "converged", (F.col("round") + 1).alias("rounds"), "stability", F.coalesce("total", F.lit(0)).alias("claims_total"),
        F.coalesce("anchored", F.lit(0)).alias("claims_anchored"), faithful.alias("faithfulness"), F.coalesce("evidence_spans", F.lit(0)).alias("evidence_spans"), "entropy", "margin", "lexical", "w_dense", "w_sparse",
    )
    answers = stored(answers)
    emit(event_rows("debate.done", answers, "rounds", "converged", "claims_total", "claims_anchored", "faithfulness", "evidence_spans"))
    return {"answers": answers, "rounds": every, "claims": kept, "hits": hits, "objections": reduce(DataFrame.unionByName, raised)}
