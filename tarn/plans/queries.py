"""The named queries of the evidence engine: name -> (spark, sf_dir) -> DataFrame.

Every query reads whole tables. `benchmark` is the batch of queries, `documents` the corpus
(one span a document, so that SQL can state the same), `conversations` the sessions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Memory, Settings
from ..functions import text as T
from ..functions import vector as V
from ..operators import ask, blockmax, bounds, cases, chunking, debate, evaluate, evidence, fusion, memory, reason, rerank, roles, search, segments
from ..sources import corpora
from ..sources.scratch import folder, spread, stored
from ..streaming import answers, events, sinks, trace
from ..streaming import memory as live

SETTINGS = Settings()
POOL = SETTINGS.retrieval.candidate_pool
#: The given vectors are nearly orthogonal, so their clusters need a lower threshold than texts.
VECTOR_MEMORY = Memory(cluster_threshold=0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("span_id"), F.coalesce("text", F.lit("")).alias("text")))


def asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- text ------------------------------------------------------------------


def token_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_unique"))


def llm_token_stats(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", T.plain_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_unique"))


def normalize_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", T.normalize(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("md5"))


def hard_windows(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.hard_windows(F.coalesce("text", F.lit("")), 480, 80)).alias("ix", "w"))
    return t.select("doc_id", "ix", F.length("w").alias("n_chars"), F.md5("w").alias("md5"))


def chunk_documents(spark, sf_dir):
    c = chunking.chunk(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return c.select("doc_id", "ord", "span_id", "start", "stop", F.md5("text").alias("md5"))


def sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("ix", "s"))
    return s.select("doc_id", "ix", F.md5("s").alias("md5"))


def claims(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    return evidence.extract_claims(said).select("query_id", "claim_ix", F.md5("claim").alias("md5"))


# --- search ----------------------------------------------------------------


def term_df_idf(spark, sf_dir):
    return search.build_bm25(spans(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def corpus_stats(spark, sf_dir):
    return search.build_bm25(spans(spark, sf_dir)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, sf_dir, k=POOL):
    return search.bm25_search(search.build_bm25(spans(spark, sf_dir)), asked(spark, sf_dir), k)


def _overlap(spark, sf_dir, k=POOL):
    return search.overlap_search(spans(spark, sf_dir), asked(spark, sf_dir), k)


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "span_id", "score", "rk")


def bm25_blockmax(spark, sf_dir):
    index = search.build_bm25(spans(spark, sf_dir))
    return blockmax.search_blocks(blockmax.build(index), asked(spark, sf_dir), POOL)[0].select("query_id", "span_id", "score", "rk")


def _segments(spark, sf_dir):
    """The corpus in two batches."""
    index, rows = segments.Segments(spark, f"{folder(spark)}/segments-{uuid.uuid4().hex}"), spans(spark, sf_dir)
    for part in (0, 1):
        index.append(rows.filter(F.pmod("span_id", F.lit(2)) == part))
    return index


def bm25_two_batches(spark, sf_dir):
    return search.bm25_search(_segments(spark, sf_dir).bm25(), asked(spark, sf_dir), POOL).select("query_id", "span_id", "score", "rk")


def retrieve_two_batches(spark, sf_dir):
    return debate.retrieve(_segments(spark, sf_dir).open(SETTINGS), asked(spark, sf_dir), SETTINGS)[0].drop("text")


def catalog_lookup(spark, sf_dir):
    """Spans by id: those that the queries of the batch name by number."""
    found = _segments(spark, sf_dir).find(asked(spark, sf_dir).select(F.col("query_id").alias("span_id")))
    return found.select("span_id", F.md5("text").alias("md5"))


def overlap_topk(spark, sf_dir):
    return _overlap(spark, sf_dir).select("query_id", "span_id", "score", "rk")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("span_id"), F.col("embedding").alias("v"))


def dense_topk(spark, sf_dir):
    """The stated queries are every hundredth vector, against all."""
    v = spread(_vectors(spark, sf_dir))
    return search.dense_search(v, v.filter("span_id % 100 = 0").withColumnRenamed("span_id", "query_id"), 10).select("query_id", "span_id", "score", "rk")


def dense_bounded(spark, sf_dir):
    """dense_topk by blocks that bounds leave open."""
    v = _vectors(spark, sf_dir)
    return bounds.search_bounded(v, v.filter("span_id % 100 = 0").withColumnRenamed("span_id", "query_id"), 10)[0].select("query_id", "span_id", "score", "rk")


def vector_norms(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.select(F.col("span_id").alias("vec_id"), F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(V.norm(V.l2_normalize(F.col("v"))), 6).alias("unit"))


def feature_counts(spark, sf_dir):
    return search.features(spans(spark, sf_dir)).groupBy("span_id").agg(F.count("*").alias("n_distinct"), F.sum("tf").alias("n_features"), F.max("tf").alias("max_tf"))


def hash_vectors(spark, sf_dir):
    s = spans(spark, sf_dir)
    counted = stored(search.features(s))
    sparse = search.hash_vectors(counted, search.feature_idf(counted, s), s.agg(F.count("*").alias("n")), SETTINGS.retrieval.dim)
    return sparse.select("span_id", "idx", F.round("w", 6).alias("w"))


def hash_dense_topk(spark, sf_dir):
    index = search.build_hash_index(spans(spark, sf_dir), SETTINGS.retrieval.dim)
    return search.vector_search(index, asked(spark, sf_dir), POOL).select("query_id", "span_id", "score", "rk")


# --- fusion and rerank -----------------------------------------------------


def entropy_signal(spark, sf_dir):
    return fusion.entropy(_bm25(spark, sf_dir))


def margin_signal(spark, sf_dir):
    return fusion.margin(_overlap(spark, sf_dir))


def lexical_signal(spark, sf_dir):
    near = stored(_overlap(spark, sf_dir))
    return fusion.lexical(asked(spark, sf_dir), near, search.found_sets(spans(spark, sf_dir), near))


def _pools(spark, sf_dir):
    rows, queries = spans(spark, sf_dir), asked(spark, sf_dir)
    blocks = search.scans.keep(search.keys.blocks(rows))  # read by three scans
    return stored(search.overlap_search(rows, queries, POOL, blocks)), stored(search.bm25_search(search.build_bm25(rows, blocks), queries, POOL))


def _sets(spark, sf_dir, near, sparse):
    return stored(search.found_sets(spans(spark, sf_dir), near, sparse))


def _weights(spark, sf_dir, near, sparse, sets=None):
    return fusion.adaptive_weights(asked(spark, sf_dir), near, sparse, sets or _sets(spark, sf_dir, near, sparse))


def adaptive_weights(spark, sf_dir):
    return _weights(spark, sf_dir, *_pools(spark, sf_dir))


def rrf_fixed(spark, sf_dir):
    return fusion.weighted_rrf(*_pools(spark, sf_dir), top=POOL)


def rrf_adaptive(spark, sf_dir):
    near, sparse = _pools(spark, sf_dir)
    return fusion.weighted_rrf(near, sparse, _weights(spark, sf_dir, near, sparse), top=POOL)


def _scored(spark, sf_dir):
    near, sparse = _pools(spark, sf_dir)
    sets = _sets(spark, sf_dir, near, sparse)
    fused = stored(fusion.weighted_rrf(near, sparse, _weights(spark, sf_dir, near, sparse, sets), top=POOL))
    return rerank.overlap_scores(asked(spark, sf_dir), fused, sets)


def rerank_overlap(spark, sf_dir):
    return _scored(spark, sf_dir).select("query_id", "span_id", "rk", F.round("raw", 6).alias("raw"))


def z_scores(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.select("o_orderkey", F.round(rerank.z_score("o_totalprice", "o_custkey"), 6).alias("z"))


def _hits(spark, sf_dir):
    ranked = stored(rerank.calibrated_rerank(_scored(spark, sf_dir), SETTINGS.rerank))
    return ranked.join(search.picked(spans(spark, sf_dir), ranked), "span_id")


def calibrated_rerank(spark, sf_dir):
    return rerank.calibrated_rerank(_scored(spark, sf_dir), SETTINGS.rerank)


def retrieve(spark, sf_dir):
    corpus = debate.build(spans(spark, sf_dir), SETTINGS)
    hits, _ = debate.retrieve(corpus, asked(spark, sf_dir), SETTINGS)
    return hits.drop("text")


def _given(spark, sf_dir):
    """An embedder that looks the given vectors up by id; what has none has no vector."""
    return lambda rows: rows.select("span_id").join(_vectors(spark, sf_dir), "span_id")


def retrieve_given_vectors(spark, sf_dir):
    corpus = debate.build(spans(spark, sf_dir), SETTINGS, embed=_given(spark, sf_dir))
    return debate.retrieve(corpus, asked(spark, sf_dir), SETTINGS)[0].drop("text")


def retrieve_listwise(spark, sf_dir):
    """The given vectors again, reranked by a scorer that sees a query's whole list."""
    corpus = debate.build(spans(spark, sf_dir), SETTINGS, embed=_given(spark, sf_dir))
    return debate.retrieve(corpus, asked(spark, sf_dir), SETTINGS, scorer=rerank.by_scarcity)[0].drop("text")


def _isolated(spark, sf_dir):
    """Each conversation is a case: what is said after its first turn is the corpus, the first turn is asked."""
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    queries = talk.filter("turn = 0").select("case_id", F.col("case_id").alias("query_id"), "text")
    own = talk.filter("turn > 0").select("case_id", (F.col("case_id") * 1000 + F.col("turn")).alias("span_id"), "text")
    return queries, cases.retrieve(cases.build(spread(own), SETTINGS), queries, SETTINGS)


def retrieve_isolated(spark, sf_dir):
    return _isolated(spark, sf_dir)[1].drop("text")


def benchmark_isolated(spark, sf_dir):
    queries, hits = _isolated(spark, sf_dir)
    queries, hits = queries.drop("case_id"), stored(hits.select("query_id", "rk", "span_id", "text"))
    return evaluate.cases(_measured(queries, hits, _answers(queries, hits)))


# --- evidence and roles ----------------------------------------------------


def _first_round(spark, sf_dir):
    hits = stored(_hits(spark, sf_dir).select("query_id", "rk", "span_id", "text"))
    lines = stored(roles.bodies(hits))
    said = stored(roles.propose(asked(spark, sf_dir), lines, SETTINGS.debate))
    return hits, lines, said


def _aligned(spark, sf_dir):
    hits, lines, said = _first_round(spark, sf_dir)
    return stored(evidence.align(evidence.extract_claims(said.withColumnRenamed("proposal", "text")), hits, SETTINGS.evidence))


def evidence_block(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("span_id"), F.col("source").alias("title"))
    return roles.evidence_block(_hits(spark, sf_dir).join(docs, "span_id")).select("query_id", F.md5("block").alias("md5"))


def overlap_pairs(spark, sf_dir):
    """Similarities of each query with its retrieved spans."""
    pairs = _hits(spark, sf_dir).select("query_id", "span_id", F.col("text").alias("span")).join(asked(spark, sf_dir), "query_id")
    sets = pairs.select("query_id", "span_id", T.token_set(F.col("text")).alias("a"), T.token_set(F.col("span")).alias("b"), T.plain_set(F.col("text")).alias("pa"), T.plain_set(F.col("span")).alias("pb"))
    a, b, pa_, pb = F.col("a"), F.col("b"), F.col("pa"), F.col("pb")
    return sets.select(
        "query_id", "span_id", *(F.round(c, 6).alias(n) for n, c in (
            ("coverage", T.coverage(a, b)), ("jaccard", T.jaccard(a, b)), ("align", T.align_score(a, b)), ("set_cosine", T.set_cosine(a, b)),
            ("plain_overlap", T.jaccard(pa_, pb)), ("plain_coverage", T.coverage(pa_, pb)),
        )),
    )


def propose(spark, sf_dir):
    return _first_round(spark, sf_dir)[2].select("query_id", F.md5("proposal").alias("md5"))


def align_claims(spark, sf_dir):
    return _aligned(spark, sf_dir).select("query_id", "claim_ix", F.md5("claim").alias("claim_md5"), "verdict", "evidence", "support", "anchored")


def _talk_aligned(spark, sf_dir, heard="role = 'user' or query_id % 2 = 0"):
    """What assistants claim, against what users of the same conversation say; in every other conversation
    the assistant's own turns count as evidence too, so that some gates pass and some do not. `heard`: the
    turns that are evidence."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role", "text")
    told = c.filter("role = 'assistant'").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("x"))
    hits = c.filter(heard).select("query_id", F.col("turn").alias("rk"), F.col("turn").alias("span_id"), "text")
    return evidence.align(evidence.extract_claims(told.select("query_id", F.array_join("x.text", "\n").alias("text"))), hits, SETTINGS.evidence)


def gate_report(spark, sf_dir):
    return evidence.gate_report(_talk_aligned(spark, sf_dir))


def gate_prune(spark, sf_dir):
    return evidence.gate_apply(_talk_aligned(spark, sf_dir)).select("query_id", "claim_ix", "evidence", "support")


def gate_enforce(spark, sf_dir):
    return evidence.gate_enforce(_talk_aligned(spark, sf_dir)).select("query_id", "ratio")


def unanchored(spark, sf_dir):
    """Claims without evidence: of the batch's proposals in the spans found for them, of assistants in what the users
    of the same conversation say (query_id is the conversation). No assistant's turn is evidence of itself."""
    said = {"proposer": _aligned(spark, sf_dir), "assistant": _talk_aligned(spark, sf_dir, "role = 'user'")}
    proposed, told = (evidence.unanchored(a).select(F.lit(who).alias("said_by"), "query_id", "claim_ix", "support") for who, a in said.items())
    return proposed.unionByName(told)


def factcheck(spark, sf_dir):
    hits, lines, said = _first_round(spark, sf_dir)
    return roles.fact_check(evidence.extract_claims(said.withColumnRenamed("proposal", "text")), lines)


def critique(spark, sf_dir):
    hits, lines, said = _first_round(spark, sf_dir)
    return roles.critique(asked(spark, sf_dir), said, lines, SETTINGS.debate).select("query_id", "obj_ix", "citation", F.md5("excerpt").alias("excerpt_md5"), "rel")


def revise(spark, sf_dir):
    hits, lines, said = _first_round(spark, sf_dir)
    raised = roles.critique(asked(spark, sf_dir), said, lines, SETTINGS.debate)
    return roles.revise(said, lines, raised).select("query_id", F.md5("proposal").alias("md5"))


def synthesize(spark, sf_dir):
    return roles.synthesize(evidence.gate_apply(_aligned(spark, sf_dir))).select("query_id", F.md5("answer").alias("md5"))


def _talk_lines(spark, sf_dir, *forms):
    """Lines that a critic or checker may give, one a turn of a conversation: the turn's length
    picks the form, its text stands in the line; some forms are malformed."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("line_no"), "role", "text")
    kind = F.pmod(F.length("text"), F.lit(len(forms)))
    line = F.coalesce(*(F.when(kind == i, F.expr(form)) for i, form in enumerate(forms)))
    return c.select("query_id", "line_no", line.alias("line"))


#: Forms of lines as SQL expressions that both engines read, over line_no, role and text.
OBJECTIONS = (
    "concat('  OBJECTION | span::', line_no, ' , span::', line_no + 2, ', note | ', text)", "concat('OBJECTION|', text)", "concat('OBJECTION | span::x,span::', line_no, '|', replace(text, '. ', ' | '))", "text",
    "'OBJECTION'", "concat('objection | span::', line_no, ' | ', text)", "concat('OBJECTION | | ', text, ' | ')",
)
VERDICTS = (
    "concat('CLAIM ', line_no % 3, ' | supported | span::', line_no, ' | ', text)", "concat(' claim ', line_no % 3, '|', role, ' |  None ')", "concat('CLAIM x | SUPPORTED | ', text)",
    "concat('CLAIM ', line_no, ' | ', text)", "text", "concat('Claim  +', line_no % 5, ' of ', role, ' | unsupported | ', text)",
)


def parse_objections(spark, sf_dir):
    return roles.parse_objections(_talk_lines(spark, sf_dir, *OBJECTIONS)).select("query_id", "line_no", F.array_join("citations", ",").alias("citations"), "reason")


def filter_valid(spark, sf_dir):
    """Known are the turns of users."""
    raised = roles.parse_objections(_talk_lines(spark, sf_dir, *OBJECTIONS)).withColumnRenamed("line_no", "obj_ix")
    known = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("query_id"), F.concat(F.lit("span::"), F.col("turn").cast("string")).alias("citation"))
    return roles.filter_valid(raised, known).select("query_id", "obj_ix", F.array_join("citations", ",").alias("citations"), "reason")


def parse_verdicts(spark, sf_dir):
    return roles.parse_verdicts(_talk_lines(spark, sf_dir, *VERDICTS))


def stalled_rounds(spark, sf_dir):
    """Rounds are the turns of conversations; what a turn raises is the letter that its text begins with, citing its length class."""
    c = table(spark, sf_dir, "conversations")
    cited = F.array(F.floor(F.length("text") / 400).cast("string"))
    return roles.stalled(c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("round"), F.lower(F.substring("text", 1, 1)).alias("text"), cited.alias("citations")))


def _turn_deltas(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("round"), F.col("embedding").alias("v"))
    return roles.deltas(v, lambda a, b: 1 - V.cosine(a, b))


def deltas(spark, sf_dir):
    return _turn_deltas(spark, sf_dir).select("query_id", "round", "delta")


def delta_stability(spark, sf_dir):
    return roles.stability(_turn_deltas(spark, sf_dir))


def self_consistency_vote(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return roles.vote(e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("ix"), F.col("event_type").alias("text")))


def _debate(spark, sf_dir):
    return debate.run(debate.build(spans(spark, sf_dir), SETTINGS), asked(spark, sf_dir), SETTINGS)


def _asked_mixed(spark, sf_dir):
    """The batch of queries and the requests that tools answer together; requests have negative ids."""
    tools = _requests(spark, sf_dir).filter(reason.route(F.col("text"))["kind"] != "rag")
    return asked(spark, sf_dir).unionByName(tools.select((-1 - F.col("query_id")).alias("query_id"), "text"))


def ask_all(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return ask.ask(debate.build(spans(spark, sf_dir), SETTINGS), _asked_mixed(spark, sf_dir), F.lit(now), SETTINGS)["answers"]


def health(spark, sf_dir):
    return ask.health(debate.build(spans(spark, sf_dir), SETTINGS), SETTINGS)


def retrieve_chunks(spark, sf_dir):
    """Retrieval over the chunks of documents, whose ids are texts."""
    chunks = chunking.chunk(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    hits, _ = debate.retrieve(debate.build(chunks.select("span_id", "text"), SETTINGS), asked(spark, sf_dir), SETTINGS)
    return hits.drop("text")


def debate_full(spark, sf_dir):
    return _debate(spark, sf_dir)["answers"]


# --- reasoning -------------------------------------------------------------


#: Requests as SQL expressions that both engines read, over the columns of part.
REQUESTS = (
    "concat(p_size, '*(', p_partkey, '+3)')", "concat(p_size, ' km to m')", "concat('what time is it, ', p_name, '?')", "concat('tell me of ', p_name)", "concat(p_partkey + 1, '/', p_size, '等于多少?')",
    "concat('convert ', p_size, '.5 KG -> lb of ', p_name)", "concat(p_size, ' ', p_name, ' to ft')", "concat(p_name, ' 2+', p_size)", "concat(' 7-', p_size, ' = ? ')", "concat(p_partkey, '/0')", "concat(p_size, ' h to parsec')",
)


def _requests(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.pmod(F.col("p_partkey") + F.length("p_name"), F.lit(len(REQUESTS)))
    text = F.coalesce(*(F.when(kind == i, F.expr(form)) for i, form in enumerate(REQUESTS)))
    return p.select(F.col("p_partkey").alias("query_id"), text.alias("text"))


def route_queries(spark, sf_dir):
    r = _requests(spark, sf_dir).withColumn("r", reason.route(F.col("text")))
    return r.select("query_id", F.col("r.kind").alias("kind"), F.col("r.argument").alias("argument"))


def calculator(spark, sf_dir):
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")).select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("*("), F.col("l_partkey").cast("string"), F.lit("+"), F.col("l_suppkey").cast("string"), F.lit(")-7")).alias("x"))
    return li.select("l_orderkey", "l_linenumber", reason.calculate("x").cast("long").alias("value"))


#: A text with marks, as an SQL expression that both engines read.
MARKED = "replace(replace(text, '. ', ' Final Answer: '), ', ', ' 答案：')"
#: A conversion between two of these a part; the last is no unit.
UNIT_NAMES = [*reason.UNITS, "cubit"]


def unit_convert(spark, sf_dir):
    names = F.array(*map(F.lit, UNIT_NAMES))
    unit = lambda c: F.get(names, F.pmod(c, F.lit(len(UNIT_NAMES))).cast("int"))
    text = F.concat(F.col("p_retailprice").cast("string"), F.lit(" "), unit(F.col("p_partkey")), F.lit(" to "), F.upper(unit(F.col("p_size"))))
    p = table(spark, sf_dir, "part").select("p_partkey", text.alias("x"))
    return p.select("p_partkey", F.round(reason.convert_unit(F.col("x")), 6).alias("value"))


def tool_answers(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    return reason.answer_tools(_requests(spark, sf_dir).crossJoin(F.broadcast(now)), F.col("now"))  # one row


def tool_trace(spark, sf_dir):
    return reason.trace(tool_answers(spark, sf_dir))


def final_answers(spark, sf_dir):
    """Marks are set between the sentences of what assistants say."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(MARKED).alias("text"))
    return c.select("conv_id", "turn", F.md5(reason.final_answer(F.col("text"))).alias("md5"))


# --- memory ----------------------------------------------------------------


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "text")


def working_memory(spark, sf_dir):
    return memory.working(_turns(spark, sf_dir)).select("session_id", "slot", "seq", F.md5("text").alias("md5"))


def _episodes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("episode_id"), F.col("vec_id").alias("seq"), F.lit(1.0).alias("salience"),
        F.timestamp_seconds(F.lit(1_700_000_000) - F.pmod("vec_id", F.lit(97)) * 3600).alias("created"), F.concat(F.lit("fact "), F.pmod("vec_id", F.lit(40)).cast("string")).alias("text"), F.col("embedding").alias("v"),
    )


def memory_recall(spark, sf_dir):
    """The stated queries are every hundredth vector, each against its session."""
    e = _episodes(spark, sf_dir)
    q = e.filter("episode_id % 100 = 0").select(F.col("episode_id").alias("query_id"), "session_id", "v")
    return memory.recall(e.drop("seq", "text"), q, F.timestamp_seconds(F.lit(1_700_000_000)))


def memory_forget(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.select(F.col("event_id").alias("episode_id"), (F.col("value") / 100).alias("salience"), F.col("ts").alias("created")).crossJoin(F.broadcast(now))  # one row
    return memory.forget(rows, F.col("now")).select("episode_id", "strength")


def memory_distill(spark, sf_dir):
    return memory.distill(_episodes(spark, sf_dir), config=VECTOR_MEMORY).select("session_id", "seq", "support")


def semantic_recall(spark, sf_dir):
    facts = stored(memory.distill(_episodes(spark, sf_dir), config=VECTOR_MEMORY))
    e = _episodes(spark, sf_dir)
    v = facts.select("session_id", "seq").join(e.select("session_id", "seq", "v"), ["session_id", "seq"]).select(F.col("seq").alias("span_id"), "v")
    return search.dense_search(v, e.filter("episode_id % 100 = 0").select(F.col("episode_id").alias("query_id"), "v"), 3).select("query_id", "span_id", "score", "rk")


def memory_stats(spark, sf_dir):
    t = _turns(spark, sf_dir)
    facts = memory.remembered(t).groupBy("session_id", "text").agg(F.count("*").alias("support")).filter("support >= 2")
    return memory.stats(t, facts)


# --- evaluation ------------------------------------------------------------


def _case(spark, sf_dir):
    q, hits = asked(spark, sf_dir), stored(_hits(spark, sf_dir).select("query_id", "rk", "span_id", "text"))
    return q, hits, _answers(q, hits)


def _answers(q, hits):
    """query_id, answer of one round over the hits."""
    said = stored(roles.propose(q, stored(roles.bodies(hits)), SETTINGS.debate))
    aligned = evidence.align(evidence.extract_claims(said.withColumnRenamed("proposal", "text")), hits, SETTINGS.evidence)
    answers = q.select("query_id").join(roles.synthesize(evidence.gate_apply(aligned)), "query_id", "left")
    return stored(answers.select("query_id", F.coalesce("answer", F.lit("")).alias("answer")))


def _gold(q):
    """Two spans that should be found for each query: its own text, and that of the next query, which need not be."""
    own = q.select("query_id", F.lit(0).alias("ix"), "text", F.col("text").alias("answer"))
    return own.unionByName(q.select((F.col("query_id") - 1).alias("query_id"), F.lit(1).alias("ix"), "text", F.col("text").alias("answer")).join(q.select("query_id"), "query_id", "left_semi"))


def _keywords(q):
    return q.select("query_id", F.explode(T.token_set(F.col("text"))).alias("keyword"))


def faithfulness(spark, sf_dir):
    q, hits, answers = _case(spark, sf_dir)
    return evaluate.faithfulness(answers, hits)


def context_precision(spark, sf_dir):
    q, hits, answers = _case(spark, sf_dir)
    return evaluate.context_precision(hits, _gold(q).filter("ix = 0"))


def context_recall(spark, sf_dir):
    q, hits, answers = _case(spark, sf_dir)
    return evaluate.context_recall(hits, _gold(q), q)


def keyword_recall(spark, sf_dir):
    q, hits, answers = _case(spark, sf_dir)
    return evaluate.keyword_recall(answers, _keywords(q))


def _metrics(spark, sf_dir):
    return _measured(*_case(spark, sf_dir))


def _measured(q, hits, answers):
    m = evaluate.faithfulness(answers, hits).join(evaluate.context_precision(hits, _gold(q).filter("ix = 0")), "query_id")
    return stored(m.join(evaluate.context_recall(hits, _gold(q), q), "query_id").join(evaluate.keyword_recall(answers, _keywords(q)), "query_id"))


def benchmark_cases(spark, sf_dir):
    return evaluate.cases(_metrics(spark, sf_dir))


def benchmark_report(spark, sf_dir):
    return evaluate.report(_metrics(spark, sf_dir))


def answer_relevancy(spark, sf_dir):
    q, hits, answers = _case(spark, sf_dir)
    index = search.build_hash_index(spans(spark, sf_dir), SETTINGS.retrieval.dim)
    said = evaluate.answer_sentences(answers).select(F.concat_ws("-", "query_id", "ix").alias("span_id"), "query_id", F.col("sentence").alias("text"))
    v = index.embed(said).join(said.select("span_id", "query_id"), "span_id")
    return evaluate.answer_relevancy(search.embed_queries(index, q), v, answers)


# --- sources, sinks, traces ------------------------------------------------


def trace_tail(spark, sf_dir):
    return trace.tail(table(spark, sf_dir, "events")).select("event_id", "event_type", "value")


def trace_by_event(spark, sf_dir):
    return trace.counts(table(spark, sf_dir, "events"))


def json_sink(spark, sf_dir):
    n = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return corpora.as_json(n, "o_orderkey")


def _files(spark, rows, how, **options):
    path = f"{folder(spark)}/files-{uuid.uuid4().hex}"
    getattr(rows.write.options(**options), how)(path)
    return path


def claim_records(spark, sf_dir):
    return corpora.records(_talk_aligned(spark, sf_dir).drop("support"), "claim")


def hit_records(spark, sf_dir):
    return corpora.records(_overlap(spark, sf_dir).select("query_id", "span_id", "rk"), "hit")


#: A text of words and CJK runs (Ext-A and symbols between), as an SQL expression that both engines read.
CJK_MIXED = "concat(p_name, '电池续航', p_size, '小时。屏幕㐀亮 x', p_brand, '的')"


def cjk_tokens(spark, sf_dir):
    """Tokens of mixed text: words first, then each CJK run as characters and pairs of characters."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(CJK_MIXED).alias("x"))
    return p.select("p_partkey", F.array_join(T.tokens(F.col("x")), "|").alias("tokens"), F.array_join(T.plain_tokens(F.col("x")), "|").alias("plain"))


def health_memory(spark, sf_dir):
    return ask.health(debate.build(spans(spark, sf_dir), SETTINGS), SETTINGS, memory_stats(spark, sf_dir))


def read_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    path = _files(spark, docs.select(F.concat(F.col("text"), F.lit("\n\n")).alias("value")), "text")
    return corpora.read_text(spark, path).select(F.md5("text").alias("md5"))


def read_jsonl(spark, sf_dir):
    path = _files(spark, table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text"), "json")
    return corpora.read_lines(spark, path, parsed=True).select(F.md5("text").alias("md5"))


def read_json(spark, sf_dir):
    # a file is one array of a bounded number of rows
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text").withColumn("part", F.expr("monotonically_increasing_id() div 1000"))
    arrays = rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("item_id", "text"))).alias("value")).select("value")
    path = _files(spark, arrays, "text", maxRecordsPerFile=1)
    return corpora.read_json(spark, path).select(F.md5("text").alias("md5"))


def document_titles(spark, sf_dir):
    return corpora.documents(table(spark, sf_dir, "documents")).select("doc_id", "title")


def trace_stream(spark, sf_dir):
    """Batches update the windows that they touch; the last value of a window counts."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    base = _files(spark, events.repartitionByRange(3, "ts"), "parquet")
    counts = trace.stream(spark, base, events.schema)
    sinks.run_available(counts, sinks.batches_to(f"{base}-out"), f"{base}-state")
    found = sinks.read_batches(spark, f"{base}-out", counts.schema)
    return found.groupBy("start", "event").agg(F.max_by("n", "batch").alias("n"))


def working_memory_stream(spark, sf_dir):
    """Turns arrive in two goes, the later turns first; the second go starts from the checkpoint of the first."""
    turns, half = _turns(spark, sf_dir), F.pmod("seq", F.lit(2)) == 0
    base = f"{folder(spark)}/turns-{uuid.uuid4().hex}"
    live.with_state(spark)
    for go in (~half, half):
        turns.filter(go).write.mode("append").parquet(base)
        windows = live.working_window(spark.readStream.schema(turns.schema).parquet(base))
        sinks.run_available(windows, sinks.batches_to(f"{base}-out"), f"{base}-state")
    found = live.latest(sinks.read_batches(spark, f"{base}-out", windows.schema))
    return found.select("session_id", "slot", "seq", F.md5("text").alias("md5"))


def memory_forget_stream(spark, sf_dir):
    """What the state of the stream still holds at the last watermark. Sessions are users, events arrive in order of
    time, in three batches."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("episode_id"), (F.col("value") / 100).alias("salience"), F.col("ts").cast("timestamp").alias("created"))
    base = _files(spark, events.repartitionByRange(3, "created"), "parquet")
    live.with_state(spark)
    episodes = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(base)
    sinks.run_available(live.forgetting(episodes), sinks.batches_to(f"{base}-out"), f"{base}-state")
    now = events.agg(F.max("created").alias("now"))
    return memory.forget(live.remembered_state(spark, f"{base}-state").crossJoin(F.broadcast(now)), F.col("now")).select("episode_id", "strength")  # one row


def _answered(spark, sf_dir, files=3):
    corpus, base = debate.build(spans(spark, sf_dir), SETTINGS), f"{folder(spark)}/asked-{uuid.uuid4().hex}"
    asked(spark, sf_dir).repartition(files, "query_id").write.parquet(base)
    queries = spark.readStream.schema("query_id long, text string").option("maxFilesPerTrigger", 1).parquet(base)
    answers.answer_stream(corpus, queries, f"{base}-out", f"{base}-state", SETTINGS)
    return spark.read.schema("query_id long, seq int, kind string, payload string, batch long").parquet(f"{base}-out")


def answer_stream(spark, sf_dir):
    """Messages of all queries, which arrive in files, a batch each."""
    return _answered(spark, sf_dir).select("query_id", "seq", "kind", F.md5("payload").alias("md5"))


def debate_events(spark, sf_dir):
    """Events of a debate over all queries, by name, as an observer has counted them."""
    log = events.EventLog(f"{folder(spark)}/events-{uuid.uuid4().hex}")
    debate.run(debate.build(spans(spark, sf_dir), SETTINGS), asked(spark, sf_dir), SETTINGS, events=log)
    count = sinks.batches_to(f"{log.path}-out", lambda rows: rows.groupBy("event").agg(F.count("*").alias("n")))
    events.observe(log.stream(spark), {"*": count}, f"{log.path}-ledger", f"{log.path}-state")
    return spark.read.schema("event string, n long, batch long").parquet(f"{log.path}-out").groupBy("event").agg(F.sum("n").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        retrieve, retrieve_chunks, token_stats, llm_token_stats, normalize_text, hard_windows, chunk_documents, sentences, claims, term_df_idf, corpus_stats, bm25_topk, overlap_topk,
        dense_topk, vector_norms, feature_counts, hash_vectors, hash_dense_topk, entropy_signal, margin_signal, lexical_signal, adaptive_weights, rrf_fixed, rrf_adaptive,
        rerank_overlap, z_scores, calibrated_rerank, evidence_block, overlap_pairs, propose, align_claims, gate_report, gate_prune, gate_enforce, unanchored, factcheck,
        critique, revise, synthesize, parse_objections, filter_valid, parse_verdicts, stalled_rounds, deltas, delta_stability, self_consistency_vote, debate_full, ask_all, health, route_queries,
        calculator, unit_convert, tool_answers, tool_trace, final_answers, working_memory, memory_recall, memory_forget, memory_distill, semantic_recall, memory_stats, faithfulness, context_precision,
        context_recall, keyword_recall, answer_relevancy, benchmark_cases, benchmark_report, trace_tail, trace_by_event, json_sink, read_text, read_jsonl, read_json,
        dense_bounded, claim_records, hit_records, cjk_tokens, health_memory, bm25_blockmax, bm25_two_batches, retrieve_two_batches, catalog_lookup, retrieve_given_vectors, retrieve_listwise, retrieve_isolated, benchmark_isolated, document_titles, trace_stream, working_memory_stream, memory_forget_stream, answer_stream, debate_events,
    )
}
