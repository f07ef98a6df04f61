"""Named queries against their SQL on the smallest tables."""

from __future__ import annotations

import datetime as dt
import os

import duckdb
import numpy as np
import pytest

from tarn.plans.oracle import ORACLE
from tarn.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["token_stats", "hard_windows", "sentences", "claims", "bm25_topk", "dense_topk", "feature_counts", "adaptive_weights", "calibrated_rerank", "align_claims", "critique", "gate_report", "gate_prune", "gate_enforce", "unanchored", "trace_stream", "health", "lexical_signal", "parse_objections", "filter_valid", "parse_verdicts", "tool_trace", "final_answers", "unit_convert", "deltas", "route_queries", "calculator", "tool_answers", "memory_recall", "memory_forget", "memory_stats", "hash_vectors", "hash_dense_topk", "retrieve", "answer_relevancy", "json_sink", "benchmark_cases", "read_text", "working_memory_stream", "memory_forget_stream", "bm25_blockmax", "bm25_two_batches", "catalog_lookup", "dense_bounded", "retrieve_given_vectors", "retrieve_listwise", "retrieve_isolated", "benchmark_isolated", "claim_records", "hit_records", "cjk_tokens", "health_memory"]


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}".replace("-0.000000", "0.000000")
    return v.replace(tzinfo=None).isoformat() if isinstance(v, dt.datetime) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_read_json_keeps_every_row(spark):
    got = sorted(r.md5 for r in QUERIES["read_json"](spark, SF).collect())
    assert got == sorted(r[0] for r in duckdb.sql(ORACLE["read_json"].replace("benchmark", f"'{SF}/benchmark.parquet'")).fetchall()) and len(got) > 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted([plain(r[c]) for c in names] for r in df.collect())
    found = con.execute(f"select {', '.join(names)} from ({ORACLE[name]})").fetchall()
    assert got == sorted([plain(v) for v in r] for r in found)
    assert got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_distillation_and_recall_of_all_rows(spark):
    """Every session folded in order; every query's nearest facts."""
    rows = sorted((r.label, r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    clusters = []
    for label, i, v in rows:
        v = v / (np.linalg.norm(v) or 1)
        home = next((c for c in clusters if c[0] == label and round(float(c[2] @ v), 9) >= 0.3), None)
        if home:
            home[3] += 1
        else:
            clusters.append([label, i, v, 1])
    facts, told = [], set()
    for c in clusters:  # one fact a session and text
        if c[3] >= 2 and (c[0], c[1] % 40) not in told:
            told.add((c[0], c[1] % 40))
            facts.append(c)
    assert sorted(map(tuple, QUERIES["memory_distill"](spark, SF).collect())) == sorted((c[0], c[1], c[3]) for c in facts) and facts
    want = []
    for _, q, v in rows:
        if q % 100 == 0:
            near = sorted((-round(float(c[2] @ v) / np.linalg.norm(v), 6), c[1]) for c in facts)[:3]
            want += [(q, i, n + 1) for n, (_, i) in enumerate(near)]
    assert sorted((r.query_id, r.span_id, r.rk) for r in QUERIES["semantic_recall"](spark, SF).collect()) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_ask_splits_by_route(spark):
    """Tools answer what is routed to them, with fixed metrics; every query has one answer."""
    rows = QUERIES["ask_all"](spark, SF).collect()
    tools = {-1 - r.query_id: r for r in rows if r.query_id < 0}
    want = {r.query_id: r for r in QUERIES["tool_answers"](spark, SF).collect() if r.kind != "rag"}
    assert tools.keys() == want.keys() and all(tools[i].answer == (want[i].answer or f"tool error: cannot read {want[i].kind} argument {want[i].argument}") and tools[i].route == want[i].kind for i in want)
    assert all(r.converged and r.rounds == 0 and r.faithfulness == 1.0 for r in rows if r.route != "rag")
    asked = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {r.query_id for r in rows if r.query_id >= 0} == asked and len(rows) == len(asked) + len(want)
    assert sum(r.route == "rag" and r.rounds > 0 for r in rows) > len(asked) / 2


def test_unanchored_claims_of_all_conversations_and_of_the_batch(spark, tmp_path):
    """No conversation is left out by its id, an assistant's turn is no evidence of itself, and proposals without a hit count."""
    said = "Solar panels convert sunlight into useful electricity."
    talk = [(i, 0, "user", said if i > 5 else "Tell me about cooking pasta.") for i in (2, 3, 8, 9)] + [(i, 1, "assistant", said) for i in (2, 3, 8, 9)]
    rows = {
        "conversations": (talk, "conv_id long, turn long, role string, text string"),
        "documents": ([(1, "Copper wires carry current over long distances."), (2, "Rivers carry sediment towards the sea.")], "doc_id long, text string"),
        "benchmark": ([(0, "copper wires carry current"), (1, "zebra xylophone quartz")], "item_id long, text string"),
    }
    con = duckdb.connect()
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    columns = ["said_by", "query_id", "claim_ix", "support"]
    got = sorted(map(tuple, QUERIES["unanchored"](spark, str(tmp_path)).select(columns).collect()))
    assert got == sorted(con.execute(f"select {', '.join(columns)} from ({ORACLE['unanchored']})").fetchall())
    assert [r[:2] for r in got] == [("assistant", 2), ("assistant", 3), ("proposer", 1)]


def test_json_lines_of_odd_texts(spark, tmp_path):
    """Blank texts are no texts; marks, controls and letters of any script come back as they were."""
    odd = ["", " \t\n", "\u00a0\u3000", None, "a\r\nb\rc\nd", "\x00\x01\x1f\x7f\x85", "\\n \" \\u0041 / '", "😀 ñ 屏\u2028\u2029\ufeff", " kept ", "{}", "null", "12", "[1]", "\x0b"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.md5 for r in QUERIES["read_jsonl"](spark, str(tmp_path)).collect())
    assert got == sorted(r[0] for r in duckdb.sql(ORACLE["read_jsonl"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()) and len(got) == 9
