from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.config import Memory
from tarn.operators import evaluate, evidence, memory, reason, roles
from tarn.sources import corpora
from tarn.streaming import trace


def test_alignment_and_gate(spark):
    claims = spark.createDataFrame([(1, 0, "the battery lasts ten hours"), (1, 1, "cats fly over mars"), (2, 0, "no hits here")], "query_id long, claim_ix int, claim string")
    hits = spark.createDataFrame([(1, 1, 5, "the battery lasts ten hours on a charge"), (1, 2, 6, "the battery lasts ten hours on a charge")], "query_id long, rk int, span_id long, text string")
    rows = {(r.query_id, r.claim_ix): r for r in evidence.align(claims, hits).collect()}
    assert rows[1, 0].anchored and rows[1, 0].evidence == 5
    assert not rows[1, 1].anchored and rows[2, 0].support == 0.0
    report = {r.query_id: r for r in evidence.gate_report(evidence.align(claims, hits)).collect()}
    assert report[1].ratio == 0.5 and not report[1].passed
    assert evidence.gate_apply(evidence.align(claims, hits)).count() == 1
    assert {r.query_id for r in evidence.gate_enforce(evidence.align(claims, hits)).collect()} == {1, 2}
    with pytest.raises(evidence.GateError, match="2 queries fail the gate; query 2 has 1.0"):
        evidence.require_gate(evidence.align(claims, hits))
    good = evidence.require_gate(evidence.align(claims.filter("query_id = 1 and claim_ix = 0"), hits))
    assert [r.claim for r in good.collect()] == ["the battery lasts ten hours"]


def test_parsers(spark):
    lines = spark.createDataFrame([(1, 0, "OBJECTION | span::a, b | why | more"), (1, 1, "OBJECTION | only reason"), (1, 2, "NO_OBJECTION"), (1, 3, "noise"), (1, 4, "OBJECTION")], "query_id long, line_no long, line string")
    got = [(list(r.citations), r.reason) for r in roles.parse_objections(lines).orderBy("line_no").collect()]
    assert got == [(["span::a"], "why|more"), ([], "only reason")]
    known = spark.createDataFrame([(1, "span::a")], "query_id long, citation string")
    assert roles.filter_valid(roles.parse_objections(lines).withColumnRenamed("line_no", "obj_ix"), known).count() == 1
    verdicts = spark.createDataFrame([(1, 0, "CLAIM 0 | supported | span::a | .5"), (1, 1, "CLAIM 0 | UNSUPPORTED | None"), (1, 2, "CLAIM x | A | b")], "query_id long, line_no long, line string")
    assert [tuple(r) for r in roles.parse_verdicts(verdicts).collect()] == [(1, 0, "UNSUPPORTED", "")]


def test_stalled_vote_delta(spark):
    o = spark.createDataFrame([(1, 0, "a", ["x"]), (1, 1, "a", ["x"]), (1, 2, "b", ["x"])], "query_id long, round int, text string, citations array<string>")
    assert [r.stalled for r in roles.stalled(o).orderBy("round").collect()] == [False, True, False]
    v = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")], "query_id long, ix int, text string")
    assert roles.vote(v).first().text == "b"


@pytest.mark.parametrize(("query", "kind"), [("12*(3+4)", "calculator"), ("3 km to m", "unit"), ("现在几点", "clock"), ("what is love", "rag"), ("1+1等于多少?", "calculator"), ("", "rag")])
def test_route(spark, query, kind):
    assert spark.createDataFrame([(query,)], "q string").select(reason.route(F.col("q"))["kind"].alias("k")).first().k == kind


@pytest.mark.parametrize(("text", "value"), [("12*(3+4)", "84"), ("2^10", "1024"), ("7/2", "3.5"), ("sqrt(16)+1", "5"), ("__import__('os')", None), ("1/0", None), ("", None), ("1,000+1", "1001"), ("9**9**9**9", None), ("-2**2", "-4"), ("2**-1", "0.5"), ("2^3^2", "512"), ("-7//2", "-4"), ("-7%3", "2"), ("2--3", "5"), ("2 3", None), ("(1", None), ("#+1", None), ("007", None), ("1e3*.5", "500"), ("round(2.5)*abs(-3)", "6"), ("min(1,2)", None), ("(1+1", None), ("1_000/3", "333.333"), ("0/0", None), ("1/(1/0)", None), ("x+1", None), ("-" * 5000 + "1", None)])
def test_evaluate(text, value):
    assert reason.evaluate(pd.Series([text])).tolist() == [value]


@given(st.lists(st.tuples(st.integers(-50, 50), st.sampled_from("+-*/"), st.integers(0, 9), st.sampled_from(["+", "-", "*", "//", "%"]), st.integers(0, 9)), min_size=1, max_size=30))
@settings(max_examples=60, deadline=None)
def test_evaluate_batches_as_rows(parts):
    """Rows of one shape are evaluated together and have the value that each has alone."""
    texts = [f"{a}{p}({b}{q}{c})" for a, p, b, q, c in parts]

    def alone(text):
        try:
            return reason.six_digits(float(eval(text)))
        except ZeroDivisionError:
            return None

    assert reason.evaluate(pd.Series(texts)).tolist() == [alone(t) for t in texts]


def test_tools(spark):
    q = spark.createDataFrame([(1, "12 km to m"), (2, "2+3"), (3, "current time"), (4, "hello")], "query_id long, text string")
    got = {r.query_id: r.answer for r in reason.answer_tools(q, F.lit(dt.datetime(2024, 1, 2, 3, 4, 5))).collect()}
    assert got == {1: "12000 m", 2: "5", 3: "2024-01-02 03:04:05", 4: None}


def test_trace_and_final_answer(spark):
    q = spark.createDataFrame([(1, "12 foo to bar"), (2, "7/0"), (3, "2+3"), (4, "hello")], "query_id long, text string")
    got = {r.query_id: (r.tool, r.observation) for r in reason.trace(reason.answer_tools(q, F.lit(dt.datetime(2024, 1, 2)))).collect()}
    assert got == {1: ("unit", "tool error: cannot read unit argument 12 foo to bar"), 2: ("calculator", "tool error: cannot read calculator argument 7/0"), 3: ("calculator", "5")}
    said = ["", None, " plain ", "a 答案：b Final Answer: c Final Answer: d", "x 最终答案： y", "最终"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", reason.final_answer(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r.a for r in rows] == ["", "", "plain", "c Final Answer: d", "y", "最终"]


def test_memory(spark):
    turns = spark.createDataFrame([(1, i, f" t{i} ") for i in range(20)] + [(1, 20, "  ")], "session_id long, seq long, text string")
    assert [r.text for r in memory.working(turns).orderBy("slot").collect()] == [f"t{i}" for i in range(4, 20)]
    rng = np.random.default_rng(5)
    vs = [rng.normal(size=4) for _ in range(60)]
    rows = [(i % 2, i, f"f{i}", v.tolist()) for i, v in enumerate(vs)]
    episodes = spark.createDataFrame(rows, "session_id long, seq long, text string, v array<double>")
    config = Memory(cluster_threshold=0.6)
    want = set()
    for s in (0, 1):
        used = set()
        own = [i for i in range(60) if i % 2 == s]
        for i in own:
            if i in used:
                continue
            cluster = [j for j in own if j >= i and j not in used and (j == i or vs[i] @ vs[j] / np.linalg.norm(vs[i]) / np.linalg.norm(vs[j]) >= 0.6)]
            used |= set(cluster)
            if len(cluster) >= 2:
                want.add((s, i, f"f{i}", len(cluster)))
    facts = memory.distill(episodes, config=config)
    assert {tuple(r) for r in facts.collect()} == want
    assert memory.distill(episodes, facts, config).isEmpty()
    now = F.lit(dt.datetime(2024, 1, 10))
    aged = spark.createDataFrame([(1, 1.0, dt.datetime(2024, 1, 9)), (2, 1.0, dt.datetime(2023, 1, 1))], "episode_id long, salience double, created timestamp")
    assert [r.episode_id for r in memory.forget(aged, now).collect()] == [1]


def test_metrics(spark):
    answers = spark.createDataFrame([(1, "battery lasts long. ok"), (2, "")], "query_id long, answer string")
    hits = spark.createDataFrame([(1, "battery lasts long ok")], "query_id long, text string")
    assert {r.query_id: r.faithfulness for r in evaluate.faithfulness(answers, hits).collect()} == {1: 1.0, 2: 0.0}
    kw = spark.createDataFrame([(1, "battery"), (1, "moon")], "query_id long, keyword string")
    assert {r.query_id: r.keyword_recall for r in evaluate.keyword_recall(answers, kw).collect()} == {1: 0.5, 2: 1.0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n  \n\ntwo\nlines")
    assert [r.text for r in corpora.read_text(spark, str(tmp_path / "a.txt")).orderBy("ix").collect()] == ["one", "two\nlines"]
    (tmp_path / "b.json").write_text('[{"text": "x"}, {"n": 1}]')
    assert {r.text for r in corpora.read_json(spark, str(tmp_path / "b.json")).collect()} == {"x", '{"n":1}'}
    (tmp_path / "c.jsonl").write_text('{"text": "p"}\n\n{"text": "q"}\n')
    assert [r.text for r in corpora.read_lines(spark, str(tmp_path / "c.jsonl")).collect()] == ['{"text": "p"}', '{"text": "q"}']
    assert {r.text for r in corpora.read_lines(spark, str(tmp_path / "c.jsonl"), parsed=True).collect()} == {"p", "q"}


def test_trace(spark):
    e = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "event_id long, event_type string")
    assert sorted(r.event_id for r in trace.tail(e, 3).collect()) == [7, 8, 9]
    assert trace.by_name(e, "a").count() == 5
