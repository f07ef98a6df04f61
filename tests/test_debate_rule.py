"""The whole debate over all queries of the smallest tables, against a plain statement of its rules.

Only retrieval is taken from the engine (it is held against SQL elsewhere); everything that follows
is stated here over Python sets and strings, query by query.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import debate, reason, roles
from tarn.plans import queries as Q
from tests.test_text import tokens

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def words(text):
    return set(re.findall(T.PLAIN_TOKEN, text.lower()))


def shared(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def support(claim, span):
    a, b = set(tokens(claim)), set(tokens(span))
    return 0.6 * len(a & b) / len(a) + 0.4 * shared(a, b) if a and b else 0.0


def assertions(text):
    parts = [p.strip() for p in re.split("(?<=[。！？!?；;\n])", text)]
    body = {p: re.sub(T.BULLET, "", p).strip() for p in parts}
    wordless = rf"^\s*(?:{'|'.join(T.CONNECTIVES)})\s*[,，]?\s*$"
    return [p for p in parts if len(body[p]) >= 4 and body[p][-1] not in "？?" and not body[p].startswith(T.HEDGES) and not re.search(wordless, body[p])]


class Case:
    """One query's debate."""

    def __init__(self, query, hits):
        self.query, self.hits, self.rounds, self.raised, self.claims = query, list(hits), [], [], []
        self.open = True

    def lines(self):
        """(span or None, line) of all hits in order."""
        return [(span if i == 0 else None, x) for span, text in self.hits for i, x in enumerate(y for y in map(str.strip, text.strip().split("\n")) if y)]

    def by_relevance(self):
        ask = words(self.query)
        return sorted(((shared(ask, words(x)), i, s, x) for i, (s, x) in enumerate(self.lines())), key=lambda r: (-r[0], r[1]))

    def say(self):
        best = [x for rel, _, _, x in self.by_relevance()[:3] if rel > 0]
        first = [x for _, x in self.lines()[:1]]
        said = " ".join(best or first) if self.lines() else roles.NO_EVIDENCE
        if self.raised:
            cited = {c for c, _, _ in self.raised[-1]}
            said = " ".join([said, *[x for s, x in self.lines() if s in cited and x not in said][:3]])
        return said.strip()

    def judge(self, claim):
        best, span = max(((support(claim, text), -i, s) for i, (s, text) in enumerate(self.hits)), default=(0, 0, None), key=lambda r: r[:2])[::2]
        checked, seen = max(((shared(words(claim), words(x)), -i, s) for i, (s, x) in enumerate(self.lines())), default=(0, 0, None), key=lambda r: r[:2])[::2]
        backed = best >= 0.30
        evidence = seen if backed and checked >= 0.30 and seen is not None else span if backed else None
        return claim, "supported" if backed else "unsupported", evidence, round(best, 6)

    def object(self, said):
        ranked = self.by_relevance()
        top, told = ranked[0][0] if ranked else 0, words(said)
        left_out = [(s, x[:40], round(rel, 2)) for rel, _, s, x in ranked if s is not None and (top <= 0 or rel >= 0.70 * top) and len(words(x) & told) < 0.50 * len(words(x))]
        return left_out[:3]

    def turn(self):
        said = self.say()
        self.claims = [self.judge(c) for c in assertions(said)]
        new = self.object(said)
        converged, stalled = not new, bool(self.raised) and new == self.raised[-1] and bool(new)
        self.rounds.append((said, converged, stalled))
        self.raised.append(new)
        self.open = not (converged or stalled)


def stability(rounds, vector):
    change = [min(1.0, max(0.0, 1 - sum(a.get(k, 0) * x for k, x in b.items()))) for a, b in zip(map(vector, rounds), map(vector, rounds[1:]), strict=False)]
    return 1 - sum(round(c, 6) for c in change) / len(change) if change else 1.0


def hashing(corpus):
    """Texts to unit vectors under the corpus's weights, as (place: entry)."""
    idf = {r.feature: r.idf for r in corpus.dense.idf.collect()}
    blank = math.log(1 + (corpus.dense.n.first().n + 0.5) / 0.5)

    def vector(text):
        t = tokens(text)
        out = Counter()
        for feature, tf in Counter([*t, *(f"{a}#{b}" for a, b in zip(t, t[1:], strict=False))]).items():
            sign = -1 if zlib.crc32(f"{feature}|s".encode()) & 1 else 1
            out[zlib.crc32(feature.encode()) % corpus.dense.dim] += sign * idf.get(feature, blank) * (1 + math.log(tf))
        size = math.sqrt(sum(x * x for x in out.values()))
        return {k: x / size for k, x in out.items()} if size else {}

    return vector


@pytest.fixture(scope="module")
def ran(spark):
    corpus, asked = debate.build(Q.spans(spark, SF)), Q.asked(spark, SF)

    def found(queries):
        out = {}
        for r in debate.retrieve(corpus, queries)[0].orderBy("query_id", "rk").collect():
            out.setdefault(r.query_id, []).append((r.span_id, r.text))
        return out

    first = found(asked)
    cases = {r.query_id: Case(r.text, first.get(r.query_id, [])) for r in asked.collect()}
    for n in range(3):
        active = {q: c for q, c in cases.items() if c.open}
        for c in active.values():
            c.turn()
        gaps = {(q, i): c[0] for q, case in active.items() if case.open for i, c in enumerate([c for c in case.claims if c[2] is None][:2])}
        if n < 2 and gaps:
            keys = list(gaps)
            more = found(spark.createDataFrame([(i, gaps[k]) for i, k in enumerate(keys)], "query_id long, text string"))
            for i, (q, _) in enumerate(keys):
                for span, text in more.get(i, []):
                    if span not in {s for s, _ in cases[q].hits}:
                        cases[q].hits.append((span, text))
    return corpus, asked, cases, debate.run(corpus, asked)


def test_rounds_and_objections(ran):
    _, _, cases, tables = ran
    got = {}
    for r in tables["rounds"].orderBy("query_id", "round").collect():
        got.setdefault(r.query_id, []).append((r.proposal, r.converged, r.stalled))
    assert got == {q: c.rounds for q, c in cases.items()}
    raised = {}
    for r in tables["objections"].orderBy("query_id", "round", "obj_ix").collect():
        raised.setdefault((r.query_id, r.round), []).append((r.citation, r.excerpt, r.rel))
    assert raised == {(q, n): new for q, c in cases.items() for n, new in enumerate(c.raised) if new}
    assert any(len(c.rounds) > 1 for c in cases.values()) and any(c.rounds[-1][1] for c in cases.values())


def test_hits_and_claims(ran):
    _, _, cases, tables = ran
    hits = {}
    for r in tables["hits"].orderBy("query_id", "rk").collect():
        hits.setdefault(r.query_id, []).append((r.span_id, r.text))
    assert hits == {q: c.hits for q, c in cases.items()}
    claims = {}
    for r in tables["claims"].orderBy("query_id", "claim_ix").collect():
        claims.setdefault(r.query_id, []).append((r.claim, r.verdict, r.evidence, r.support))
    assert claims == {q: kept for q, c in cases.items() if (kept := [x for x in c.claims if x[2] is not None])}


def test_answers_and_metrics(ran):
    corpus, _, cases, tables = ran
    vector = hashing(corpus)
    got = {r.query_id: r for r in tables["answers"].collect()}
    assert got.keys() == cases.keys()
    for q, c in cases.items():
        kept = [x for x in c.claims if x[2] is not None]
        r = got[q]
        assert r.answer == " ".join(y for x in kept if (y := re.sub(T.BULLET, "", x[0]).strip()))
        assert (r.converged, r.rounds, r.claims_total, r.claims_anchored, r.evidence_spans) == (c.rounds[-1][1], len(c.rounds), len(c.claims), len(kept), len(c.hits))
        assert r.faithfulness == round(len(kept) / len(c.claims), 6) if c.claims else r.faithfulness == 0
        assert abs(r.stability - stability([s for s, _, _ in c.rounds], vector)) < 2e-6


def test_ask_joins_tools_and_debate(spark, ran):
    """Every answer of the mixed batch is the tool's or the debate's."""
    _, _, _, tables = ran
    got = {r.query_id: tuple(r) for r in Q.ask_all(spark, SF).collect()}
    own = reason.trace(Q.tool_answers(spark, SF)).select((-1 - F.col("query_id")).alias("q"), "observation", "tool").collect()
    asked = reason.route(F.col("text"))["kind"] != "rag"
    routed = {r.query_id for r in Q.asked(spark, SF).filter(asked).collect()}
    want = {r.q: (r.q, r.observation, r.tool, True, 0, 1.0) for r in own} | {r.query_id: (r.query_id, r.answer, "rag", r.converged, r.rounds, r.faithfulness) for r in tables["answers"].collect() if r.query_id not in routed}
    assert {q: a for q, a in got.items() if q not in routed} == want
