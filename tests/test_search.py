from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tarn.config import Debate, Rerank, Settings
from tarn.functions import vector as V
from tarn.operators import chunking, debate, fusion, rerank, search
from tests.test_text import tokens

TEXTS = {1: "fast battery charging", 2: "battery life is long and battery is fine", 3: "the screen is bright", 4: "", 5: "屏幕 很 亮 battery"}
QUERIES = {10: "battery life", 11: "bright screen", 12: "nothing zzz"}


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame(list(TEXTS.items()), "span_id long, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id long, text string")


def test_bm25(spans, queries):
    got = {(r.query_id, r.span_id): r.score for r in search.bm25_search(search.build_bm25(spans), queries, 10).collect()}
    bags = {k: Counter(tokens(t)) for k, t in TEXTS.items()}
    n, avg = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    want = {}
    for q, text in QUERIES.items():
        for s, bag in bags.items():
            total = 0.0
            for t in set(tokens(text)):
                df = sum(t in b for b in bags.values())
                if tf := bag[t]:
                    total += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * sum(bag.values()) / avg))
            if total > 0:
                want[q, s] = round(total, 6)
    assert got == pytest.approx(want, abs=2e-6)
    assert search.bm25_search(search.build_bm25(spans), queries.filter("query_id = 12"), 5).isEmpty()


def embed(text, idf, n, dim):
    t = tokens(text)
    v = np.zeros(dim)
    for f, tf in Counter(t + [f"{a}#{b}" for a, b in zip(t, t[1:], strict=False)]).items():
        sign = 1 if zlib.crc32(f"{f}|s".encode()) % 2 == 0 else -1
        v[zlib.crc32(f.encode()) % dim] += sign * idf.get(f, math.log(1 + (n + 0.5) / 0.5)) * (1 + math.log(tf))
    size = np.linalg.norm(v)
    return v / size if size else v


def test_hash_search(spans, queries):
    df = Counter(f for t in TEXTS.values() for f in set(tokens(t)) | {f"{a}#{b}" for a, b in zip(tokens(t), tokens(t)[1:], strict=False)})
    idf = {f: math.log(1 + (len(TEXTS) - d + 0.5) / (d + 0.5)) for f, d in df.items()}
    index = search.build_hash_index(spans, 64)
    got = {(r.query_id, r.span_id): r.score for r in search.vector_search(index, queries, 5).collect()}
    want = {(q, s): float(embed(a, idf, len(TEXTS), 64) @ embed(b, idf, len(TEXTS), 64)) for q, a in QUERIES.items() for s, b in TEXTS.items()}
    assert got == pytest.approx(want, abs=2e-6)
    assert all(abs(r.n - 1) < 1e-9 or r.n == 0 for r in index.vectors.select(V.norm("v").alias("n")).collect())


def test_dense_search_is_exact(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8))
    m[5] = 0
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "span_id long, v array<double>").repartition(3)
    got = search.dense_search(v, v.filter("span_id < 7").withColumnRenamed("span_id", "query_id"), 4).orderBy("query_id", "rk").collect()
    size = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    for q in range(7):
        c = np.round(unit[q] @ unit.T, 6)
        want = sorted(range(300), key=lambda i: (-c[i], i))[:4]
        assert [r.span_id for r in got if r.query_id == q] == want


@pytest.mark.parametrize("broadcast", [0, 10**9])
def test_dense_search_takes_ids_of_texts(spark, monkeypatch, broadcast):
    """Blocks that are broadcast, or meet in partitions; ties go to the lesser id; no vector, no hit."""
    monkeypatch.setattr(search, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(search, "ROW_BLOCK", 3)
    rows = [(f"s{i:02d}", [1.0, float(i % 3)]) for i in range(20)] + [("none", None)]
    v = spark.createDataFrame(rows, "span_id string, v array<double>").repartition(4)
    found = search.dense_search(v, spark.createDataFrame([("q", [2.0, 2.0]), ("zero", [0.0, 0.0])], "query_id string, v array<double>"), 5).orderBy("query_id", "rk").collect()
    assert [(r.span_id, r.score) for r in found if r.query_id == "q"] == [(f"s{i:02d}", 1.0) for i in (1, 4, 7, 10, 13)]
    assert [(r.span_id, r.score) for r in found if r.query_id == "zero"] == [(f"s{i:02d}", 0.0) for i in range(5)]
    assert search.dense_search(v.limit(0), v.withColumnRenamed("span_id", "query_id"), 5).isEmpty()


def test_chunks_can_be_searched(spark, queries):
    docs = spark.createDataFrame([(1, "fast battery charging\n\nthe screen is bright"), (2, "battery life is long"), (3, None)], "doc_id long, text string")
    corpus = debate.build(chunking.chunk(docs).select("span_id", "text"))
    hits, _ = debate.retrieve(corpus, queries)
    assert {r.query_id: r.span_id for r in hits.filter("rk = 1").collect()}[11] == "span::chk_1_00001"
    claims = debate.run(corpus, queries)["claims"].collect()
    assert claims and all(r.evidence.startswith("span::chk_") for r in claims)


def test_rrf_and_weights(spark):
    d = spark.createDataFrame([(1, 7, 0.9, 1), (1, 8, 0.5, 2)], "query_id long, span_id long, score double, rk int")
    s = spark.createDataFrame([(1, 8, 3.0, 1), (1, 9, 1.0, 2)], "query_id long, span_id long, score double, rk int")
    rows = fusion.weighted_rrf(d, s, top=3).collect()
    assert {r.span_id: r.fused for r in rows} == {8: round(0.5 / 62 + 0.5 / 61, 6), 7: round(0.5 / 61, 6), 9: round(0.5 / 62, 6)}
    e = fusion.entropy(s).first().entropy
    assert e == pytest.approx(-(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(2), abs=1e-6)
    assert fusion.margin(d).first().margin == 1.0


def plain_rerank(fused, raw, c=Rerank()):
    def z(x):
        m, sd = sum(x) / len(x), math.sqrt(sum((v - sum(x) / len(x)) ** 2 for v in x) / len(x))
        return [0.0] * len(x) if sd < 1e-12 else [round((v - m) / sd, 9) for v in x]

    zr, zf, n = z(raw), z(fused), len(raw)
    top = sorted(range(n), key=lambda i: (-zr[i], i))
    lead = zr[top[0]] - (zr[top[1]] if n > 1 else -9e9)
    blend = [round(c.alpha * a + (1 - c.alpha) * b, 9) if lead >= c.min_margin else b for a, b in zip(zr, zf, strict=True)]
    keep = set(range(n)) if n < 4 else {i for i in range(n) if zr[i] >= c.z_floor} | {top[0], 0}
    for i in top:
        if len(keep) < max(2, (n + 1) // 2):
            keep.add(i)
    return sorted(keep, key=lambda i: (-blend[i], i))[: c.top_n]


def test_calibrated_rerank(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for q in range(60):
        n = int(rng.integers(1, 15))
        fused = sorted((float(x) for x in rng.random(n).round(4)), reverse=True)
        raw = [[0.5] * n, [float(x) for x in rng.random(n).round(2)], [1.0] + [0.0] * (n - 1)][q % 3]
        rows += [(q, i, f, i + 1, r) for i, (f, r) in enumerate(zip(fused, raw, strict=True))]
        want[q] = plain_rerank(fused, raw)
    scored = spark.createDataFrame(rows, "query_id long, span_id long, fused double, rk int, raw double")
    got = rerank.calibrated_rerank(scored).orderBy("query_id", "rk").collect()
    assert {q: [r.span_id for r in got if r.query_id == q] for q in want} == want


def test_retrieve_and_debate(spark, spans, queries):
    corpus = debate.build(spans)
    hits, signals = debate.retrieve(corpus, queries)
    assert hits.filter("query_id = 10 and rk = 1").first().span_id == 2
    assert all(abs(r.w_dense + r.w_sparse - 1) < 1e-6 and 0.1 <= r.w_sparse <= 0.9 for r in signals.collect())
    found = debate.run(corpus, queries)
    answers = {r.query_id: r for r in found["answers"].collect()}
    assert set(answers) == set(QUERIES) and all(1 <= a.rounds <= 3 and 0 <= a.faithfulness <= 1 and 0 <= a.stability <= 1 for a in answers.values())
    assert "battery" in answers[10].answer
    with pytest.raises(ValueError):
        debate.build(spans.limit(0))


def test_debate_votes_and_hooks(spark, spans, queries):
    said = iter(["one", "two", "two"])
    hit = lambda p: p.select("query_id", F.lit(0).alias("obj_ix"), F.lit(-7).cast("long").alias("citation"), F.lit("x").alias("excerpt"), F.lit(1.0).alias("rel"))
    propose = lambda q, lines, config: q.select("query_id", F.lit(next(said)).alias("proposal"))
    found = debate.run(debate.build(spans), queries, Settings(debate=Debate(self_consistency=3)), propose, lambda q, p, lines, config: hit(p))
    assert {r.proposal for r in found["rounds"].collect()} == {"two"}  # the majority of three samples
    assert found["objections"].isEmpty() and all(a.converged and a.rounds == 1 for a in found["answers"].collect())  # what cites no hit does not count
