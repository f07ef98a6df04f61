"""Indexes in segments, blocks and cases, given embedders and scorers, distillation in rounds."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.config import Memory, Settings
from tarn.operators import ask, blockmax, bounds, cases, debate, memory, rerank, search, segments

SPANS = [(1, "fast battery charging"), (2, "battery life is long and battery is fine"), (3, "the screen is bright"), (4, ""), (5, "屏幕 很 亮 battery"), (6, "bright and long life"), (7, "nothing of it is bright")]
QUERIES = [(1, "battery life"), (2, "bright screen"), (3, "nothing zzz")]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark):
    """A few words in hundreds of spans, some in nearly all."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[60 / (j + 1) for j in range(60)], k=rng.randint(0, 25)))) for i in range(400)]
    asked = [(i, " ".join(rng.sample(words, rng.randint(1, 6)))) for i in range(25)] + [(99, "nowhere"), (100, "")]
    return spark.createDataFrame(rows, "span_id long, text string").repartition(4), spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize(("k", "span_range"), [(1, 8), (10, 8), (10, 64), (1000, 32)])
def test_blockmax_is_exact(spark, texts, k, span_range):
    spans, asked = texts
    index = search.build_bm25(spans)
    found, report = blockmax.search_blocks(blockmax.build(index, span_range), asked, k)
    assert rows_of(found.select("query_id", "span_id", "score", "rk")) == rows_of(search.bm25_search(index, asked, k).select("query_id", "span_id", "score", "rk"))
    count = report.first()
    assert 0 < count.read <= count.blocks and (count.read < 0.8 * count.blocks or k > 1 or span_range > 8)


def test_segments_equal_one_build(spark, texts, tmp_path):
    """Three batches, one of them empty, one tried twice: weights, postings, scores and hits are those of one build."""
    spans, asked = texts
    index = segments.Segments(spark, str(tmp_path))
    assert index.spans().count() == 0 and index.stats().first().n == 0
    first = spans.filter("span_id % 3 = 0")
    assert index.append(first) == first.count()
    before = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if "segment=1" in d}
    first.limit(3).write.parquet(str(tmp_path / "postings" / "segment=2"))  # a batch that failed half-way
    assert index.append(spans.filter("span_id % 3 = 1")) + index.append(spans.filter("span_id < 0")) + index.append(spans.filter("span_id % 3 = 2")) + first.count() == spans.count()
    after = {f: os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs if "segment=1" in d}
    assert before == after and index.manifest().count() == 3
    whole = search.build_bm25(spans)
    assert rows_of(index.bm25().terms) == rows_of(whole.terms) and rows_of(index.stats()) == rows_of(whole.stats)
    assert rows_of(search.bm25_search(index.bm25(), asked, 10)) == rows_of(search.bm25_search(whole, asked, 10))
    small = Settings()
    got, want = (debate.retrieve(c, asked.filter("text <> ''"), small)[0] for c in (index.open(small), debate.build(spans, small)))
    assert rows_of(got) == rows_of(want)
    assert {r.span_id for r in index.find(spark.createDataFrame([(4,), (4,), (9999,)], "span_id long")).collect()} == {4}


def test_cases_are_isolated(spark):
    """Every case has the hits of an engine that holds it alone, and none of another's."""
    rng = random.Random(2)
    rows = [(c, 100 * c + i, t + f" extra{rng.randrange(5)}") for c in range(4) for i, (_, t) in enumerate(SPANS) if rng.random() < 0.8]
    asked = [(c, 10 * c + i, t) for c in range(5) for i, t in QUERIES]  # case 4 holds nothing
    spans, queries = spark.createDataFrame(rows, "case_id long, span_id long, text string"), spark.createDataFrame(asked, "case_id long, query_id long, text string")
    got = cases.retrieve(cases.build(spans), queries)
    want = []
    for c in range(4):
        alone, _ = debate.retrieve(debate.build(spans.filter(F.col("case_id") == c).drop("case_id")), queries.filter(F.col("case_id") == c).drop("case_id"))
        want += [(c, *r) for r in alone.collect()]
    columns = ["case_id", "query_id", "rk", "span_id", "score", "fused", "rerank_z", "rerank_raw", "text"]
    assert rows_of(got.select(columns)) == sorted(want, key=str)
    assert got.filter("span_id div 100 <> case_id or query_id div 10 <> case_id").isEmpty()


def test_given_embedder_and_scorer(spark):
    """A model is loaded in the tasks; its vectors, of any length, and a scorer of lists drive retrieval."""
    letters = "aeionrst"

    def load():
        return lambda texts: np.array([[t.lower().count(c) for c in letters] for t in texts], float)

    spans, queries = spark.createDataFrame(SPANS, "span_id long, text string"), spark.createDataFrame(QUERIES, "query_id long, text string")
    corpus = debate.build(spans, embed=search.text_embedder(load))
    assert {len(r.v) for r in corpus.dense.vectors.collect()} == {len(letters)}
    found = search.vector_search(corpus.dense, queries, 3).collect()
    unit = lambda t: (v := np.array([t.lower().count(c) for c in letters], float)) / (np.linalg.norm(v) or 1)
    said, text = dict(QUERIES), dict(SPANS)
    assert found and all(abs(r.score - unit(said[r.query_id]) @ unit(text[r.span_id])) < 1e-6 for r in found)

    seen = spark.sparkContext.accumulator(0)

    def longest_first():
        seen.add(1)
        return lambda query, texts: [len(t) for t in texts]

    hits, _ = debate.retrieve(corpus, queries, scorer=longest_first)
    got = hits.collect()
    assert seen.value >= 1 and all(r.rerank_raw == len(r.text) for r in got)
    plain = {(r.query_id, r.span_id): r.rerank_raw for r in debate.retrieve(corpus, queries)[0].collect()}
    assert any(plain.get((r.query_id, r.span_id)) != r.rerank_raw for r in got)
    answers = debate.run(corpus, queries, scorer=rerank.by_scarcity)["answers"]
    assert answers.count() == len(QUERIES)


def test_scarcity_counts_the_list():
    score = rerank.by_scarcity()
    assert score("red fox", ["the red fox", "red", "red car", ""]) == [1.0, 0.25, 0.25, 0.0] and score("x", ["a"]) == [0.0] and score("", []) == []


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_distill_in_rounds(spark, block):
    """Any block size gives the fold in order: each episode joins the first leader that it is near to."""
    rng = np.random.default_rng(4)
    vs = rng.normal(size=(90, 4))
    vs[5] = vs[17] = 0
    session = [0 if i % 3 else 1 + i % 2 for i in range(90)]
    rows = [(session[i], i, f"f{i % 40}", vs[i].tolist()) for i in range(90)]
    config = Memory(cluster_threshold=0.7)
    want = []
    for s in set(session):
        clusters = []
        for i in (i for i in range(90) if session[i] == s):
            n = np.linalg.norm(vs[i])
            v = vs[i] / n if n else vs[i]
            home = next((c for c in clusters if round(float(c[0] @ v), 9) >= 0.7), None)
            if home:
                home[2] += 1
            else:
                clusters.append([v, i, 1])
        told = set()
        for _, i, n in clusters:
            if n >= 2 and f"f{i % 40}" not in told:
                told.add(f"f{i % 40}")
                want.append((s, i, f"f{i % 40}", n))
    episodes = spark.createDataFrame(rows, "session_id long, seq long, text string, v array<double>").repartition(3)
    assert rows_of(memory.distill(episodes, config=config, block=block)) == sorted(want, key=str) and len(want) > 5
    assert memory.distill(episodes.filter("false"), config=config, block=block).isEmpty()


@pytest.mark.parametrize("kind", ["clustered", "random", "few"])
def test_bounded_search_is_exact(spark, kind):
    """The rows of the plain search, with ties, zero and missing vectors; clustered vectors leave most pairs of blocks unread."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    n = {"clustered": 3000, "random": 700, "few": 3}[kind]
    vs = centres[rng.integers(12, size=n)] + 0.02 * rng.normal(size=(n, 8)) if kind == "clustered" else rng.normal(size=(n, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(vs)] + [(n, vs[0].tolist()), (n + 1, [0.0] * 8), (n + 2, None)]
    v = spark.createDataFrame(rows, "span_id long, v array<double>").repartition(4)
    q = v.filter("span_id % 50 = 0").withColumnRenamed("span_id", "query_id").unionByName(spark.createDataFrame([(-1, [0.0] * 8), (-2, None)], "query_id long, v array<double>"))
    for k in (1, 7):
        found, report = bounds.search_bounded(v, q, k, pivots=16)
        assert rows_of(found.select("query_id", "span_id", "score", "rk")) == rows_of(search.dense_search(v, q, k).select("query_id", "span_id", "score", "rk"))
        count = report.first()
        assert 0 < count.scored <= count.pairs and (kind != "clustered" or count.scored < 0.5 * count.pairs)
    assert bounds.search_bounded(v.filter("false"), q, 3)[0].isEmpty()


def test_answers_are_remembered(spark, tmp_path):
    """Turns are appended in order, blank ones are not, and the state tells how many there are."""
    path = str(tmp_path / "memory")
    first = spark.createDataFrame([(2, "Q: b\nA: y"), (1, "Q: a\nA: x"), (3, "  ")], "query_id long, text string")
    ask.remember(first, path)
    held = ask.remember(spark.createDataFrame([(1, "Q: a\nA: x")], "query_id long, text string"), path)
    assert [(r.seq, r.text) for r in held.orderBy("seq").collect()] == [(0, "Q: a\nA: x"), (1, "Q: b\nA: y"), (2, "Q: a\nA: x")]
    facts = memory.stats(held, held.groupBy("session_id", "text").count().filter("count >= 2"))
    corpus = debate.build(spark.createDataFrame(SPANS, "span_id long, text string"))
    state = ask.health(corpus, memories=facts).first()
    assert (state.working_memory, state.episodic_memory, state.semantic_memory, state.spans) == (3, 3, 1, len(SPANS))
    assert "working_memory" not in ask.health(corpus).columns
