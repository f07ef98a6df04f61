"""Scans over blocks: tokens and CRCs of arrays, searches in many small slices, what is stored."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions import keys
from tarn.operators import ask, debate, scans, search
from tests.test_indexes import rows_of, texts  # noqa: F401
from tests.test_text import tokens


def test_tokens_of_arrays_are_those_of_texts(monkeypatch):
    monkeypatch.setattr(keys, "SLICE_BYTES", 50)
    monkeypatch.setattr(keys, "BLOCK_BYTES", 700)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab.-_'  \nñ9z屏") for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["x" * 200 + " " + "x" * 199 + "y", "", "a.b..c.d_-e 'f' g'h"]
    cjk = [any("一" <= c <= "鿿" for c in t) for t in texts]
    batch = pa.record_batch({"low": ["" if c else t + " " for t, c in zip(texts, cjk, strict=True)], "words": pa.array([tokens(t) if c else [] for t, c in zip(texts, cjk, strict=True)], pa.list_(pa.string()))})
    said, sizes, key = [], [], {}
    for part in keys.parts([batch]):
        t = keys.tokens(part)
        words = keys.first_words(t, np.arange(len(t.start))).to_pylist()
        said, sizes = said + words, sizes + t.n.tolist()
        assert all(key.setdefault(w, k) == k for w, k in zip(words, t.key.tolist(), strict=True))
    assert said == [w for t in texts for w in tokens(t)] and sizes == [len(tokens(t)) for t in texts]
    assert len(set(key.values())) == len(key)


def test_crc_of_joined_texts():
    rng = random.Random(2)
    a, b = ([bytes(rng.choices(range(256), k=rng.randint(0, 300))) for _ in range(200)] for _ in range(2))
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (keys.crc_joined(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b, strict=True)])).all()


@pytest.mark.parametrize("small", [False, True])
def test_searches_in_slices_are_exact(spark, texts, monkeypatch, small):  # noqa: F811
    """Against joins over postings and features, with blocks, slices and pieces of any size."""
    if small:
        for module, name, value in ((keys, "BLOCK_BYTES", 500), (scans, "SLICE_KEYS", 30), (scans, "GROUP_KEYS", 300), (scans, "CELLS", 40), (scans, "HELD", 60)):
            monkeypatch.setattr(module, name, value)
    spans, asked = texts
    index = search.build_bm25(spans)
    own = asked.select("query_id", F.explode(search.T.token_set(F.col("text"))).alias("term"))
    joined = index.postings.join(own.join(index.terms, "term"), "term").crossJoin(index.stats.select("avgdl"))
    want = search.top_k(search.bm25_sum(joined).filter("score > 0"), 7)
    assert rows_of(search.bm25_search(index, asked, 7)) == rows_of(want)
    counted = search.features(spans)
    sparse = search.hash_vectors(counted, search.feature_idf(counted, spans), spans.agg(F.count("*").alias("n")), 16)
    v = {r.span_id: np.array(r.v) for r in search.as_arrays(sparse, spans, 16).collect()}
    hashed = search.build_hash_index(spans, 16)
    got = {r.span_id: np.array(r.v) for r in hashed.vectors.collect()}
    assert got.keys() == v.keys() and all(np.allclose(got[i], v[i], atol=1e-12) for i in v)
    q = search.embed_queries(hashed, asked)
    assert rows_of(search.vector_search(hashed, asked, 7)) == rows_of(search.dense_search(hashed.vectors, q, 7))


def _stored_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


@pytest.fixture
def scratch(tmp_path, monkeypatch):
    monkeypatch.setattr("tarn.sources.scratch.folder", lambda spark: f"file://{tmp_path}")
    return tmp_path


def test_what_a_search_stores_is_less_than_the_text(spark, scratch):
    """Neither texts nor postings nor vectors are stored; spans of few words would have vectors ten times their size."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(3000)], k=60))) for i in range(8000)]
    spans = spark.createDataFrame(rows, "span_id long, text string").repartition(4)
    corpus = debate.build(spans)
    assert ask.health(corpus).first().spans == 8000 and _stored_bytes(scratch) == 0  # its state needs no index
    hits, _ = debate.retrieve(corpus, spark.createDataFrame([(1, rows[5][1])], "query_id long, text string"))
    assert hits.filter("rk = 1").first().span_id == 5
    assert _stored_bytes(scratch) < sum(len(t) for _, t in rows)
