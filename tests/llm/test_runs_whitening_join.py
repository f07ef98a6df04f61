from __future__ import annotations

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import ngram_join, queries, whitening, word_runs
from tarn.llm.common import byte_count
from tests.llm.test_dedup_pii_toxicity import chains, sets_of

SF = "/root/testdata/sf0.001"


# --- periodic runs ---------------------------------------------------------


def all_runs(x):
    """Every run by its definition: lag by lag, word by word."""
    out = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic(rnd):
    """Texts of few words, whole repeats, repeats with faults, Fibonacci words, joints of one period."""
    kind, n = rnd.randrange(6), rnd.randrange(240)
    if kind == 0:
        return [rnd.randrange(2) for _ in range(n)]
    if kind == 1:
        unit = [rnd.randrange(3) for _ in range(rnd.randint(1, 70))]
        text = (unit * 240)[:n]
        for _ in range(rnd.randrange(4) if n else 0):
            text[rnd.randrange(n)] = rnd.randrange(4)
        return text
    if kind == 2:
        return ([0, 1] * rnd.randint(1, 60) + [0]) * rnd.randint(1, 4)
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:
        return [w for _ in range(12) for w in [rnd.randrange(4) for _ in range(rnd.randint(1, 12))] * rnd.randint(1, 6)]
    unit = [rnd.randrange(3) for _ in range(rnd.randint(1, 5))] * 60
    return unit[: rnd.randint(40, 130)] + [rnd.randrange(2)] * rnd.randrange(2) + unit[rnd.randrange(5) :][: rnd.randint(40, 130)]


def test_all_runs_are_found():
    rnd = random.Random(3)
    for _ in range(40):
        texts = [periodic(rnd) for _ in range(10)]
        assert word_runs.find_runs([np.array(t, np.int64) for t in texts]) == [all_runs(t) for t in texts]
    assert word_runs.find_runs([]) == [] and word_runs.find_runs([np.zeros(0, np.int64)]) == [[]]


def test_long_constant_text_is_one_run():
    assert word_runs.find_runs([np.zeros(300_000, np.int64)]) == [[(0, 300_000, 1)]]


def run_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0 and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = [r for r in all_runs(w) if r[1] >= 12]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_op12_brute_force(spark, odd, small):
    docs = odd.select("doc_id", "text").filter("length(text) < 8000 or text is null").unionByName(small.filter("length(text) < 4000").select("doc_id", "text"))
    got = word_runs.digests(word_runs.word_runs(docs, edit=word_runs.repeat_tail)).collect()
    want = [run_row(r.doc_id, r.text) for r in docs.collect()]
    assert order(got) == order(want) and sum(r[1] for r in want) > 10


def test_op12_odd_rows_and_empty(spark, odd, empty):
    got = {r.doc_id: r for r in word_runs.word_runs(odd).collect()}
    assert got[2].runs == [] and got[2].collapsed == "" and got[4].n_words == 0
    assert [tuple(r) for r in got[11].runs] == [(0, 6000, 1)] and got[11].collapsed == "word"
    assert word_runs.word_runs(odd).count() == odd.count() and word_runs.digests(word_runs.word_runs(empty)).count() == 0


# --- whitening -------------------------------------------------------------


def test_feast_against_a_dense_solver():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    cases = [np.cov(rng.standard_normal((d, 300)), bias=True).reshape(d, d) for d in (1, 2, 5, 40)]
    cases += [np.cov(rng.standard_normal((30, 3)), bias=True), np.eye(9), np.diag([5.0, 5, 5, 5, 5, 5, 1, 1]), np.zeros((4, 4))]
    cases += [q @ np.diag(np.r_[1, 1 + 1e-6, 1 + 3e-4, 1 + 1e-4, np.full(36, 0.5)]) @ q.T, q @ np.diag(np.exp(-2.0 * np.arange(40))) @ q.T, q @ np.diag(np.linspace(1, 1.01, 40)) @ q.T]
    for v in cases:
        v = (v + v.T) / 2
        e, y = whitening.feast(v, 4)
        want = np.linalg.eigvalsh(v)[::-1]
        assert len(e) == min(4, int((want > 1e-12 * max(want[0], 1e-300)).sum()))
        if len(e):
            assert np.abs(e - want[: len(e)]).max() < 1e-13 * want[0] * len(v)
            assert np.abs(v @ y - y * e).max() < 1e-13 * want[0] * len(v) and np.abs(y.T @ y - np.eye(len(e))).max() < 1e-13


def test_inertia_counts():
    rng = np.random.default_rng(2)
    v = np.cov(rng.standard_normal((20, 60)), bias=True)
    diagonal, off = whitening.tridiagonal(v)
    ts = np.linspace(0, 4, 50)
    assert whitening.exceeding(diagonal, off, ts).tolist() == [int((np.linalg.eigvalsh(v) > t).sum()) for t in ts]


def whitened_rows(rows):
    """Plain statement: exact rational moments, a dense solver."""
    good = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s, strict=True)] for x in fit])
    e, y = np.linalg.eigh(centred.T @ centred / n)
    e, y = e[::-1], y[:, ::-1]
    out = []
    for i, x in good:
        d = [n * c - t for c, t in zip(x, s, strict=True)]
        for k in range(min(4, int((e > 1e-12 * e[0]).sum()))):
            out.append((i, k + 1, n, sum(c * c for c in d), abs(float(np.array(d) @ y[:, k]) / n / math.sqrt(e[k])), e[k] / e.sum()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_op11_brute_force(spark, parts):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").repartition(parts)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    odd = [(-1, None), (-2, [None] + [0.5] * 63), (-3, [float("nan")] * 64), (-4, [float("inf")] + [0.0] * 63), (-5, rows[0][1]), (None, rows[1][1]), (-6, [-0.0] * 64), (-6, [-0.0] * 64), (-7, [1.0] * 3)]
    docs = table.unionByName(spark.createDataFrame(odd, table.schema)).withColumn("x", F.lit("clash")).withColumn("n", F.lit(1))
    got = whitening.digests(whitening.whiten(whitening.quantised(docs), whitening.fit(whitening.quantised(docs)))).collect()
    want = whitened_rows([r for r in rows + odd if r[0] != -7])
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    found = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=str)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert all(math.isclose(f[k], w[k], rel_tol=1e-9, abs_tol=1e-9) for f, w in zip(found, want, strict=True) for k in (4, 5))
    signs = {}
    by = {r.vec_id: r for r in got if r.component == 1}
    for r in got:
        signs.setdefault((r.vec_id, r.component), set()).add(round(r.whitened, 9))
    assert by[-5].whitened == by[rows[0][0]].whitened and all(len(s) == 1 for s in signs.values())


def test_op11_degenerate(spark):
    kind = "vec_id long, embedding array<float>"
    run = lambda rows: whitening.whiten(q := whitening.quantised(spark.createDataFrame(rows, kind)), whitening.fit(q))
    assert run([]).count() == 0 and run([(1, None)]).count() == 0 and run([(1, [0.5, 1.0]), (2, [0.5, 1.0])]).count() == 0 and run([(1, [])]).count() == 0
    two = run([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])]).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), round(abs(r.whitened), 12), round(r.explained, 12)) for r in two] == [(i, 1, 2, 2 * 256**2, 1.0, 1.0) for i in (1, 2, 3)]
    wide = run([(i, [float(2**50) * i, 0.0]) for i in range(3)]).collect()
    assert int(wide[0].deviation) == (2**58 * 3) ** 2 and whitening.digests(run([(i, [float(2**50) * i, 0.0]) for i in range(3)])).filter("deviation is null").count() == 2


# --- n-gram join -----------------------------------------------------------


def linked(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for o in sets:
            if o < i and sets[i] and sets[o]:
                n = len(sets[i] & sets[o])
                if 100 * n >= percent * (len(sets[i]) + len(sets[o]) - n):
                    a, b = sorted((find(i), find(o)))
                    root[b] = a
    return {i: find(i) for i in sets}


def edited(n, seed):
    """Texts of 5 to 300 words and copies of them with words changed, dropped and added, near the threshold."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 6 == 0:
            base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([5, 6, 8, 9, 12, 30, 60, 150, 300]))]
        text = base.copy()
        for _ in range(rng.randrange(0, 2 + len(base) // 25)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = [f"w{rng.randrange(3000)}"] * rng.randrange(2)
        rows.append((5000 + i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("block", "bits"), [(1024, 1 << 26), (4, 64)])
def test_op13_brute_force(spark, odd, small, monkeypatch, block, bits):
    monkeypatch.setattr(ngram_join.near_dup, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BITMAP", bits)
    docs = odd.select((F.col("doc_id") + 500).alias("doc_id"), "text").unionByName(small.select("doc_id", "text")).filter("doc_id < 900")
    docs = docs.unionByName(spark.createDataFrame(chains() + edited(150, 4) + [(None, chains()[0][1])], "doc_id long, text string")).withColumn("key", F.lit("clash")).withColumn("name", F.lit(1)).repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = sets_of([r for r in rows if r[0] is not None])
    root = linked(sets, 80)
    got = ngram_join.similar_texts(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {i: (len(sets[i]), root[i]) for i in sets}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert len(set(root.values())) < len(root) - 100


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_signatures_meet(percent):
    """Pairs at the very threshold share a signature, at every size; so do their sketches' bounds hold."""
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        a = int(rng.integers(2, 400))
        x = np.unique(rng.integers(0, 1 << 63, 2 * a, dtype=np.uint64))
        common = int(rng.integers(1, a + 1))
        most = common * 100 // percent - common  # elements outside the intersection
        extra = int(rng.integers(0, most + 1))
        one, two = np.sort(x[: common + extra]) if common + extra <= len(x) else x, np.concatenate([x[:common], np.unique(rng.integers(0, 1 << 63, most - extra, dtype=np.uint64))])
        two = np.unique(two)
        common = len(np.intersect1d(one, two))
        if 100 * common < percent * (len(one) + len(two) - common) or np.array_equal(one, two):
            continue
        assert len(np.intersect1d(ngram_join.signatures(one, percent), ngram_join.signatures(two, percent)))
        sizes, bits = ngram_join._folded([ngram_join.sketch(one), ngram_join.sketch(two)])
        assert len(ngram_join._plausible(sizes, bits, np.array([0]), np.array([1]), percent)[0])


def test_op13_empty(spark, empty):
    assert ngram_join.similar_texts(empty).count() == 0


# --- all of them -----------------------------------------------------------


def test_queries_read_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    every = queries.queries()
    assert every["op12_word_runs"](spark, SF).count() == every["op13_partenum_join"](spark, SF).count() == n
    assert every["op11_whiten_feast"](spark, SF).count() == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_settings_as_spark_writes_them(spark, small):
    assert [byte_count(x) for x in ("1024", "64m", "64mb", "1g", "8000000b", "-1", " 2K ")] == [1024, 64 << 20, 64 << 20, 1 << 30, 8_000_000, -1, 2048]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        assert word_runs.word_runs(small).count() == small.count() and spark.conf.get(key) == "8000000b"
        spark.conf.set(key, "1m")
        assert word_runs.word_runs(small).count() == small.count() and spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
