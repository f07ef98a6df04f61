from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import phrase_prints, sharding, telephony


def test_hilbert_curve_is_continuous():
    for n, bits in ((2, 5), (3, 3), (4, 2)):
        points = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1)
        index = sharding.hilbert_index(list(points), bits)
        assert sorted(index) == list(range(len(index)))
        assert (np.abs(np.diff(points[:, np.argsort(index)], axis=1)).sum(axis=0) == 1).all()


def test_shards(odd, small, empty):
    for docs in (odd, small, odd.filter("doc_id < 3")):
        rows = sharding.digests(sharding.shard(docs, 8)).collect()
        n = Counter(r.shard for r in rows)
        assert len(rows) == docs.count() and max(n.values()) - min(n.get(k, 0) for k in range(8)) <= 1 and set(n) <= set(range(8))
        assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(n[k])) for k in n)
        place = [(r.hilbert, r.shard, r.slot) for r in rows]
        assert [x[0] for x in sorted(place, key=lambda x: x[1:])] == sorted(x[0] for x in place)
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert sharding.shard(empty, 8).count() == 0
    b = sharding.bounds(sharding.shard(small, 4)).collect()
    assert sum(r.rows for r in b) == small.count() and all(r.min_size_bin <= r.max_size_bin for r in b)


def test_bounds_prune(spark):
    """Files whose bounds leave out a value hold no row of it, and few files are left for a value of any dimension."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards = sharding.shard(docs, 64)
    bins = ["lang_bin", "source_bin", "size_bin"]
    rows = [tuple(r) for r in shards.select("shard", *bins).collect()]
    bounds = {r.shard: r for r in sharding.bounds(shards).collect()}
    for d, b in enumerate(bins, 1):
        values = {r[d] for r in rows}
        met = {v: {k for k, r in bounds.items() if r[f"min_{b}"] <= v <= r[f"max_{b}"]} for v in values}
        assert all(r[0] in met[r[d]] for r in rows), b
        assert np.mean([len(k) for k in met.values()]) <= 0.75 * len(bounds), b


def scalar_adpcm(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            change = (step >> 3) + sum(s for bit, s in ((4, step), (2, step >> 1), (1, step >> 2)) if code & bit)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(sample)
    return out


def test_codecs():
    mu, a = telephony.TABLES["mulaw"], telephony.TABLES["alaw"]
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and len(set(mu.tolist())) == 255
    assert (a[0x55], a[0xD5], a[0xAA], a[0x2A]) == (-8, 8, 32256, -32256) and len(set(a.tolist())) == 256
    blocks = np.random.default_rng(2).integers(0, 256, (5, telephony.BLOCK), dtype=np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [scalar_adpcm(b.tobytes()) for b in blocks]
    x = np.array([0, 100, -100, 32767], np.int16)
    assert telephony.upsample(x)[::2].tolist() == x.tolist() and len(telephony.upsample(x)) == 8


def test_store_audio(odd, empty):
    rows = telephony.store_audio(odd).join(odd.select("doc_id", F.col("text").alias("said")).distinct(), "doc_id").collect()
    for r in rows:
        raw = (r.said or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        codec, lo, hi = telephony.read_wav(bytes(r.media))
        assert r.media[lo:hi] == payload and codec == r.codec and lo == r.data_start and len(r.media) == hi and r.n_bytes == len(raw)
        sound = telephony.TABLES[codec][np.frombuffer(payload, np.uint8)].tolist() if codec != "adpcm" else [v for i in range(0, len(payload), 576) for v in scalar_adpcm(payload[i : i + 576])]
        assert np.frombuffer(r.pcm, "<i2")[::2].tolist() == sound
    d = {(r.doc_id): r for r in telephony.digests(telephony.store_audio(odd)).collect()}
    assert d[0].media_sha256 == d[1].media_sha256 and d[2].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest() and d[2].tail_crc32 == zlib.crc32(b"\xff" * 32)
    assert telephony.store_audio(odd).count() == odd.count() and telephony.store_audio(empty).count() == 0


def test_prints_follow_substrings():
    rng = np.random.default_rng(8)
    base = "".join(map(chr, rng.integers(97, 123, 3000)))
    a, b, c = phrase_prints.fingerprints([base, "shifted by this " + base, "".join(map(chr, rng.integers(97, 123, 3000)))])
    assert phrase_prints.likeness(a, b) > 0.85 > 0.2 > phrase_prints.likeness(a, c) and phrase_prints.likeness(a, a) == 1
    # names inside an equal substring do not depend on what surrounds it
    x, y = (np.frombuffer(t.encode(), np.uint8) for t in ("q" * 3 + base + "zzz", "another one" + base))
    left, right = (set(phrase_prints.parse_level(phrase_prints._BYTES[v], np.zeros(len(v), np.int64))[0].tolist()) for v in (x, y))
    assert len(left & right) > 0.97 * min(len(left), len(right))
    for t in ("", "a", "aaaa" * 50, "ab"):
        alone, among = phrase_prints.fingerprints([t])[0], phrase_prints.fingerprints(["before", t, "after"])[1]
        assert alone.tolist() == among.tolist()


@pytest.mark.parametrize("n", [3, 40, 250, 256, 257, 1000, 20_000])
def test_likeness_follows_the_length(n):
    """One changed character costs little in a long text, more in a short one, with no step in between."""
    rng = np.random.default_rng(n)
    base = "".join(map(chr, rng.integers(97, 123, n)))
    a, b = phrase_prints.fingerprints([base, base[: n // 2] + "#" + base[n // 2 + 1 :]])
    assert phrase_prints.likeness(a, b) >= (0.9 if n >= 1000 else 0.6 if n >= 250 else 0)
    c = phrase_prints.fingerprints([base + "x"])[0]
    assert phrase_prints.likeness(a, c) >= (0.9 if n >= 1000 else 0.6 if n >= 250 else 0)


def scalar_level(x):
    """One level of parsing a single text, symbol by symbol."""
    runs = []
    for s in x:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    mask = (1 << 64) - 1

    def mix(v):
        v = ((v ^ (v >> 29)) * 0xBF58476D1CE4E5B9) & mask
        return v ^ (v >> 32)

    x = [s if n == 1 else mix((s + n * 0x9E3779B97F4A7C15) & mask) for s, n in runs]
    label = x
    for _ in range(3):
        new = []
        for i, s in enumerate(label):
            left = label[i - 1] if i else ~s & mask
            k = next(b for b in range(64) if (s ^ left) >> b & 1)
            new.append(2 * k + (s >> k & 1))
        label = new
    starts = [i for i in range(len(x)) if i == 0 or i + 1 < len(x) and label[i] < label[i - 1] and label[i] < label[i + 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(x)], strict=True):
        total = sum(s * pow(0x94D049BB133111EB, min(i, 63), 1 << 64) for i, s in enumerate(x[a:b])) + b - a
        out.append(mix(total & mask))
    return out


@cache
def scalar_print(text):
    """The fingerprint of one text by a plain parse."""
    x, level, names = [int(phrase_prints._BYTES[b]) for b in text.encode()], 0, set()
    while x:
        x, level = scalar_level(x), level + 1
        if level >= phrase_prints.FIRST_LEVEL:
            names |= {int(phrase_prints._mix(np.array([(v + level) & ((1 << 64) - 1)], np.uint64))[0]) >> 32 for v in x}
            if len(x) == 1:
                break
    return sorted(names)[: phrase_prints.LEAST]


def scalar_likeness(a, b):
    """Names that both texts have, of the least names of either."""
    a, b = scalar_print(a), scalar_print(b)
    least = sorted({*a, *b})[: phrase_prints.LEAST]
    return sum(x in a and x in b for x in least) / len(least) if a and b else float(a == b)


def test_prints_brute_force():
    """Fingerprints of texts among others against a plain parse of each."""
    rng = np.random.default_rng(12)
    texts = ["", "a", "aaaa" * 30, "ab", "naïve — 漢字 🙂", *("".join(map(chr, rng.integers(97, 101, int(rng.integers(1, 600))))) for _ in range(30))]
    for t, got in zip(texts, phrase_prints.fingerprints(texts), strict=True):
        assert got.tolist() == scalar_print(t), t


@pytest.mark.parametrize("hot", [7, None])
def test_hot_ids(spark, monkeypatch, hot):
    """An id that most rows share is cut into ranges; the order of its rows is that of the text hashes."""
    monkeypatch.setattr(phrase_prints, "ROWS_PER_RANGE", 10)
    docs = spark.createDataFrame([(hot if i % 3 else i, f"text {i} of this") for i in range(300)], "doc_id long, text string").repartition(5)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    rows.sort(key=lambda r: (-(r.doc_id if r.doc_id is not None else -(1 << 63)), r.h))
    want = Counter((r.doc_id, phrase_prints.edited(r.text, rows[(i + 1) % len(rows)].text)) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.edited_text) for r in phrase_prints.fingerprint_documents(docs).collect()) == want


def test_fingerprint_documents(odd, small, empty, monkeypatch):
    monkeypatch.setattr(phrase_prints, "ROWS_PER_RANGE", 5)
    for docs in (odd.select("doc_id", "text"), small.select("doc_id", "text"), odd.select("doc_id", "text").filter("doc_id = 5")):
        rows = [((r.doc_id if r.doc_id is not None else -(1 << 63)), r.doc_id, r.text or "") for r in docs.collect()]
        rows.sort(key=lambda r: -r[0])
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in phrase_prints.digests(phrase_prints.fingerprint_documents(docs)).collect())
        want = Counter()
        for i, (_, doc, text) in enumerate(rows):
            following, half = rows[(i + 1) % len(rows)][2], len(text) // 2
            new = text[: len(text) - half] + following[:half]
            name = b"".join(x.to_bytes(4, "big") for x in scalar_print(text)).hex()
            want[doc, len(text), hashlib.sha256(new.encode()).hexdigest(), name, scalar_likeness(text, new), scalar_likeness(text, following)] += 1
        assert got == want
    assert phrase_prints.fingerprint_documents(empty).count() == 0
