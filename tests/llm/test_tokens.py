"""Packing, BPE and token counts against the libraries."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarn.llm import bpe, packing, token_counts
from tarn.llm.common import held

WORD, BYTE, PIECE = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXT = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeiou  \n.,'<|>endoftx")), max_size=60)


def plain(path):
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    return t


@pytest.fixture(scope="module")
def docs(odd, small):
    return odd.select("doc_id", "text").unionByName(small.selectExpr("doc_id + 100 as doc_id", "text"))


def test_pack(docs, empty):
    library = plain(WORD)
    pieces = packing.pack(docs, WORD).collect()
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id, np.array(ids, "<u4").tobytes()] += 1
    parts = defaultdict(list)
    for p in pieces:
        assert p.length == 1 << p.bucket and p.offset == 0 and len(p.ids) == 4 * p.length and p.length <= 2048
        parts[p.doc_id, p.doc_tokens].append(p)
    got = Counter()
    for (doc, n), own in parts.items():
        own.sort(key=lambda p: p.start)
        copies = sum(p.length for p in own) // n
        by = [own[i::copies] for i in range(copies)] if copies > 1 else [own]
        for one in by:
            assert [p.start for p in one] == np.cumsum([0] + [p.length for p in one])[:-1].tolist()
            got[doc, b"".join(p.ids for p in one)] += 1
    assert got == want
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    row = packing.digests(packing.pack(docs.filter("doc_id = 5"), WORD)).collect()[0]
    assert row.ids_crc32 == zlib.crc32(b"".join(p.ids for p in parts[5, row.doc_tokens] if p.start == row.start))
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 10_000])
def test_piece_lengths(n):
    lengths, doc = packing.piece_lengths(np.array([n, 1]), 2048)
    own = lengths[doc == 0].tolist()
    assert sum(own) == n and own == sorted(own, reverse=True)
    assert Counter(x for x in own if x < 2048) == Counter(1 << b for b in range(11) if n % 2048 >> b & 1)


CODECS = [(packing.WordIds(WORD), plain(WORD)), (bpe.SpeculativeBPE(BYTE), plain(BYTE))]


def test_buckets(spark, docs, tmp_path):
    """A folder a length, each piece in the one of its length."""
    pieces = packing.pack(docs, WORD)
    packing.write_buckets(pieces, f"{tmp_path}/packed")
    back = spark.read.parquet(f"{tmp_path}/packed")
    assert {f.name for f in (tmp_path / "packed").iterdir() if f.is_dir()} == {f"bucket={r.bucket}" for r in pieces.select("bucket").distinct().collect()}
    columns = ["doc_id", "start", "length", "ids", "bucket"]
    assert back.filter("length <> shiftleft(1L, bucket)").isEmpty() and back.select(columns).exceptAll(pieces.select(columns)).isEmpty() and back.count() == pieces.count()


@given(st.lists(TEXT, min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_ids_as_the_library(texts):
    for encoder, library in CODECS:
        ids, n = encoder.encode(texts)
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_merges_are_exact():
    """Vectorised merging against one merge at a time."""
    table = bpe.codec(BYTE).table
    merged = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(table.left, table.right, strict=True)) if r >= table.base}
    random.seed(4)
    words = ["".join(random.choice(("the", "an", "aaa", "z", "ing", "é")) for _ in range(random.randint(1, 9))).encode() for _ in range(300)]
    tokens, counts = table.merge(np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.array([len(w) for w in words]))
    for w, got in zip(words, np.split(tokens, np.cumsum(counts)[:-1]), strict=True):
        parts = list(w)
        while len(parts) > 1:
            best, at = min((merged.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [best]
        assert got.tolist() == parts
    first, second = np.random.default_rng(1).integers(0, len(table.left), (2, 4000))
    ok = table.compatible(first, second)
    for a, b, good in zip(first[:400].tolist(), second[:400].tolist(), ok.tolist(), strict=False):
        if table.whole[a] and table.whole[b]:
            symbols = np.frombuffer(table.bytes[a] + table.bytes[b], np.uint8).astype(np.int64)
            assert (table.merge(symbols, np.array([len(symbols)]))[0].tolist() == [a, b]) == good


def test_encode(docs, empty):
    library = plain(BYTE)
    for r in bpe.encode(docs, BYTE).join(docs.distinct().withColumnRenamed("text", "said"), "doc_id").collect():
        ids = library.encode(r.said or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs, BYTE).count() == docs.count() and bpe.encode(empty, BYTE).count() == 0


def test_token_counts(docs, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = Counter(tuple(r) for r in token_counts.count_tokens(docs, PIECE, table_size=500).collect())
    assert got == Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    assert token_counts.count_tokens(empty, PIECE).count() == 0


@given(st.lists(st.one_of(TEXT, st.text(alphabet="ab ▁\n", max_size=30)), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_counts_as_the_library(texts):
    counter = held(("test",), lambda: token_counts.PieceCounts(PIECE))
    assert counter.count(texts) == [len(counter.library.encode(t)) for t in texts]


def test_count_cache_is_bounded_in_bytes():
    """Few long or many short pre-tokens: the cache stays under its limit, long ones are never kept, counts stay exact."""
    counter = token_counts.PieceCounts(PIECE, ["the", "of"], [1, 1], limit=50_000)
    rng = random.Random(5)
    for i in range(30):
        texts = [" ".join(["the", "of", "x" * (10_000 + i), *("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))])]
        assert counter.count(texts) == [len(counter.library.encode(t)) for t in texts]
        assert counter.size <= 50_000 and max(map(len, counter.cache)) <= token_counts.MAX_CHARS
    assert {"the", "of"} <= counter.cache.keys() and len(counter.cache) < 50_000 / token_counts.ENTRY_BYTES + 3


def test_cache_keeps_frequent_chunks():
    """A cache over its limit drops rare chunks, keeps the frequent ones and stays exact."""
    encoder = packing.WordIds(WORD, limit=20_000)
    library = plain(WORD)
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join(["The", "of", *("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))]) for _ in range(3)]
        ids, n = encoder.encode(texts)
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
        assert encoder.size <= 20_000 + 200 * 170
    assert {"the", "of"} <= encoder.slots.keys()
