"""Texts in blocks of token keys: arrays that tasks count and score without a row a token.

A block holds some thousand spans. Its words are numbered, and each has a key of 64 bits: the sum of one random
number a position and byte, so that two given words share a key with probability 2^-64. A pair of neighbours has
a key made of theirs. Tokens are those of text.tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Bytes of text that are cut into words together, and of a block (a longer text is alone).
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 6 << 20
#: Bytes of an Arrow batch between executor and worker, where the session allows more.
BATCH_BYTES = 16_000_000
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, (65, 256), np.uint64)
_FLAT = _RANDOM.ravel()
_ALNUM, _JOINS = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
_JOINS[[*b"._'-"]] = True
_CUT = ~(_ALNUM | _JOINS)


def bounded_batches(df: DataFrame) -> None:
    """Keep the session's Arrow batches within BATCH_BYTES from now on; a lower setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        conf.set(key, f"{BATCH_BYTES}b")


def _buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of texts without nulls, and where each begins and the last ends."""
    wide = pa.types.is_large_string(strings.type)
    at = np.frombuffer(strings.buffers()[1], np.int64 if wide else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, np.int64)
    data = strings.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def _within(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes of all words: where they stand, their place in the word; and where each word's begin among them."""
    first = np.cumsum(size) - size
    n = int(size.sum())
    kind = np.int32 if n < 1 << 30 and (not len(start) or start.max() < 1 << 30) else np.int64
    count = np.arange(n, dtype=kind)
    return np.repeat((start - first).astype(kind), size) + count, count - np.repeat(first.astype(kind), size), first


def word_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Keys of the words (none empty) of a buffer."""
    if not len(start):
        return np.zeros(0, np.uint64)
    at, place, first = _within(start, size)
    long = size.max() > 64
    value = _FLAT.take(((place & 63 if long else place) << 8) | data.take(at))
    if long:  # a factor for each 64 places
        value = value * np.power(_RANDOM[64, 0] | np.uint64(3), (place >> 6).astype(np.uint64))
    return np.add.reduceat(value, first)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of neighbours."""
    x = a * (_RANDOM[64, 1] | np.uint64(1)) + (b ^ (b >> np.uint64(31))) * (_RANDOM[64, 2] | np.uint64(1))
    x ^= x >> np.uint64(29)
    x *= _RANDOM[64, 3] | np.uint64(1)
    return x ^ (x >> np.uint64(32))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ASCII_WORD begin in lower-cased bytes, and their sizes."""
    starts, ends, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(at + SLICE_BYTES, len(data))
        while end < len(data):  # to a byte that is in no word
            free = np.flatnonzero(_CUT[data[end : end + 4096]])
            end = end + int(free[0]) if len(free) else min(end + 4096, len(data))
            if len(free):
                break
        part = data[at:end]
        word = _ALNUM[part]
        if len(part) > 2:
            word = word.copy()
            word[1:-1] |= _JOINS[part[1:-1]] & _ALNUM[part[:-2]] & _ALNUM[part[2:]]
        turn = np.diff(np.concatenate([[0], word.view(np.int8), [0]]).astype(np.int8))
        starts.append(np.flatnonzero(turn == 1) + at)
        ends.append(np.flatnonzero(turn == -1) + at)
        at = end
    start = np.concatenate(starts)
    return start, np.concatenate(ends) - start


def texts(spans: DataFrame) -> DataFrame:
    """span_id, low, words of span_id, text: lower-cased texts that end in a space; those with CJK runs as words instead."""
    bounded_batches(spans)
    whole = F.coalesce(F.col("text"), F.lit(""))
    cjk = whole.rlike(T.CJK_RUN)
    none: Column = F.array().cast("array<string>")
    return spans.select("span_id", F.when(cjk, "").otherwise(F.concat(F.lower(whole), F.lit(" "))).alias("low"), F.when(cjk, T.tokens(whole)).otherwise(none).alias("words"))


@dataclass
class Tokens:
    """Words of some texts in order: n a text; row, key, start and size in data of each."""

    data: np.ndarray
    n: np.ndarray
    row: np.ndarray
    key: np.ndarray
    start: np.ndarray
    size: np.ndarray


def tokens(batch: pa.RecordBatch) -> Tokens:
    """Of rows of low, words (texts)."""
    data, ends = _buffer(batch.column("low"))
    start, size = _words(data)
    row = np.searchsorted(ends, start, "right") - 1
    parts = [word_keys(data, start[i : i + 50_000], size[i : i + 50_000]) for i in range(0, len(start), 50_000)]
    key = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    lists = batch.column("words")
    if len(words := lists.flatten()):
        extra, at = _buffer(words)
        row = np.concatenate([row, np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))])
        start, size, key = np.concatenate([start, at[:-1] + len(data)]), np.concatenate([size, np.diff(at)]), np.concatenate([key, word_keys(extra, at[:-1], np.diff(at))])
        data = np.concatenate([data, extra])
        order = np.argsort(row, kind="stable")
        row, start, size, key = row[order], start[order], size[order], key[order]
    return Tokens(data, np.bincount(row, minlength=batch.num_rows), row, key, start, size)


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of rows with BLOCK_BYTES of text, or one row."""
    for batch in batches:
        _, low = _buffer(batch.column("low"))
        words, lists = _buffer(batch.column("words").flatten())[1], batch.column("words")
        size = low[1:] + words[np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))] if len(words) > 1 else low[1:]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield batch.slice(at, end - at)
            at = end


def first_words(t: Tokens, at: np.ndarray) -> pa.Array:
    """The words at some places, as texts."""
    size = t.size[at]
    where, _, _ = _within(t.start[at], size)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(t.data[where])))


def packed(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed; the size comes first."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if raw else b"")


def unpacked(raw: pa.Scalar, kind: type) -> np.ndarray:
    held, size = raw.as_buffer(), np.dtype(kind).itemsize
    n = int.from_bytes(held[:8].to_pybytes(), "little")
    x = np.frombuffer(pa.Codec("zstd").decompress(held[8:], n), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(x.reshape(size, -1).T).view(kind).reshape(-1)


BLOCK = "block long, n_tokens long, n array<int>, codes binary, keys binary, crcs binary, sizes binary"


def blocks(spans: DataFrame) -> DataFrame:
    """block, ids, n_tokens, n (tokens a span), codes (of the tokens; frequent words have small ones), keys, crcs, sizes
    (of the distinct words by code) of span_id, text. The number of a block holds where the table is stored."""

    def run(batches):
        task, i = TaskContext.get().partitionId(), 0
        for part in parts(batches):
            t = tokens(part)
            keys, first, codes, often = np.unique(t.key, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            keys, first, codes = keys[order], first[order], np.argsort(order)[codes]
            raw, start, end = memoryview(t.data), t.start[first].tolist(), (t.start + t.size)[first].tolist()
            crcs = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(start, end, strict=True)), np.uint32, len(keys))
            ids = part.column("span_id")
            rows = [pa.array([task << 32 | i]), pa.array([len(codes)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(t.n.astype(np.int32)))]
            rows += [pa.array([packed(x)], pa.binary()) for x in (codes.astype(np.uint32), keys, crcs, t.size[first].astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *rows], ["ids", *(x.split()[0] for x in BLOCK.split(", "))])
            i += 1

    return texts(spans).mapInArrow(run, f"ids array<{spans.schema['span_id'].dataType.simpleString()}>, {BLOCK}")


@dataclass
class Block:
    """Spans as arrays: tokens a span (n), codes of the tokens, keys, CRC-32 and sizes of the distinct words."""

    ids: pa.Array
    n: np.ndarray
    codes: np.ndarray
    keys: np.ndarray
    crcs: np.ndarray
    sizes: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n)), self.n)


def read_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Block, pa.RecordBatch]]:
    """Each block, and its row."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            get = {c: row.column(c)[0] for c in ("ids", "n", "codes", "keys", "crcs", "sizes")}
            kinds = {"codes": np.uint32, "keys": np.uint64, "crcs": np.uint32, "sizes": np.uint32}
            yield Block(get["ids"].values, get["n"].values.to_numpy(zero_copy_only=False).astype(np.int64), **{c: unpacked(get[c], k) for c, k in kinds.items()}), row


def _shifts() -> list[np.ndarray]:
    """CRC-32 states by byte, moved on over 1, 2, 4, ... zero bytes."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, state >> 1 ^ np.uint32(0xEDB88320), state >> 1)
    table = np.stack([state, *(np.arange(256, dtype=np.uint32) << 8 * j >> 8 for j in (1, 2, 3))]).astype(np.uint32)
    out = [table]
    for _ in range(30):
        out.append(_moved(out[-1], out[-1]))
    return out


def _moved(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


_SHIFTS = _shifts()


def crc_joined(first: np.ndarray, then: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two texts in a row from theirs; `size`: bytes of the second."""
    out, bit = first.copy(), 0
    while (size >> bit).any():
        now = (size >> bit & 1).astype(bool)
        out[now] = _moved(_SHIFTS[bit], out[now])
        bit += 1
    return out ^ then


def _joined(crc: np.ndarray, tail: bytes) -> np.ndarray:
    return crc_joined(crc, np.full(len(crc), zlib.crc32(tail), np.uint32), np.full(len(crc), len(tail)))


def counted(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each code of each row once, by row and code: row, code, how often."""
    both = np.sort(row * max(codes, 1) + code)
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    row, code = np.divmod(both[first], max(codes, 1))
    return row, code, np.diff(np.append(first, len(both)))


@dataclass
class Pairs:
    """Pairs of neighbours in a block: the sorted keys, the words of each, and of each pair its row and code."""

    keys: np.ndarray
    a: np.ndarray
    b: np.ndarray
    row: np.ndarray
    code: np.ndarray


def pairs(block: Block) -> Pairs:
    row = block.rows
    both = row[:-1] == row[1:]
    a, b, row = block.codes[:-1][both], block.codes[1:][both], row[:-1][both]
    keys, first, code = np.unique(pair_keys(block.keys[a], block.keys[b]), return_index=True, return_inverse=True)
    return Pairs(keys, a[first], b[first], row, code)


def vectors(block: Block, two: Pairs, word_idf: np.ndarray, pair_idf: np.ndarray, dim: int) -> np.ndarray:
    """Hashed vectors of the spans, of length 1 or zero; weights by word and by pair."""
    out = np.zeros(len(block.n) * dim)
    pair_crc = crc_joined(_joined(block.crcs[two.a], b"#"), block.crcs[two.b], block.sizes[two.b])
    for row, code, crc, idf in ((block.rows, block.codes.astype(np.int64), block.crcs, word_idf), (two.row, two.code, pair_crc, pair_idf)):
        row, code, tf = counted(row, code, len(crc))
        signed = np.where(_joined(crc, b"|s") & 1, -idf, idf)
        out += np.bincount(row * dim + (crc % dim).astype(np.int64)[code], signed[code] * (1 + np.log(tf)), len(out))
    m = out.reshape(-1, dim)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted ones, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    near = np.zeros(1 << 20, bool)
    near[(sorted_keys >> np.uint64(44)).astype(np.int64)] = True
    open_ = np.flatnonzero(near[(keys >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(sorted_keys, keys[open_]), len(sorted_keys) - 1)
    out = np.full(len(keys), -1)
    out[open_] = np.where(sorted_keys[at] == keys[open_], at, -1)
    return out
