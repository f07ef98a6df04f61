"""Exact similarity join of word n-gram sets (Jaccard) by PartEnum signatures.

A text's set is its distinct shingles of five words, as in near_dup. Texts of equal sets are one class.
Sizes fall into bands. Two sets of sizes a <= b and similarity t or more differ in at most
k = (a + b)(1 - t) / (1 + t) elements, and b <= a / t; so an instance for the band of a, with the k of its
largest such pair, serves every pair whose smaller set is in the band. An instance cuts the
feature domain into n1 parts by hash, and each part into 3 cells; a signature is the content of
2 cells of one part. One difference spoils 2 of a part's 3 signatures and a second one the last, so k
differences leave at least 2 n1 - k (or 3 n1 - 2 k, where k <= n1) signatures equal: all but one of these
may be left out, as long as both sets leave out by one order. Left out are those of least content, so
that cells with nothing or one common shingle do not call texts together.

1. Signatures of all texts are aggregated by key to their least and greatest set (with map-side
   partial results); keys of one set only are dropped. No text is moved.
2. Signatures are made again and meet the shared keys. A bounded bitmap of these keys spares most
   of the others the shuffle; what it lets through by chance, the join drops. Keys with the
   same members are one.
3. Members are compared with their key's centre: sizes, then the number of odd bits of parity
   sketches, which never exceeds the number of differences, then full sets, in whole numbers.
4. After joining what was confirmed into components, texts of one key and different components are
   compared in blocks of bounded size, as in near_dup; only confirmed links become rows.
Every pair above the threshold is found: nothing here is left to chance but equal 64-bit shingle hashes.

Defined results: null, empty and white-space texts have an empty set and are linked with nothing;
repeated rows share a component; a null id is never linked (component_id null); an empty table
gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import near_dup
from .common import bounded_batches, release, stored, temporary, text_slices, tidy

#: Ratio of a band's ends, least and most bits of a sketch, bits of the bitmap of shared keys.
RATIO, LEAST_BITS, MOST_BITS, BITMAP = 1.4, 64, 1 << 16, 1 << 26
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_mix = near_dup._mix


@cache
def _bands(percent: int, largest: int) -> tuple[tuple[int, int, int, int, int], ...]:
    """(smallest, greatest size, band, parts, left out) of each instance that holds unequal pairs."""
    out, low, high, band = [], 0, 1, 0
    while low < largest:
        most = high * 100 // percent
        k = (high + most) * (100 - percent) // (100 + percent)
        if k:
            parts = k // 2 + 1 + -(-k // 10)
            equal = 3 * parts - 2 * k if k <= parts else 2 * parts - k
            out.append((low + 1, most, band, parts, equal - 1))
        low, high, band = high, max(high + 1, int(high * RATIO)), band + 1
    return tuple(out)


def signatures(shingle: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set (sorted, distinct) in all instances that hold its size."""
    n, keys = len(shingle), []
    weight = (_mix(shingle * _GOLD + np.uint64(1)) >> np.uint64(12)).astype(np.float64)
    high, cell = shingle >> np.uint64(32), (shingle & np.uint64(0xFFFFFFFF)) % np.uint64(3)
    for low, most, band, parts, out in _bands(percent, 1 << max(8, n.bit_length())):
        if not low <= n <= most:
            continue
        at = ((high * np.uint64(parts) >> np.uint64(32)) * np.uint64(3) + cell).view(np.int64)
        # a cell's content: the sum over its elements, which come in one order, so that equal cells have equal sums
        content = _mix(np.bincount(at, weight, 3 * parts).view(np.uint64) + np.arange(3 * parts, dtype=np.uint64) + np.uint64(band << 52)).reshape(parts, 3)
        key = _mix(content[:, [1, 0, 0]] * _GOLD + content[:, [2, 2, 1]]).ravel()  # without cell 0, 1, 2
        if out:
            count = np.bincount(at, minlength=3 * parts).reshape(parts, 3)
            order = (count.sum(axis=1)[:, None] - count).ravel() * (3 * parts) + np.arange(3 * parts)
            key = key[np.argpartition(order, out - 1)[out:]]
        keys.append(key)
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def sketch(shingle: np.ndarray) -> bytes:
    """Size of a set and, bit by bit, the parity of its elements' number: two sketches differ in at most
    as many bits as the sets in elements, also after both are folded to fewer bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingle) - 1).bit_length()))
    odd = np.bincount((shingle & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.int64(len(shingle)).tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, and parity bits of all sketches folded to the length of the shortest."""
    words = min(map(len, sketches)) // 8 - 1
    sizes, bits = np.empty(len(sketches), np.int64), np.empty((len(sketches), words), np.uint64)
    for i, s in enumerate(sketches):
        sizes[i] = np.frombuffer(s, np.int64, 1)[0]
        bits[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint64, offset=8).reshape(-1, words), axis=0)
    return sizes, bits


def _plausible(sizes: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows x, y may be similar enough, and how many bits they differ in (negative)."""
    a, b = sizes[x], sizes[y]
    at = np.flatnonzero(100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    odd = np.bitwise_count(bits[x[at]] ^ bits[y[at]]).sum(axis=1, dtype=np.int64)
    keep = odd * (100 + percent) <= (a[at] + b[at]) * (100 - percent)
    return at[keep], -odd[keep]


def open_pairs(table: pa.Table, percent: int):
    """For each group of the table: plausible pairs (row outside the largest component, other row) of
    different components, and their likeness."""
    group, label, minor = (table.column(c).to_numpy() for c in ("group", "label", "minor"))
    found = table.column("sig").to_pylist()
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        m, o = np.flatnonzero(minor[lo:hi]), np.flatnonzero(~minor[lo:hi])
        if not len(m) or not len(o):
            continue
        sizes, bits = _folded(found[lo:hi])
        own = label[lo:hi]
        rows = max(1, 65536 // len(o))
        for at in range(0, len(m), rows):
            i, j = np.nonzero(own[m[at : at + rows]][:, None] != own[o][None, :])
            x, y = m[at : at + rows][i], o[j]
            ok, likeness = _plausible(sizes, bits, x, y, percent)
            yield x[ok] + lo, y[ok] + lo, likeness


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key, name (64 bits of set_key), sig (sketch) of every text."""

    def run(batches):
        import xxhash

        release()
        for batch in batches:
            for part, texts in text_slices(batch):
                sets = [near_dup.shingles(t) for t in texts]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                        pa.array(np.frombuffer(b"".join(k[:8] for k in keys), np.int64)), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "name", "sig"],
                )
        tidy()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, name long, sig binary")


def keys_of(docs: DataFrame, percent: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """key, name: the signatures of every text, or those that the bitmap may hold."""
    held = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP / 8 bytes

    def run(batches):
        import xxhash

        release()
        for batch in batches:
            for _, texts in text_slices(batch):
                keys, names = [], []
                for text in texts:
                    s = near_dup.shingles(text)
                    key = signatures(s, percent)
                    if held is not None:
                        bit = key & np.uint64(BITMAP - 1)
                        key = key[held.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0]
                    if len(key):
                        keys.append(key)
                        names.append(np.full(len(key), np.frombuffer(xxhash.xxh3_128_digest(s.tobytes())[:8], np.int64)[0]))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(names))], ["key", "name"])
        tidy()

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "key long, name long")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """One bit for the low bits of each key: BITMAP bits, however many keys there are."""
    low = F.col("key").bitwiseAND(F.lit(BITMAP - 1))
    words = keys.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits"))
    found = words.toArrow()  # BITMAP / 64 rows at most
    out = np.zeros(BITMAP // 64, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def members_of(docs: DataFrame, percent: int) -> DataFrame:
    """key, centre, name: the sets of each key that more than one set has; of keys with the same
    sets, one."""
    spread = keys_of(docs, percent).groupBy("key").agg(F.min("name").alias("centre"), F.max("name").alias("last"))
    shared = stored(spread.filter("centre <> last").select("key", "centre"))
    again = keys_of(docs, percent, bitmap_of(shared))
    members = stored(again.join(shared, "key").distinct())
    # two sums of hashes and a count stand for a key's members
    same = [F.sum(F.xxhash64("name", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    kept = members.groupBy("key").agg(F.count("*").alias("n"), *same).groupBy("n", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    return members.join(kept, "key", "left_semi")


def prune(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b (nodes) of the names a, b whose sizes and sketches let them be similar, with their likeness."""

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("sig_a", "sig_b"))
            if a:
                likeness = np.full(len(a), 1)
                for i, pair in enumerate(zip(a, b, strict=True)):
                    sizes, bits = _folded(list(pair))
                    ok, found = _plausible(sizes, bits, np.array([0]), np.array([1]), percent)
                    if len(ok):
                        likeness[i] = found[0]
                rows = pa.array(np.flatnonzero(likeness <= 0))
                yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows), pa.array(likeness).take(rows)], ["a", "b", "likeness"])

    of = lambda side: classes.select(F.col("name").alias(f"name_{side}"), F.col("node").alias(side), F.col("sig").alias(f"sig_{side}"))
    both = pairs.join(of("a"), "name_a").join(of("b"), "name_b").filter("a <> b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, likeness long")


def similar_texts(docs: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id that links of `percent` or more reach) for every row."""
    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = stored(sets_of(rows))
    usable = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("name").alias("name"), F.first("sig").alias("sig")))

    with temporary(docs.sparkSession):
        members = stored(members_of(rows, percent))
        spokes = members.filter("name <> centre").select(F.col("centre").alias("name_a"), F.col("name").alias("name_b")).distinct()
        likely = stored(prune(spokes, classes, percent))
        links = stored(near_dup.confirm(likely, rows, percent, "doc_id", "text"))
        labels = stored(near_dup.components(links))
        shared = stored(members.join(classes.select("name", "node"), "name").select("key", "node"))
        new = near_dup.between_components(shared, labels, classes.select("node", "sig"), lambda table: open_pairs(table, percent), rows, percent, "doc_id", "text")
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(new)
        labels = stored(near_dup.components(links), keep=True)

    found = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("class_label"))
    placed = sets.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_label")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
