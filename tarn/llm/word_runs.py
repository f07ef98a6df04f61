"""Periodic runs of words, by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are identical) and at least
2q words that no neighbouring word extends. All runs of a text are found:
1. periods below SHORT by scanning each lag directly;
2. for each scale W = SHORT, 2 SHORT, ... the periods of W to 2W - 1: windows of W words choose
   the least hash among their grams of W / 2 words. A window and the window one period later
   hold the same words, so both their choices are the same gram, a period apart. Equal
   grams at such a distance are seeds; the words at that lag are then compared both ways.
   Grams with a period of at most W / 4 are not chosen (they lie in runs that are known by
   then), so that equal choices are more than W / 4 apart and no more than seven can follow
   one within 2W: constant text makes no more seeds than other text;
3. if all grams of a period are of that kind, the run joins two runs of one shorter period that
   touch; its periods are counted from where these two begin and end.
Hashes only propose: every run is confirmed on whole words. A text is one unit of work: about
30 bytes a word are held for a slice of texts of bounded size, or for one longer text.

Defined results: null, empty and white-space texts have no words and no runs; every row of the
input gives one row, repeated rows and null ids too; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, release, text_slices, tidy

SHORT = 16
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_MANY = np.uint64(0xFFFFFFFFFFFFFFFF)


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of True of at least that length."""
    at = np.flatnonzero(equal)
    if len(at) < least:
        return at[:0], at[:0]
    cut = np.flatnonzero(at[1:] != at[:-1] + 1)
    begin = at[np.concatenate([[0], cut + 1])]
    end = at[np.concatenate([cut, [len(at) - 1]])] + 1
    long = end - begin >= least
    return begin[long], end[long]


def _least_in_windows(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of that width, from running minima of blocks both ways."""
    n = len(v)
    padded = np.full(-(-n // width) * width, _MANY)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def _joined(x: np.ndarray, lo: int, hi: int, one: tuple, two: tuple, p: int, low: int, high: int):
    """Runs of period low to high - 1 over two touching runs [c, d) and [e, f) of period p."""
    (c, d), (e, f) = one, two
    first, both = x[c : c + p].tobytes(), x[e : e + 2 * p].tobytes()
    shift = both.find(first)
    while shift >= 0 and shift % x.itemsize:
        shift = both.find(first, shift + 1)
    if shift < 0:
        return
    phase = (e - c + shift // x.itemsize) % p
    for q in range(low + (phase - low) % p, min(high, d - c + p, f - e + p), p):
        i, j = max(c, e - q), min(d, f - q)
        if i >= j:
            continue
        while i > lo and x[i - 1] == x[i - 1 + q]:
            i -= 1
        while j + q < hi and x[j] == x[j + q]:
            j += 1
        if j - i >= q:
            yield i, j + q, q


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """For each text, as numbers of words: (start, length, period) of all its runs, in order."""
    order = sorted(range(len(texts)), key=lambda t: -len(texts[t]))  # longest first: a scale's texts are a prefix
    sizes = np.array([len(texts[t]) for t in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a word of its own ends each text
    x = np.empty(starts[-1], np.int64)
    for k, t in enumerate(order):
        x[starts[k] : starts[k] + sizes[k]] = texts[t]
        x[starts[k] + sizes[k]] = -1 - k
    found: dict[tuple[int, int], int] = {}  # (begin, end) -> least period

    def add(begin: int, end: int, q: int) -> None:
        if found.get((begin, end), end) > q:
            found[begin, end] = q

    for q in range(1, SHORT):
        for begin, end in zip(*_stretches(x[q:] == x[:-q], q), strict=True):
            add(int(begin), int(end) + q, q)

    gram, hashes = 1, _mix(x.view(np.uint64) + np.uint64(1))
    scale = SHORT
    while len(sizes) and sizes[0] >= 2 * scale:
        n = int(starts[np.searchsorted(-sizes, -2 * scale, "right")])
        while gram < scale // 2:
            ahead = np.concatenate([hashes[gram:], _mix(np.arange(len(hashes) - gram, len(hashes), dtype=np.uint64) + _MANY // np.uint64(3))])[: len(hashes)]
            hashes, gram = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + ahead), gram * 2
        hashes, words = hashes[:n], x[:n]
        short = [(b, e, q) for (b, e), q in found.items() if q <= gram // 2 and e - b >= gram and b < n]
        step = np.zeros(n + 1, np.int32)
        for b, e, _ in short:
            step[b] += 1
            step[e - gram + 1] -= 1
        bits = np.uint64(n.bit_length())
        packed = ((hashes >> bits) << bits) | np.arange(n, dtype=np.uint64)
        packed[np.cumsum(step[:n]) > 0] = _MANY
        least = _least_in_windows(packed, scale - gram + 1)
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        chosen = np.unique((least[least != _MANY] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64))

        key = hashes[chosen]
        by_key = np.argsort(key, kind="stable")
        key, at = key[by_key], chosen[by_key]
        seeds = []
        for j in range(1, 8):
            same = np.flatnonzero(key[j:] == key[:-j]) if len(key) > j else ()
            if not len(same):
                break
            lag = at[same + j] - at[same]
            fit = (lag >= scale) & (lag < 2 * scale)
            seeds.append(np.stack([np.searchsorted(starts, at[same[fit]], "right") - 1, lag[fit]]))
        if seeds:
            for k, q in np.unique(np.concatenate(seeds, axis=1), axis=1).T.tolist():
                lo, hi = int(starts[k]), int(starts[k] + sizes[k])
                if hi - lo >= 2 * q:
                    for begin, end in zip(*_stretches(words[lo + q : hi] == words[lo : hi - q], q), strict=True):
                        add(lo + int(begin), lo + int(end) + q, q)

        touching = sorted((q, b, e) for b, e, q in short if e - b >= scale)
        for (p, c, d), (p2, e, f) in zip(touching, touching[1:], strict=False):
            if p == p2 and e <= d:
                k = int(np.searchsorted(starts, c, "right")) - 1
                for run in list(_joined(words, int(starts[k]), int(starts[k] + sizes[k]), (c, d), (e, f), p, scale, 2 * scale)):
                    add(*run)
        scale *= 2

    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (begin, end), q in sorted(found.items(), key=lambda r: (r[0][0], r[1])):
        k = int(np.searchsorted(starts, begin, "right")) - 1
        out[order[k]].append((begin - int(starts[k]), end - begin, q))
    return out


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The stated edit: every tenth id, by its hash, gets a tail that repeats a few of its words."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def word_runs(docs: DataFrame, *, least: int = 12, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed: for each
    row the runs of at least `least` words, and its words without what runs repeat (of
    a run, its first period stays), joined by one space. `edit` may change the words first."""
    bounded_batches(docs)

    def run(batches):
        release()
        for batch in batches:
            for part, texts in text_slices(batch):
                ids = part.column("doc_id").to_pylist()
                words = [t.encode().split() for t in texts]
                if edit:
                    words = [edit(i, w) for i, w in zip(ids, words, strict=True)]
                numbers = _Ids()
                found = find_runs([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words])
                runs, kept = [], []
                for w, r in zip(words, found, strict=True):
                    r = [{"start": s, "length": n, "period": q} for s, n, q in r if n >= least]
                    runs.append(r)
                    if r:
                        step = np.zeros(len(w) + 1, np.int64)
                        for x in r:
                            step[x["start"] + x["period"]] += 1
                            step[x["start"] + x["length"]] -= 1
                        w = [w[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                    kept.append(b" ".join(w))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(runs, pa.list_(_RUN)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
                )
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """One row a document: count of runs, its longest run, digests of all runs and of what is kept."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = found.withColumns({"best": best, "lines": F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")})
    length, period = F.col("best.length"), -F.col("best.less")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.less").alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
