"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases level by level. Runs of one symbol become one
symbol; deterministic coin tossing then labels each symbol from the lowest bit in which it
differs from its left neighbour, three times over, which leaves labels from a handful of
values, unlike those of their neighbours; phrases start at the local minima. A phrase's
name hashes its symbols, and the names are the next level's symbols. Where phrases start
depends on a few symbols around only, so equal substrings get equal names inside, at any
offset. A fingerprint is the 64 least hashes of a text's phrase names from level 2 up, whatever
its length, in hexadecimal; likeness estimates the share of common names from two fingerprints.

The neighbour comparison needs the next document in descending id order: rows are dealt
into id ranges of similar row counts, compressed, and streamed in order; the row that
bounds a range is also sent to the range that needs it. An id that many rows share is cut
into ranges of text hashes.

Defined results: null is the empty text, whose fingerprint is empty and whose likeness is 1
to an empty text and 0 to others; equal texts have equal fingerprints; rows of one id are
ordered by a hash of the text, null ids come last; a single row is followed by itself; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, text_slices

LEAST = 64
FIRST_LEVEL = 2
ROWS_PER_RANGE, MAX_RANGES = 250, 20_000
_NULL_KEY = -(1 << 63)
_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix((np.arange(256, dtype=np.uint64) + _ONE) * _BASE)
_POWERS = np.array([pow(0x94D049BB133111EB, i, 1 << 64) for i in range(64)], np.uint64)


def _coin_toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 2k + bit k of x, for the lowest bit k in which x differs from its left neighbour."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]  # nothing to the left: differs in bit 0
    low = x ^ left
    low &= ~low + _ONE
    return (np.bitwise_count(low - _ONE).astype(np.uint64) << _ONE) | ((x & low) != 0)


def parse_level(x: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of sequences of symbols (one after another, told apart by owner)."""
    fresh = np.empty(len(x), bool)
    fresh[0] = True
    np.not_equal(x[1:], x[:-1], out=fresh[1:])
    fresh[1:] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(fresh)
    if len(at) < len(x):  # a run is one symbol, named by what repeats and how often
        run = np.diff(np.append(at, len(x))).astype(np.uint64)
        x, owner = x[at], owner[at]
        x = np.where(run > 1, _mix(x + run * _BASE), x)
    edge = np.empty(len(x), bool)
    edge[0] = True
    np.not_equal(owner[1:], owner[:-1], out=edge[1:])
    first = np.flatnonzero(edge)
    label = x
    for _ in range(3):
        label = _coin_toss(label, first)
    small = label.astype(np.uint8)
    start = edge.copy()
    start[1:-1] |= (small[1:-1] < small[:-2]) & (small[1:-1] < small[2:]) & ~edge[2:]
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, len(x)))
    inside = np.arange(len(x)) - np.repeat(at, size)
    names = _mix(np.add.reduceat(x * _POWERS[np.minimum(inside, 63)], at) + size.astype(np.uint64))
    return names, owner[at]


def phrase_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every text the LEAST least 32-bit hashes of its phrase names, ascending, one text
    after another, and how many each has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    x = _BYTES[np.frombuffer(b"".join(texts), np.uint8)]
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = []
    level = 0
    while len(x):
        x, owner = parse_level(x, owner)
        level += 1
        if level < FIRST_LEVEL:
            continue
        kept.append((owner.astype(np.uint64) << np.uint64(32)) | (_mix(x + np.uint64(level)) >> np.uint64(32)))
        # a text of one phrase is done
        alone = np.bincount(owner, minlength=len(texts)) <= 1
        more = ~alone[owner]
        x, owner = x[more], owner[more]
    both = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
    owner = (both >> np.uint64(32)).astype(np.int64)
    counts = np.bincount(owner, minlength=len(texts))
    rank = np.arange(len(both)) - np.repeat(np.cumsum(counts) - counts, counts)
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)[rank < LEAST], np.minimum(counts, LEAST)


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """Fingerprints in slices of bounded size; equal texts have equal ones."""
    out, part, size = [], [], 0
    for t in [*texts, None]:
        if part and (t is None or size + len(t) > 1_000_000):
            least, n = phrase_sets(part)
            out += np.split(least, np.cumsum(n)[:-1])
            part, size = [], 0
        if t is not None:
            part.append(t.encode())
            size += len(part[-1])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names among the least LEAST names of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:LEAST]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1])) / len(union)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Ranges:
    """Ranges of rows in ascending order of (key, ~tie), each given by its last place.

    `tops`: keys at equal shares of the rows; one that stands there often is cut by ties,
    which are hashes, into as many ranges."""

    def __init__(self, tops: list[int]):
        self.keys, n = np.unique(np.array(tops, np.int64), return_counts=True)
        width = lambda m: [int(x) for x in np.linspace(-(2.0**63), 2.0**63, m + 1)[1:-1]]
        self.cuts = {int(k): np.array(width(m), np.int64) for k, m in zip(self.keys.tolist(), n.tolist(), strict=True) if m > 1}
        self.last: dict[int, np.ndarray] = {}

    def part(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The part of its key that each row is in."""
        out = np.zeros(len(keys), np.int64)
        for k, cuts in self.cuts.items():
            at = np.flatnonzero(keys == k)
            out[at] = np.searchsorted(cuts, ~ties[at], "left")
        return out

    def found(self, rows: list[tuple[int, int, int]]) -> None:
        """Take in (key, part, least tie) of the parts that have rows; others go."""
        for k in self.cuts:
            parts = sorted((p, ~tie) for key, p, tie in rows if key == k)
            self.cuts[k] = np.array([self.cuts[k][p] for p, _ in parts[:-1]], np.int64)
            self.last[k] = np.array([q for _, q in parts], np.int64)

    def place(self, keys: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's range, and whether it may be the last of it."""
        at = np.searchsorted(self.keys, keys)
        last = self.keys[at] == keys
        part = self.part(keys, ties)
        for k, q in self.last.items():
            own = np.flatnonzero(keys == k)
            last[own] = q[part[own]] == ~ties[own]
        width = np.array([1 + len(self.cuts.get(k, ())) for k in self.keys.tolist()], np.int64)
        return (np.cumsum(width) - width)[at] + part, last

    @property
    def n(self) -> int:
        return len(self.keys) + sum(map(len, self.cuts.values()))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next."""
    bounded_batches(docs)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("tie"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    n_rows = docs.count()
    n_ranges = max(1, min(n_rows // ROWS_PER_RANGE, MAX_RANGES))
    shares = [(i + 1) / n_ranges for i in range(n_ranges)]
    tops = docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * n_ranges)).alias("tops"), F.max(key).alias("top")).first()
    # the greatest key is the last at share 1 already, unless the estimate is off
    ranges = Ranges([*(tops.tops or []), *([tops.top] if n_rows and tops.top not in tops.tops[-1:] else [])])
    if ranges.cuts:

        @F.arrow_udf("long")
        def part(keys: pa.Array, ties: pa.Array) -> pa.Array:
            return pa.array(ranges.part(keys.to_numpy(), ties.to_numpy()))

        hot = rows.filter(F.col("key").isin([*ranges.cuts])).select("key", "tie")
        parts = hot.groupBy("key", part("key", "tie").alias("part")).agg(F.min("tie").alias("tie")).collect()  # at most n_ranges rows
        ranges.found([(r.key, r.part, r.tie) for r in parts])

    def deal(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part, texts in text_slices(batch):
                keys = part.column("key").to_numpy()
                own, last = ranges.place(keys, part.column("tie").to_numpy())
                guest = np.flatnonzero(last)
                take = np.concatenate([np.arange(len(keys)), guest])
                packed = [squeeze(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own, (own[guest] + 1) % ranges.n]).astype(np.int32)),
                        pa.array(np.repeat(np.array([0, 1], np.int8), [len(keys), len(guest)])),
                        *(part.column(c).take(pa.array(take)) for c in ("key", "tie", "doc_id")),
                        pa.array([packed[i] for i in take.tolist()], pa.binary()),
                    ],
                    ["range", "guest", "key", "tie", "doc_id", "packed"],
                )

    def compare(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held = None  # the last row of the batch before
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = list(zip(*(part.column(c).to_pylist() for c in ("range", "guest", "doc_id")), [unpack(x).decode() for x in part.column("packed").to_pylist()], strict=True))
                if held is not None:
                    rows.insert(0, held)
                held = rows[-1]
                pairs = [(x, y[3]) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
                if not pairs:
                    continue
                texts = [x[3] for x, _ in pairs]
                nexts = [y for _, y in pairs]
                new = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
                every = list(dict.fromkeys([*texts, *nexts, *new]))
                prints = dict(zip(every, fingerprints(every), strict=True))
                name = lambda a: a.astype(">u4").tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[2] for x, _ in pairs], pa.int64()),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(new, pa.string()),
                        pa.array([name(prints[t]) for t in texts]),
                        pa.array([name(prints[t]) for t in new]),
                        pa.array([likeness(prints[t], prints[e]) for t, e in zip(texts, new, strict=True)], pa.float64()),
                        pa.array([likeness(prints[t], prints[n]) for t, n in zip(texts, nexts, strict=True)], pa.float64()),
                    ],
                    ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    dealt = rows.mapInArrow(deal, "range int, guest byte, key long, tie long, doc_id long, packed binary")
    ordered = dealt.repartition("range").sortWithinPartitions("range", "guest", F.desc("key"), "tie")
    return ordered.mapInArrow(
        compare, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def digests(prints: DataFrame) -> DataFrame:
    return prints.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
