"""Removal of repeated passages by winnowing over line hashes.

A line ends at a line break, after a sentence stop, before a capitalised word, after a word
whose last three bytes hash to a mark, and `LINE_WORDS` words after the last of these. So a
passage set into the middle of other text still consists of whole lines (but for its edges
in text without stops and capitals), and no line is long.

A window is a shortest run of lines of at least `min_words` words: from every line on, and
up to every line. Each line of a longer repeated run lies in a window of it. The least hash
of `GRAM` neighbouring lines is the fingerprint of a window (of the shortest window from its
first line on); windows of equal lines have equal ones, so a repeated run shares a
fingerprint for certain, and most windows in a row share theirs. Fingerprints met in two documents are matched; a match is extended both ways to the
windows that chose it, which are compared by 96 bits of all their lines. A line is deleted
exactly if it is part of a run of at least `min_words` words that stands as a whole in one
earlier place: in a document of lesser id, or before it (not overlapping) in its own. The
first occurrence (least id, then position) stays.

Defined results: null and empty texts and rows with a null id are returned as they are;
repeated rows are the same document, so neither loses text to the other; a text may become
empty; an empty table gives no rows. All columns of the input are kept, `n_lines_cut` is
added (or the name given).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_slices, binary_array, bounded_batches, fresh_names, release, stored, text_slices, tidy
from .ngram_join import BITMAP, bitmap_of

#: Most words of a line, and lines of which a fingerprint is made: fewer are met by chance too often.
LINE_WORDS, GRAM = 8, 3
#: Odd factors; hashes of runs are differences of sums of hash x factor ** place, modulo 2 ** 64.
_FACTOR, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_SPACE, _BREAK = b" \n"
_STOPS = np.isin(np.arange(256), list(b".!?"))
#: Whether two bytes begin with a capital letter of the Latin, Greek and Cyrillic alphabets (fixed values).
_CAPITAL = np.zeros(1 << 16, bool)
for _first, _last in ("AZ", "ÀÖ", "ØÞ", "ŒŒ", "ŸŸ", "ΑΩ", "АЯ"):
    for _letter in range(ord(_first), ord(_last) + 1):
        _code = chr(_letter).encode()
        _CAPITAL[int.from_bytes(_code.ljust(2, b"\0")) : int.from_bytes(_code.ljust(2, b"\xff")) + 1] = True


def line_places(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts with a line break between them; of the lines in it: starts, ends (exclusive), ends without the
    space after the last word, numbers of words, texts."""
    data = b"\n".join(texts)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    b = np.frombuffer(b"\n\n\n" + data + b"\n\n", np.uint8)
    gap = (b == _SPACE) | (b == _BREAK)
    at = np.flatnonzero(gap[3:-1])  # the last one is past the data
    ends_word = ~gap[at + 2]
    one = b[at + 2]
    two = np.where(gap[at + 1], 0, b[at + 1]).astype(np.uint32)  # 0: not of this word
    three = np.where(gap[at + 1], 0, b[at]).astype(np.uint32)
    three[gap[at]] = 0
    after = np.append(b[at[:-1] + 4], b"\0"[0]).astype(np.uint16)
    mark = ((three << 16 | two << 8 | one) * np.uint32(0x9E3779B1)) >> np.uint32(29) == 0  # after one word of eight
    mark &= ends_word
    capital = np.append(_CAPITAL[after[:-1] << 8 | b[np.minimum(at[:-1] + 5, len(b) - 1)]], False)
    cut = np.where(b[at + 3] == _BREAK, after != _BREAK, _STOPS[one] | capital | mark)
    between = np.searchsorted(at, ends)
    cut[between] = True
    place = np.arange(len(at))
    cut = np.flatnonzero((place - np.maximum.accumulate(np.where(cut, place, -1))) % LINE_WORDS == 0)
    end = at[cut] + 1
    end[np.searchsorted(cut, between)] -= 1
    start = np.concatenate([[0], at[cut[:-1]] + 1])
    bare = np.maximum(start, np.maximum.accumulate(np.where(ends_word, at, 0))[cut])
    words = np.diff(np.cumsum(ends_word)[cut], prepend=0)
    found = start < end
    start = start[found]
    return data, start, end[found], bare[found], words[found], np.searchsorted(ends, start, "right")


def lines_of(text: str) -> list[str]:
    """The lines of a text; joined they are the text."""
    data, start, end, *_ = line_places([text.encode()])
    return [data[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def hashed_lines(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, 128 bits (two columns) and texts of all lines."""
    import xxhash

    data, start, _, bare, words, row = line_places([t.encode() for t in texts])
    lines = [data[a:b] for a, b in zip(start.tolist(), bare.tolist(), strict=True)]
    return words, np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.uint64).reshape(-1, 2), row


def forward(upto: np.ndarray, row: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First lines and ends (exclusive) of the windows from every line on. `upto`: words before each line, and of all."""
    end = np.searchsorted(upto, upto[:-1] + min_words)
    on = np.flatnonzero(end <= np.searchsorted(row, row, "right"))
    return on, end[on]


def powers(base: int, n: int) -> np.ndarray:
    each = np.full(n + 1, base, np.uint64)
    each[0] = 1
    return np.multiply.accumulate(each)


def least_between(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The least of values[start:end] of each range (none empty), from minima of 1, 2, 4, ... neighbours."""
    out = np.empty(len(start), values.dtype)
    level = np.frexp(end - start)[1] - 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = level == k
        out[own] = np.minimum(values[start[own]], values[end[own] - (1 << k)])
        values = np.minimum(values[: -1 << k], values[1 << k :])
    return out


def chosen(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows from lines `start` on."""
    gram = np.zeros(max(len(h) - GRAM + 1, 0), np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(_FACTOR) + h[k : k + len(gram), 0]
    gram = (gram ^ gram >> np.uint64(32)) * np.uint64(_MIX)
    return least_between(gram ^ gram >> np.uint64(32), start, end - GRAM + 1)


def windows_of(texts: list[str], min_words: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: text, first line (numbered in its text), number of lines, fingerprint,
    and 128 bits of their lines (two columns). Windows of equal lines come in order of place."""
    words, h, row = hashed_lines(texts)
    upto = np.concatenate([[0], np.cumsum(words)])
    start, end = forward(upto, row, min_words)
    least = chosen(h, start, end)
    # windows up to a line that are none from a line on
    back = np.searchsorted(upto, upto[1:] - min_words, "right") - 1
    to = np.flatnonzero(back >= np.searchsorted(row, row))
    same = np.searchsorted(start, back[to])
    to, same = to[end[same] != to + 1], same[end[same] != to + 1]
    start, end, least = np.concatenate([start, start[same]]), np.concatenate([end, to + 1]), np.concatenate([least, least[same]])
    sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(h * powers(_FACTOR, len(h))[: len(h), None], axis=0, dtype=np.uint64)])
    run = (sums[end] - sums[start]) * powers(_INVERSE, len(h))[start, None]
    return row[start], start - np.searchsorted(row, row[start]), end - start, least, run


def again_in_text(row: np.ndarray, line: np.ndarray, n: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which windows do not overlap the first window of the same lines in their text."""
    key = run[:, 0] + row.astype(np.uint64) * np.uint64(_MIX)
    by = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[by][1:] != key[by][:-1]])[: len(by)]
    first = np.empty_like(by)
    first[by] = by[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return (line >= line[first] + n[first]) & (run[:, 1] == run[first, 1]) & (row == row[first])


def fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, key: the fingerprints of every text; neighbours that are equal once."""

    def run(batches):
        release()
        for batch in batches:
            for part, texts in text_slices(batch):
                words, h, row = hashed_lines(texts)
                start, end = forward(np.concatenate([[0], np.cumsum(words)]), row, min_words)
                row, least = row[start], chosen(h, start, end)
                # windows in a row mostly choose the same
                new = np.concatenate([[True], (least[1:] != least[:-1]) | (row[1:] != row[:-1])])[: len(row)]
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(row[new])), pa.array(least[new].view(np.int64))], ["doc", "key"])
        tidy()

    return docs.select("doc", "text").mapInArrow(run, "doc long, key long")


def shared_keys(prints: DataFrame) -> DataFrame:
    """key: fingerprints that two documents have."""
    return prints.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last").select("key")


def extended(docs: DataFrame, min_words: int, bitmap: np.ndarray) -> DataFrame:
    """doc, version, line, n, run, more: the windows around fingerprints that the bitmap may hold, and those that
    stand earlier in their document (run null): first line, number of lines, 96 bits of them."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP / 8 bytes

    def run(batches):
        release()
        for batch in batches:
            for part, texts in text_slices(batch):
                row, line, n, least, run = windows_of(texts, min_words)
                again = again_in_text(row, line, n, run)
                bit = least & np.uint64(BITMAP - 1)
                keep = np.flatnonzero(again | (held.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0))
                owner, own = pa.array(row[keep]), run[keep].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc").take(owner),
                        part.column("version").take(owner),
                        pa.array(line[keep], pa.int32()),
                        pa.array(n[keep], pa.int32()),
                        pa.array(own[:, 0].copy(), mask=again[keep]),
                        pa.array((own[:, 1] >> 32).astype(np.int32)),
                    ],
                    ["doc", "version", "line", "n", "run", "more"],
                )
        tidy()

    return docs.mapInArrow(run, "doc long, version long, line int, n int, run long, more int")


def repeated_runs(windows: DataFrame) -> DataFrame:
    """doc, version, line, n of the windows that stand in an earlier place."""
    across = windows.filter("run is not null")
    # the small side is written first: a join that reads it plainly can split a hot window
    firsts = across.groupBy("run", "more").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).filter("first_doc <> last_doc")
    across = across.join(stored(firsts.drop("last_doc")).hint("shuffle_hash"), ["run", "more"]).filter("doc > first_doc")
    return across.select("doc", "version", "line", "n").unionByName(windows.filter("run is null").drop("run", "more"))


def cut_lines(repeated: DataFrame) -> DataFrame:
    """doc, version, cut: numbers of the lines of repeated runs."""
    runs = repeated.groupBy("doc", "version").agg(F.collect_list(F.struct("line", "n")).alias("runs"))
    lines = F.transform("runs", lambda x: F.sequence(x["line"], x["line"] + x["n"] - 1))
    return runs.select("doc", "version", F.array_distinct(F.flatten(lines)).alias("cut"))


def without_lines(texts: list[str], cut: list[list[int]]) -> pa.Array:
    """The texts without the lines of these numbers."""
    data, start, end, _, _, row = line_places([t.encode() for t in texts])
    first = np.searchsorted(row, np.arange(len(texts)))
    kept = np.ones(len(start), bool)
    kept[[first[i] + k for i, own in enumerate(cut) for k in own]] = False
    step = np.zeros(len(data) + 1, np.int8)
    step[start[kept]] += 1
    step[end[kept]] -= 1
    left = np.frombuffer(data, np.uint8)[np.cumsum(step[:-1], dtype=np.int8) > 0]
    size = np.bincount(row[kept], (end - start)[kept], len(texts)).astype(np.int64)
    return binary_array(left.tobytes(), np.concatenate([[0], np.cumsum(size)])).cast(pa.string())


def dedup_lines(docs: DataFrame, *, min_words: int = 30, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_lines_cut") -> DataFrame:
    @F.arrow_udf("string")
    def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        release()
        for text, cut in batches:
            parts = [without_lines(texts, cut.slice(part.start, len(part)).to_pylist()) for part, texts in array_slices(text)]
            yield pa.concat_arrays([pa.array([], pa.string()), *parts])
        tidy()

    if min_words <= (GRAM - 1) * LINE_WORDS:
        raise ValueError(f"min_words must exceed {(GRAM - 1) * LINE_WORDS}, so that each window has {GRAM} lines")
    bounded_batches(docs)
    doc, version = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))
    rows = docs.filter(doc.isNotNull() & F.col(text_col).isNotNull()).select(doc.alias("doc"), version.alias("version"), F.col(text_col).alias("text"))
    names = fresh_names(docs, "doc", "version", "cut")
    shared = bitmap_of(shared_keys(fingerprints(rows, min_words)))
    cuts = stored(cut_lines(repeated_runs(stored(extended(rows, min_words, shared))))).toDF(*names)
    kept = [docs[c] for c in docs.columns]
    joined = docs.join(cuts, (doc == F.col(names[0])) & (version == F.col(names[1])), "left")
    # only cut texts go to Python
    new = F.when(F.col(names[2]).isNull(), docs[text_col]).otherwise(without(F.when(F.col(names[2]).isNotNull(), docs[text_col]), F.coalesce(names[2], F.array().cast("array<int>"))))
    return joined.select(*(new.alias(text_col) if n == text_col else c for n, c in zip(docs.columns, kept, strict=True)), F.coalesce(F.size(names[2]), F.lit(0)).alias(count_col))


def digests(deduped: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return deduped.select(
        "doc_id", "n_lines_cut", F.col("n_chars").alias("n_chars_before"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text.cast("binary"), 256).alias("text_sha256")
    )
