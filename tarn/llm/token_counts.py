"""Token counts of whole texts by a two-tier lookup on the map side.

The model's pieces hold the space mark only at their start, so a text's tokens are those of
its pre-tokens (a run of space marks and what follows), one by one. Tier one is a compact
table of the lengths of the most frequent pre-tokens, found by a pass over all documents:
each task keeps a bounded summary, and only these summaries are merged. It is broadcast;
its size is bounded by `table_size` pre-tokens of at most `MAX_CHARS` characters. Tier two
is a cache in each worker, bounded in bytes, filled by the library in batches; pre-tokens
over `MAX_CHARS` characters pass it by. No pre-token of a text is ever shuffled. A model
whose pieces hold the mark elsewhere is refused with a ValueError. The table and caches only save work: counts are exact without them.

Defined results: a null or empty text has 0 tokens; repeated rows are counted once each; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, held, release, text_slices, tidy

MARK = "▁"
MAX_CHARS = 48
#: Bytes of a worker's cache, and of what an entry takes beside its characters.
CACHE_BYTES, ENTRY_BYTES = 64_000_000, 150
_PRE_TOKENS = re.compile(f"[ {MARK}]+[^ {MARK}]*").findall


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first space mark; the library's dummy prefix stands for it."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " ":
        return [x[1:] for x in _PRE_TOKENS(" " + text)]
    return text.split(" ")


class PieceCounts:
    def __init__(self, path: str, words: list[str] = (), lens=(), limit: int = CACHE_BYTES):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        wrong = re.compile(f"[^{MARK}]{MARK}").search
        if any(wrong(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())):
            raise ValueError(f"{path}: pieces hold the space mark after their start, so a text is not the sum of its pre-tokens")
        self.first = dict(zip(words, map(int, lens), strict=True))
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.cache, self.size = dict(self.first), 0
        # a lone space mark; the library gives no token to an empty text
        self.cache[""] = len(self.library.encode("a ")) - len(self.library.encode("a"))

    def lengths(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(words, num_threads=1)]

    def count(self, texts: list[str]) -> list[int]:
        parts = [pre_tokens(t) for t in texts]
        new = list(set().union(*parts).difference(self.cache))
        self.cache.update(zip(new, self.lengths(new), strict=True))
        get = self.cache.__getitem__
        counts = [sum(map(get, p)) for p in parts]
        for word in new:
            if len(word) > MAX_CHARS:
                del self.cache[word]
            else:
                self.size += 4 * len(word) + ENTRY_BYTES
        if self.size > self.limit:
            self.reset()
        return counts


def frequent(docs: DataFrame, size: int, *, per_task: int = 8192, text_col: str = "text") -> DataFrame:
    """The most frequent pre-tokens of all documents: word, n. Rare ones may be missed."""

    def run(batches):
        release()
        seen: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch):
                for t in texts:
                    seen.update(pre_tokens(t))
                if len(seen) > 16 * per_task:
                    seen = Counter(dict(seen.most_common(4 * per_task)))
        top = [(w, n) for w, n in seen.most_common(per_task) if len(w) <= MAX_CHARS and "\0" not in w]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)


def count_tokens(
    docs: DataFrame, model_path: str, *, table_size: int = 32_768, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text."""
    bounded_batches(docs)
    spark = docs.sparkSession
    words = [r.word for r in frequent(docs, table_size, text_col=text_col).collect()]
    lens = np.array(PieceCounts(model_path).lengths(words), np.uint8)  # 48 characters are 192 bytes, a token has one at least
    compact = spark.sparkContext.broadcast(("\0".join(words), lens.tobytes()))

    token = uuid.uuid4().hex  # a worker keeps the counter of one call

    def run(batches):
        blob, sizes = compact.value
        counter = held(("piece counts", token), lambda: PieceCounts(model_path, blob.split("\0") if sizes else [], np.frombuffer(sizes, np.uint8)))
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(counter.count(texts), pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens"],
                )
        tidy()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
