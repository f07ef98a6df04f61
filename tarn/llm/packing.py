"""Packing by power-of-two decomposition.

Every document, closed by an end id, is cut into pieces whose lengths are powers of two:
as many of `max_len` as fit, then one for every set bit of the rest, longest first. A
piece is a sequence by itself, so no sequence crosses documents and none needs padding;
sequences of equal length share a bucket and batch together as they are.

Defined results: a null or empty text has only the end id (one piece of length 1); a null
document id stays null; repeated rows are packed once each; an empty table gives no rows;
other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import Merges
from .chunk_ids import ChunkIds
from .common import binary_array, bounded_batches, held, text_slices, tidy

#: str.split() also cuts at these control characters, the tokenizer does not.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The public pattern of this tokenizer (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Bits of a sequence id below the bucket: partition (26) and row in it (33).
_BUCKET_SHIFT = 59


class WordIds(ChunkIds):
    """Ids of a word-end BPE tokenizer that drops white space, cached by chunk between spaces.

    Texts of plain Latin characters are lower-cased first, as the tokenizer does, and their
    chunks are cut into words and merged in batches; chunks of other texts are looked at one
    by one, and what is not plain (special tokens, combining marks, other scripts) goes to
    the library.
    """

    def __init__(self, path: str, **kw):
        import regex
        from tokenizers import Tokenizer

        super().__init__(**kw)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.table = Merges(json.load(f))
        self.plain = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]+").fullmatch
        self.other = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u017e]|<\\|").search
        self.words = regex.compile(WORDS).findall

    def chunks(self, text: str) -> list[str]:
        if not self.other(text):
            return text.lower().split()
        if any(c in text for c in _CONTROLS):
            return [text]
        return text.split()

    def encode_new(self, chunks):
        words, per, other = [], np.zeros(len(chunks), np.int64), {}
        for i, c in enumerate(chunks):
            if c.isalpha() and c.isascii():
                words.append(c.lower())
                per[i] = 1
                continue
            if "<|" in c or not self.plain(c):
                other[i] = np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32)
                continue
            c = c.lower()
            stem, last = c[:-1], c[-1]
            if stem.isalpha() and not last.isalnum():  # the commonest case: a word and one mark
                found = [stem, last]
            else:
                found = [c] if c.isalpha() else self.words(c)
            words += found
            per[i] = len(found)
        ranks, counts = self.table.encode_words([w.encode() for w in words]) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        lens = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per)])])
        ids = self.table.ids[ranks]
        if other:
            at = (np.cumsum(lens) - lens)[list(other)]
            ids = np.insert(ids, np.repeat(at, [len(x) for x in other.values()]), np.concatenate(list(other.values())))
            lens[list(other)] = [len(x) for x in other.values()]
        return ids, lens


def _word_ids(path: str) -> WordIds:
    return held(("word ids", path), lambda: WordIds(path))


def piece_lengths(counts: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the pieces of documents of `counts` tokens, and the document each belongs to."""
    bits = [1 << b for b in reversed(range(max_len.bit_length() - 1))]
    times = np.stack([counts // max_len, *((counts >> (b.bit_length() - 1)) & 1 for b in bits)], axis=1)
    doc, kind = np.nonzero(times)
    repeat = times[doc, kind]
    return np.repeat(np.array([max_len, *bits])[kind], repeat), np.repeat(doc, repeat)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    max_len: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (binary, little-endian uint32),
    doc_tokens, bucket (log2 of length), sequence_id, offset. Needs no shuffle."""
    bounded_batches(docs)
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches):
        encoder = _word_ids(tokenizer_path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, n = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                length, doc = piece_lengths(n, max_len)
                ends = np.concatenate([[0], np.cumsum(length)])
                start = ends[:-1] - (np.cumsum(n) - n)[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(doc)),
                        pa.array(start),
                        pa.array(length),
                        binary_array(ids.tobytes(), ends * 4),
                        pa.array(n[doc]),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )
        encoder.forget()
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2("length").cast("int")
    return pieces.select(
        "*",
        bucket.alias("bucket"),
        # sequences of one bucket have one range of ids; the row number in the scan tells them apart
        (F.shiftleft(bucket.cast("long"), _BUCKET_SHIFT) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store packed pieces with one folder for each sequence length."""
    pieces.write.partitionBy("bucket").parquet(path)


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
