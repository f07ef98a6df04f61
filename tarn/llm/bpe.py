"""Byte-level BPE encoding by speculation and verification, and decoding.

Greedy longest match proposes tokens. A proposal is the BPE result exactly if every token
encodes to itself and every adjacent pair is compatible, that is, if encoding the bytes of
the pair gives the pair again. Pairs are tested all at once: the merges of both tokens are
undone step by step in rank order, and no merge across the border may come earlier. Only
words with a failing token or pair are merged exactly.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated
rows are encoded once each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunk_ids import ChunkIds
from .common import binary_array, bounded_batches, held, text_slices, tidy

#: White space as in Unicode's White_Space property (fixed values).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The public pattern of this tokenizer family (fixed value).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^SPACES\p{L}\p{N}]+|[SPACES]+(?![^SPACES])|[SPACES]+"
NEVER = 1 << 40


def byte_alphabet() -> dict[int, str]:
    """Byte -> the printable character that stands for it in the vocabulary file."""
    shown = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Merges:
    """Merge table of a byte-level BPE vocabulary.

    Tokens are numbered by rank: first the single bytes (and, where the vocabulary marks
    word ends, the bytes that end a word), then the merges in the order of the file.
    """

    def __init__(self, spec: dict):
        import ahocorasick

        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        names = [alphabet[b] + end for end in ([""] + [suffix] * bool(suffix)) for b in range(256)]
        self.marks_ends, self.base = bool(suffix), len(names)
        rank = {name: r for r, name in enumerate(names)}
        symbols = [chr(r) for r in range(self.base)]
        n = self.base + len(merges)
        self.left, self.right = np.arange(n), np.arange(n)
        for r, (x, y) in enumerate((m if isinstance(m, list) else m.split(" ") for m in merges), self.base):
            self.left[r], self.right[r] = rank[x], rank[y]
            symbols.append(symbols[rank[x]] + symbols[rank[y]])
            names.append(x + y)
            rank.setdefault(x + y, r)
        self.ids = np.array([vocab[x] for x in names], np.uint32)
        self.bytes = [bytes(ord(c) & 255 for c in x) for x in symbols]
        self.width = np.fromiter(map(len, symbols), np.int64, n)
        self._hash_pairs()
        self.trie = ahocorasick.Automaton()
        for r, x in enumerate(symbols):
            self.trie.add_word(x, r)
        self.trie.make_automaton()
        tokens, counts = self.merge(np.frombuffer("".join(symbols).encode("utf-32-le"), np.uint32).astype(np.int64), self.width)
        first = np.cumsum(counts) - counts
        self.whole = (counts == 1) & (tokens[np.minimum(first, len(tokens) - 1)] == np.arange(n))

    def _hash_pairs(self) -> None:
        """Open addressing: pair of ranks -> rank of its merge, in two flat arrays."""
        self.bits = 20
        size = 1 << self.bits
        keys = (self.left[self.base :] << 32) | self.right[self.base :]
        self.keys, self.ranks, self.probes = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64), 1
        for r, (k, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True), self.base):
            tries = 1
            while self.keys[slot] not in (-1, k):
                slot, tries = slot + 1, tries + 1
            if self.keys[slot] == -1:
                self.keys[slot], self.ranks[slot] = k, r
                self.probes = max(self.probes, tries)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NEVER where there is none."""
        keys = (a << 32) | b
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ranks[slot], NEVER)
        for _ in range(1, self.probes):
            slot = slot + 1
            out = np.where(self.keys[slot] == keys, self.ranks[slot], out)
        return out

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of many words at once: each round makes, in every word that still has
        one, the merge of least rank, at all its places from the left. `symbols` holds the
        words one after another, `sizes` their lengths (none empty)."""
        counts = sizes.astype(np.int64).copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        words, tok = np.arange(len(sizes)), symbols
        owner = np.repeat(words, counts)
        while len(tok):
            edge = owner[1:] == owner[:-1]
            rank = np.full(len(tok), NEVER)
            rank[:-1][edge] = self.pair_rank(tok[:-1][edge], tok[1:][edge])
            starts = np.flatnonzero(np.concatenate([[True], ~edge]))
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.append(starts, len(tok)))
            over = best == NEVER
            if over.any():
                gone = np.repeat(over, size)
                done.append((owner[gone], tok[gone]))
                tok, owner, rank, best, size = tok[~gone], owner[~gone], rank[~gone], best[~over], size[~over]
                if not len(tok):
                    break
            hit = rank == np.repeat(best, size)
            if (close := hit[1:] & hit[:-1]).any():  # a run x x x: take every second place from the run's start
                at = np.flatnonzero(hit)
                fresh = np.concatenate([[True], ~close[at[1:] - 1] | (at[1:] - at[:-1] > 1)])
                index = np.arange(len(at))
                nth = index - np.maximum.accumulate(np.where(fresh, index, 0))
                hit[at[nth % 2 == 1]] = False
            tok = np.where(hit, rank, tok)
            keep = np.ones(len(tok), bool)
            keep[1:] = ~hit[:-1]
            tok, owner = tok[keep], owner[keep]
        owners, toks = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owners, kind="stable")
        return toks[order], np.bincount(owners, minlength=len(sizes))

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether BPE of the symbols of both tokens is these two tokens, for arrays of pairs.

        Merges are undone from the last on: the border token made later is split, and its
        part at the border takes its place. A merge across the border that is earlier than
        the merge undone last would have been made, so the pair fails.
        """
        ok = np.ones(len(first), bool)
        at, a, b = np.arange(len(first)), first.copy(), second.copy()
        limit = np.full(len(first), NEVER)
        while len(at):
            clash = self.pair_rank(a, b) < limit
            ok[at[clash]] = False
            split_b = (b >= a) & (b >= self.base)  # of equal ranks the right one was made last
            split_a = ~split_b & (a >= self.base)
            live = ~clash & (split_a | split_b)
            at, a, b, split_a, split_b = at[live], a[live], b[live], split_a[live], split_b[live]
            limit = np.where(split_b, b + 1, a)
            a, b = np.where(split_a, self.right[a], a), np.where(split_b, self.left[b], b)
        return ok

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the tokens of the words (none empty), and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.marks_ends:
            symbols[ends - 1] += 256
        # words one after another with a code between them that no token has
        gapped = np.insert(symbols, ends[:-1], self.base).astype("<u4").tobytes().decode("utf-32-le")
        tokens = np.fromiter(map(itemgetter(1), self.trie.iter_long(gapped)), np.int64)
        word = np.searchsorted(ends, np.cumsum(self.width[tokens]))
        bad = np.zeros(len(words), bool)
        bad[word[~self.whole[tokens]]] = True
        inside = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique((tokens[inside] << 32) | tokens[inside + 1], return_inverse=True)
        bad[word[inside[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        counts = np.bincount(word, minlength=len(words))
        if not bad.any():
            return tokens, counts
        exact, exact_counts = self.merge(symbols[np.repeat(bad, sizes)], sizes[bad])
        good = ~bad[word]
        counts[bad] = exact_counts
        out = np.empty(int(counts.sum()), np.int64)
        own = np.repeat(~bad, counts)
        out[own], out[~own] = tokens[good], exact
        return out, counts


class SpeculativeBPE(ChunkIds):
    """Whole texts: special strings, then segments (a space and what is not space), then words."""

    def __init__(self, path: str, **kw):
        import re

        import regex

        super().__init__(**kw)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.table = Merges(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.segments = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
        self.words = regex.compile(WORDS.replace("SPACES", SPACES)).findall
        self.by_id = dict(zip(self.table.ids.tolist(), self.table.bytes, strict=True)) | {i: s.encode() for s, i in self.special.items()}

    def chunks(self, text: str) -> list[str]:
        if self.special_at and any(s in text for s in self.special):
            return [c for i, part in enumerate(self.special_at.split(text)) for c in ([part] if i % 2 else self.segments(part))]
        return self.segments(text)

    def encode_new(self, chunks):
        special = {i: self.special[c] for i, c in enumerate(chunks) if c in self.special} if self.special else {}
        words, per = [], np.empty(len(chunks), np.int64)
        for i, c in enumerate(chunks):
            if i in special:
                per[i] = 0
            elif c.isalpha() or c[0] == " " and c[1:].isalpha():
                words.append(c.encode())
                per[i] = 1
            else:
                found = self.words(c)
                words += [w.encode() for w in found]
                per[i] = len(found)
        ranks, counts = self.table.encode_words(words) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids = self.table.ids[ranks]
        lens = np.diff(np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(per)])])
        if special:
            at = (np.cumsum(lens) - lens)[list(special)]
            ids = np.insert(ids, at, list(special.values()))
            lens[list(special)] = 1
        return ids, lens

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str) -> SpeculativeBPE:
    return held(("byte ids", path), lambda: SpeculativeBPE(path))


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), decoded (text of these ids). Needs no shuffle."""

    def run(batches):
        bpe = codec(tokenizer_path)
        for batch in batches:
            for part, texts in text_slices(batch):
                ids, n = bpe.encode(texts)
                ends = np.concatenate([[0], np.cumsum(n)])
                every = ids.tolist()
                decoded = [bpe.decode(every[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), binary_array(ids.astype("<u4").tobytes(), ends * 4), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )
        bpe.forget()
        tidy()

    bounded_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
