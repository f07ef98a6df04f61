"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, over block-max inverted indexes.

Terms are the words of a text: runs of ASCII letters, ASCII digits and characters beyond
ASCII, in lower case. The vocabulary is every word of the labelled rows used, whatever the
size of the input; its document frequencies are counted over all documents. The labelled
rows used are a sample of at most `max_examples` rows, by hash of id: this bounds the index,
which is broadcast. Equal texts are one example, whose label is the mean of theirs. A word
that goes with one label weighs more, by 1 + z squared, where z is the deviation of its
toxic share, shrunk for rare words; words that no example has count nothing.

The index keeps its examples in blocks of `BLOCK` that have frequent words in common, and
the largest weight of each word in each block. A text's cosines over rare words are summed
from their postings; with the block maxima of its frequent words they bound every block,
and only blocks whose bound reaches the k-th best cosine found so far are computed. The
neighbours are exact: those that may be among the k best are computed again in double
precision. They vote with weights that fall with distance, the votes are calibrated by
isotonic regression on leave-one-out votes of the examples, and they are the evidence.

Defined results: null and empty texts, and texts without a word of any example, get the
toxic share of all examples, but less than the threshold, and no evidence; equal texts get
equal scores; without labelled rows of both classes every score is about their toxic share
(0 if there are none); repeated rows are scored once each; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import array_slices, bounded_batches, release, stored, text_slices, tidy

MAX_EXAMPLES = 4096
#: Bytes of their distinct words and counts at most.
MAX_BYTES = 64_000_000
NEIGHBOURS, EVIDENCE = 8, 5
#: Examples in a block, and texts that are looked up together.
BLOCK, BATCH = 64, 64
#: Words that so large a share of the examples have are bounded by blocks; the rest have postings.
FREQUENT_SHARE = 1 / 16
THRESHOLD = 0.3
_LETTERS = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
#: Cosines in single precision may be off by so much.
_SLACK = 1e-5


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges, one range after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Index:
    """Examples as rows of word weights: `starts` (of each row, and the end), terms and weights of length 1."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int):
        self.n, self.n_terms, self.starts, self.terms, self.weights = len(starts) - 1, n_terms, starts, terms.astype(np.int32), weights.astype(np.float32)
        self.blocks_met = self.blocks_computed = 0
        self.ready = False

    def __getstate__(self):
        kept = ("n", "n_terms", "starts", "terms", "weights", "blocks_met", "blocks_computed")
        return {k: self.__dict__[k] for k in kept} | {"ready": False}  # each worker makes the rest itself

    def _near_together(self, matrix: np.ndarray) -> np.ndarray:
        """The examples in an order in which neighbours have frequent words in common: halved
        again and again across the direction in which they differ most."""
        done, parts = [], [np.arange(self.n)]
        while parts:
            part = parts.pop()
            if len(part) <= BLOCK:
                done.append(part)
                continue
            x = matrix[part] - matrix[part].mean(axis=0)
            way = x[np.argmax((x * x).sum(axis=1))]
            for _ in range(8):
                way = x.T @ (x @ way)
                way /= max(float(np.sqrt((way * way).sum())), 1e-30)
            order = part[np.argsort(np.round(x @ way, 4), kind="stable")]
            half = -(-len(order) // (2 * BLOCK)) * BLOCK
            parts += [order[half:], order[:half]]
        return np.concatenate(done)

    def _prepare(self):
        sizes = np.bincount(self.terms, minlength=self.n_terms)
        frequent = np.flatnonzero(sizes >= max(self.n * FREQUENT_SHARE, 1))
        self.column = np.full(self.n_terms, -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        own = np.repeat(np.arange(self.n), np.diff(self.starts))
        column = self.column[self.terms]
        matrix = np.zeros((self.n, max(len(frequent), 1)), np.float32)
        matrix[own[column >= 0], column[column >= 0]] = self.weights[column >= 0]
        self.order = self._near_together(matrix)
        place = np.empty(self.n, np.int64)
        place[self.order] = np.arange(self.n)
        self.place_of = place
        self.n_blocks = -(-self.n // BLOCK)
        padded = np.zeros((self.n_blocks * BLOCK, matrix.shape[1]), np.float32)
        padded[: self.n] = matrix[self.order]
        blocks = padded.reshape(self.n_blocks, BLOCK, -1)
        self.blocks = np.ascontiguousarray(blocks.transpose(0, 2, 1))  # block x frequent word x example
        self.tops = np.ascontiguousarray(blocks.max(axis=1).T)  # frequent word x block
        rare = column < 0
        by = np.argsort(self.terms[rare], kind="stable")
        self.place, self.weight = place[own[rare]][by], self.weights[rare][by]
        self.cuts = np.concatenate([[0], np.cumsum(np.where(self.column < 0, sizes, 0))])
        self.work = np.zeros(self.n_terms)
        self.ready = True

    def nearest(self, cuts: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector (terms and weights between its cuts) the k nearest examples of a
        cosine over 0 and their cosines, best first, ties by number; `without`: an example to leave out of each."""
        if not self.ready:
            self._prepare()
        out = []
        for start in range(0, len(cuts) - 1, BATCH):
            stop = min(start + BATCH, len(cuts) - 1)
            own = slice(cuts[start], cuts[stop])
            row = np.repeat(np.arange(stop - start), np.diff(cuts[start : stop + 1]))
            barred = None if without is None else without[start:stop]
            close = self._candidates(stop - start, row, terms[own], weights[own], k, barred)
            for i in range(stop - start):
                mine = slice(cuts[start + i], cuts[start + i + 1])
                at = np.sort(self.order[np.flatnonzero(close[i])])
                cosine = self._cosines(terms[mine], weights[mine], at)
                at, cosine = at[cosine > 0], cosine[cosine > 0]
                best = np.argsort(-cosine, kind="stable")[:k]
                out.append((at[best], cosine[best]))
        return out

    def _candidates(self, n: int, row: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, barred: np.ndarray | None) -> np.ndarray:
        """vectors x places: which examples may be among the k best of each."""
        column = self.column[terms]
        query = np.zeros((n, self.tops.shape[0]), np.float32)
        query[row[column >= 0], column[column >= 0]] = weights[column >= 0]
        low, size = self.cuts[terms], self.cuts[terms + 1] - self.cuts[terms]
        at, width = ranges(low, size), self.n_blocks * BLOCK
        rare = np.bincount(np.repeat(row * width, size) + self.place[at], self.weight[at] * np.repeat(weights, size), n * width).reshape(n, width).astype(np.float32)
        rare[:, self.n :] = -1
        if barred is not None:
            rare[np.arange(n), self.place_of[barred]] = -np.inf
        bounds = rare.reshape(n, self.n_blocks, BLOCK).max(axis=2) + query @ self.tops
        total = np.full((n, self.n_blocks, BLOCK), -np.inf, np.float32)
        rare = rare.reshape(total.shape)

        def compute(wanted: np.ndarray):
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                of = np.flatnonzero(wanted[:, b])
                total[of, b] = rare[of, b] + query[of] @ self.blocks[b]

        def kth(values: np.ndarray) -> np.ndarray:
            return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k] if k <= values.shape[1] else np.full(n, -np.inf, np.float32)

        first = np.zeros((n, self.n_blocks), bool)
        np.put_along_axis(first, np.argsort(-bounds, axis=1, kind="stable")[:, :2], True, axis=1)
        compute(first)
        least = kth(total[first].reshape(n, -1))
        more = (bounds >= least[:, None] - _SLACK) & (bounds > 0) & ~first
        compute(more)
        self.blocks_met += n * self.n_blocks
        self.blocks_computed += int(first.sum() + more.sum())
        total = total.reshape(n, width)
        return (total >= kth(total)[:, None] - _SLACK) & (total > 0)

    def _cosines(self, terms: np.ndarray, weights: np.ndarray, examples: np.ndarray) -> np.ndarray:
        """Cosines with the given examples, in double precision and a fixed order of sums."""
        if not len(examples):
            return np.zeros(0)
        self.work[terms] = weights
        size = self.starts[examples + 1] - self.starts[examples]
        at = ranges(self.starts[examples], size)
        out = np.add.reduceat(self.work[self.terms[at]] * self.weights[at], np.cumsum(size) - size)
        self.work[terms] = 0
        return np.round(out, 9)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares rising steps through (x, y), as points for interpolation. Equal x are one point of their
    mean y, so the order of rows does not count."""
    at, place = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []  # sum of y, number, mean x
    for n, total, a in zip(np.bincount(place).tolist(), np.bincount(place, y).tolist(), at.tolist(), strict=True):
        pools.append([total, float(n), a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, right = pools.pop()
            m = pools[-1]
            pools[-1] = [m[0] + s, m[1] + n, (m[2] * m[1] + right * n) / (m[1] + n)]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Scorer:
    """A fitted model; small enough to broadcast (see MAX_EXAMPLES)."""

    def __init__(self, words: list[bytes], weight: np.ndarray, ids: np.ndarray, toxic: np.ndarray, examples: tuple[np.ndarray, np.ndarray, np.ndarray]):
        """words in order and what each weighs; examples (none empty): starts, word numbers and counts of the rows of ids and toxic."""
        self.words, self.weight, self.ids, self.toxic = b" ".join(words), weight, ids, toxic.astype(np.float64)
        self.number: dict[bytes, int] = {}
        self.share = float(toxic.mean()) if len(toxic) else 0.0
        self.blank = min(self.share, THRESHOLD / 2)
        self.index = None
        if len(ids):
            starts, numbers, counts = examples
            weights = (1 + np.log(counts)) * weight[numbers]
            weights /= np.repeat(np.sqrt(np.add.reduceat(weights**2, starts[:-1])), np.diff(starts))
            self.index = Index(starts, numbers, weights, len(words))
            found = self.index.nearest(starts, self.index.terms, weights, NEIGHBOURS, np.arange(len(ids)))
            self.x, self.y = isotonic(np.array([self.vote(*x) for x in found]), self.toxic)

    def __getstate__(self):
        return self.__dict__ | {"number": {}}

    def vote(self, examples: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1 / (0.05 + 1 - np.minimum(cosines, 1))
        return float(((weight * self.toxic[examples]).sum() + self.share) / (weight.sum() + 1))

    def vectors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cuts of the texts, and the word numbers and weights (of length 1) between them."""
        if not self.number:
            self.number = {w: i for i, w in enumerate(self.words.split())}
        words = [words_of(t) for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        term = np.fromiter(map(self.number.get, chain.from_iterable(words), repeat(-1)), np.int64, int(size.sum()))
        row = np.repeat(np.arange(len(texts)), size)[term >= 0]
        key, n = np.unique(row * len(self.weight) + term[term >= 0], return_counts=True)
        row, term = np.divmod(key, len(self.weight))
        w = (1 + np.log(n)) * self.weight[term]
        w /= np.sqrt(np.bincount(row, w * w, len(texts)))[row]
        return np.searchsorted(row, np.arange(len(texts) + 1)), term, w

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Score and evidence (example id, its label, cosine) of each text."""
        if self.index is None:
            return [(self.blank, [])] * len(texts)
        distinct = list(dict.fromkeys(texts))
        known = {}
        for text, (at, cosines) in zip(distinct, self.index.nearest(*self.vectors(distinct), NEIGHBOURS), strict=True):
            evidence = [(int(self.ids[i]), int(self.toxic[i] >= 0.5), float(c)) for i, c in zip(at[:EVIDENCE].tolist(), cosines.tolist(), strict=False)]
            known[text] = (float(np.interp(self.vote(at, cosines), self.x, self.y)) if len(at) else self.blank, evidence)
        return [known[t] for t in texts]

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        return self.scores([text])[0]


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learn from the labelled rows that are not held out; `labels` has doc_id and toxic. At most max_examples of
    them are examples, of at most max_bytes of distinct words together."""
    bounded_batches(docs)
    spark, rows = docs.sparkSession, _numbered(docs, id_col, text_col)
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    sample = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # bounds the broadcast
    examples = rows.join(F.broadcast(sample), "doc_id")

    def counted(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                found = [Counter(words_of(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("toxic"),
                        pa.array([b" ".join(c) for c in found], pa.binary()),
                        pa.array([np.fromiter(c.values(), np.int32, len(c)).tobytes() for c in found], pa.binary()),
                    ],
                    ["doc_id", "toxic", "words", "counts"],
                )

    found = examples.mapInArrow(counted, "doc_id long, toxic int, words binary, counts binary")
    # one version an id, and in order of hash no more than max_bytes of them: what reaches the driver is bounded in rows and bytes
    found = stored(found.groupBy("doc_id").agg(F.min(F.struct("words", "counts", "toxic")).alias("x")).select("doc_id", "x.*"))
    size = F.sum(F.length("words") + F.length("counts")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # max_examples rows of two numbers
    fits = found.select("doc_id", size.alias("size")).filter(F.col("size") <= max_bytes).select("doc_id")
    found = found.join(fits, "doc_id", "left_semi")
    # equal texts are one example
    found = found.groupBy("words", "counts").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic")).filter("length(words) > 0").orderBy("doc_id", "words").toArrow()
    ids, toxic = found.column("doc_id").to_numpy(), found.column("toxic").to_numpy()
    rows_of_words = [w.split() for w in found.column("words").to_pylist()]
    counts = np.frombuffer(b"".join(found.column("counts").to_pylist()), np.int32)
    starts = np.cumsum([0, *map(len, rows_of_words)])
    words = sorted(set().union(*rows_of_words))
    if not words:
        return Scorer([], np.zeros(0), ids, toxic, (starts, counts, counts))
    number = {w: i for i, w in enumerate(words)}
    numbers = np.fromiter(map(number.__getitem__, chain.from_iterable(rows_of_words)), np.int64, len(counts))
    del rows_of_words, number, found
    shared = spark.sparkContext.broadcast(b" ".join(words))

    def frequencies(batches):
        release()
        number = {w: i for i, w in enumerate(shared.value.split())}
        known, seen, df = number.keys(), 0, Counter()
        for batch in batches:
            for _, texts in text_slices(batch):
                for t in texts:
                    df.update(known & set(words_of(t)))
                seen += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([number[w] for w in df] + [-1], pa.int32()), pa.array([*df.values(), seen], pa.int64())], ["term", "n"])
        del number, known, df
        tidy()

    sums = rows.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a word at most
    df = np.zeros(len(words) + 1, np.int64)
    df[sums.column("term").to_numpy()] = sums.column("n").to_numpy()  # the last place holds the number of documents
    shared.destroy()
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    # how far a word's toxic share is from that of all examples; the 1 shrinks it where few have the word
    share = toxic.mean()
    n = np.bincount(numbers, minlength=len(words))
    n1 = np.bincount(numbers, np.repeat(toxic, np.diff(starts)), len(words))
    z = (n1 - n * share) / np.sqrt(n * share * (1 - share) * (1 - n / len(ids)) + 1)
    return Scorer(words, idf * (1 + z * z), ids, toxic, (starts, numbers, counts))


def score(docs: DataFrame, scorer: Scorer, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence (array of example id, its label, cosine). Needs no shuffle."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        release()
        model = shared.value
        for batch in batches:
            for part, texts in text_slices(batch):
                found = model.scores(texts)
                evidence = [[{"example": i, "toxic": y, "cosine": c} for i, y, c in e] for _, e in found]
                kind = pa.list_(pa.struct([("example", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, kind)], ["doc_id", "score", "evidence"])
        tidy()

    return _numbered(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, evidence array<struct<example:bigint,toxic:int,cosine:double>>")


def not_toxic(docs: DataFrame, scorer: Scorer, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is under THRESHOLD, with all their columns; rows of null
    and empty texts stay."""
    bounded_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def value(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        model = shared.value
        for text in batches:
            yield pa.array([s for _, texts in array_slices(text) for s, _ in model.scores(texts)], pa.float64())
        tidy()

    return docs.filter(value(F.col(text_col).cast("string")) < THRESHOLD)


def digests(scored: DataFrame) -> DataFrame:
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.col("evidence.example").alias("evidence")
    )
