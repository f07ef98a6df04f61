"""MinHash near-duplicate detection with sequential Bayesian verification.

A text's set is its distinct shingles of five words (A-Z lower-cased, words between ASCII
white space); with fewer words the whole sequence is one shingle. Texts of equal sets are
one class, so exact copies cost a map-side minimum only. Class signatures of 128 minima are
cut into 32 bands of 4; a pair of similarity 0.75 shares no bucket with probability 5e-6.

Candidates of a bucket are verified without emitting all its pairs:
1. every member against the bucket's centre (a random member, another in each bucket);
2. after joining what was confirmed into components, every member outside the bucket's
   largest component against members of other components, in blocks of bounded size.
   Pairs inside one component need no check: they cannot change it.
Signatures are compared 32 minima at a time, and a pair is dropped as soon as the posterior
probability of similarity 0.75 or more falls below `miss`. Survivors are confirmed on full
sets, in whole numbers. Components come from alternating large-star and small-star steps.

Defined results: null, empty and white-space texts have an empty set and are linked with
nothing; repeated rows share a component; a null id is never linked (component_id null,
kept); an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import binary_array, bounded_batches, release, stored, temporary, text_slices, tidy

WORDS = 5
HASHES, ROWS, STEP = 128, 4, 32
BLOCK = 1024
#: Ids that a broadcast may carry (16 MB of longs); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_RANDOM = np.random.default_rng(20240229)
_A = (_RANDOM.integers(0, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i, 1 << 64) for i in range(WORDS)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < WORDS:
        return _mix(np.array([(h * _POWERS[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(h) - WORDS + 1
    total = h[:n].copy()
    for i in range(1, WORDS):
        total += h[i : i + n] * _POWERS[i]
    return np.unique(_mix(total))


def signature(shingle: np.ndarray) -> np.ndarray:
    x = (shingle >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, (_A[:, None] * x[i : i + 4096] + _B[:, None]).min(axis=1), out=low)
    return low


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of all bands: (texts x bands)."""
    bands = signatures.reshape(len(signatures), -1, ROWS).astype(np.uint64)
    key = np.arange(1, bands.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = _mix(key + bands[:, :, i] + np.uint64(i + 1))
    return key.view(np.int64)


def least_matches(similarity: float, miss: float) -> list[int]:
    """For 32, 64, ... compared minima: fewest matches that keep a pair. Under a uniform
    prior, P(s >= t | m of n match) is the chance of at most m successes in n + 1 draws at t."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below = np.cumsum([comb(n + 1, j) * similarity**j * (1 - similarity) ** (n + 1 - j) for j in range(n + 1)])
        out.append(int(np.argmax(below >= miss)))
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the signature arrays that pass every look, and their matches."""
    at, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (a[at, part] == b[at, part]).sum(axis=1)
        keep = matches >= m
        at, matches = at[keep], matches[keep]
    return at, matches


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key, sig of every text."""

    def run(batches):
        import xxhash

        release()
        for batch in batches:
            for part, texts in text_slices(batch):
                sets = [shingles(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_key", "sig"],
                )
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def buckets_of(classes: DataFrame) -> DataFrame:
    """key, node for every band of every class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = bucket_keys(_signatures(batch.column("sig")))
                nodes = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, node long")


def prune(pairs: DataFrame, classes: DataFrame, least: list[int]) -> DataFrame:
    """Pairs a, b whose signatures pass the posterior bounds, with their matches."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, matches = plausible(_signatures(batch.column("sig_a")), _signatures(batch.column("sig_b")), least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at)), pa.array(matches)], ["a", "b", "matches"]
                )

    sig = classes.select("node", "sig")
    both = pairs.join(sig.withColumnsRenamed({"node": "a", "sig": "sig_a"}), "a").join(sig.withColumnsRenamed({"node": "b", "sig": "sig_b"}), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long, matches long")


def enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    merged = np.concatenate([x, y])
    merged.sort(kind="stable")
    common = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * common >= percent * (len(merged) - common)


def full_sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, shingles of the texts named. Their ids are broadcast while they are few enough,
    and joined by a shuffle otherwise."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                found = [shingles(t) for t in texts]
                ends = np.cumsum([0, *map(len, found)]) * 8
                yield pa.RecordBatch.from_arrays([part.column("node"), binary_array(b"".join(s.tobytes() for s in found), ends)], ["node", "shingles"])
        tidy()

    needed = stored(nodes.distinct())
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).join(needed, "node", "left_semi")
    return stored(texts.mapInArrow(run, "node long, shingles binary"))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs a, b that are similar enough on their full sets."""

    def check(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            ok = [enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    found = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, id_col, text_col)
    both = pairs.select("a", "b").join(found.toDF("a", "set_a"), "a").join(found.toDF("b", "set_b"), "b")
    return both.mapInArrow(check, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) connect it with. Nodes without edges are left out."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = mark
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        edges = stored(small.distinct())


def _by_group(batches, solve):
    """Feed solve() whole groups of batches that are sorted by group."""
    pending = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        pending = pa.concat_tables([pending, table]) if pending is not None else table
        group = pending.column("group").to_numpy()
        if not len(group) or group[0] == group[-1]:
            continue
        cut = int(np.flatnonzero(group != group[-1])[-1]) + 1
        yield from solve(pending.slice(0, cut))
        pending = pending.slice(cut)
    if pending is not None and pending.num_rows:
        yield from solve(pending)
    tidy()


def _open_pairs(table: pa.Table, least: list[int]):
    """For each group of the table: plausible pairs (row outside the largest component, other
    row) of different components, and their matches. A pair counts only in the first band
    that it shares, so that no two buckets take it up."""
    group, label, minor, key = (table.column(c).to_numpy() for c in ("group", "label", "minor", "key"))
    sig = _signatures(table.column("sig"))
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        m, o = lo + np.flatnonzero(minor[lo:hi]), lo + np.flatnonzero(~minor[lo:hi])
        if not len(m) or not len(o):
            continue
        band = int(np.flatnonzero(bucket_keys(sig[lo : lo + 1])[0] == key[lo])[0])
        i, j = np.nonzero(label[m][:, None] != label[o][None, :])
        i, j = m[i], o[j]
        for at in range(0, len(i), 65536):
            x, y = i[at : at + 65536], j[at : at + 65536]
            ok, matches = plausible(sig[x], sig[y], least)
            x, y = x[ok], y[ok]
            first = (sig[x].reshape(-1, HASHES // ROWS, ROWS) == sig[y].reshape(-1, HASHES // ROWS, ROWS)).all(axis=2).argmax(axis=1) == band
            yield x[first], y[first], matches[first]


def between_components(shared: DataFrame, labels: DataFrame, classes: DataFrame, open_pairs: Callable[[pa.Table], Iterator], docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between texts of one bucket and different components: as many as it takes to join
    the components that any pair of the bucket links, and at most one fewer than its components.

    A bucket's rows are dealt into blocks of about BLOCK; rows outside its largest component
    are also sent to every block, in blocks of their own. A task holds one pair of blocks.
    Signatures come first: open_pairs yields the plausible pairs of a table of group, label, minor,
    key and sig (classes: node, sig) as rows and their likeness. Full sets go only to rows with a
    plausible partner, and pairs are checked where they meet: none but confirmed links become rows."""

    def who(batches):
        def solve(table):
            found = [np.unique(np.concatenate([x, y])) for x, y, _ in open_pairs(table)]
            if found:
                rows = pa.array(np.unique(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([table.column(c).combine_chunks().take(rows) for c in ("group", "node")], ["group", "node"])

        yield from _by_group(batches, solve)

    def check(batches):
        def solve(table):
            node, label = (table.column(c).to_numpy() for c in ("node", "label"))
            sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            root, out = {}, []  # labels that links of this table have joined: one row a step of joining

            def find(x):
                while x in root:
                    x = root[x]
                return x

            for x, y, matches in open_pairs(table):
                for k in np.argsort(-matches, kind="stable").tolist():
                    a, b = int(x[k]), int(y[k])
                    one, two = find(int(label[a])), find(int(label[b]))
                    if one != two and enough(sets[a], sets[b], percent):
                        root[max(one, two)] = min(one, two)
                        out.append((int(node[a]), int(node[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])

        yield from _by_group(batches, solve)

    labelled = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    largest = (
        labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", F.col("label").alias("major"))).alias("top"))
    )
    sizes = mixed.join(largest, "key").select(
        "key",
        F.col("top.major").alias("major"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("minor_blocks"),
    )
    rows = stored(labelled.join(sizes, "key").withColumn("outside", F.col("label") != F.col("major")))

    def dealt(own: str, others: str, minor: bool) -> DataFrame:
        side = rows.filter("outside") if minor else rows
        block = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")  # of the type of "to": equal numbers must hash alike
        spread = side.withColumn("block", block).withColumn("to", F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        pair = ("to", "block") if minor else ("block", "to")
        return spread.select(F.xxhash64("key", *pair).alias("group"), "node", "label", F.lit(minor).alias("minor"), "key")

    both = stored(dealt("minor_blocks", "blocks", True).unionByName(dealt("blocks", "minor_blocks", False)))
    columns = ["group", "node", "label", "minor", "key", "sig"]
    ready = both.join(classes.select("node", "sig"), "node").select(*columns).repartition("group").sortWithinPartitions("group")
    open_ = stored(ready.mapInArrow(who, "group long, node long").distinct())
    found = full_sets(open_.select("node"), docs, id_col, text_col)
    again = both.join(open_, ["group", "node"], "left_semi").join(classes.select("node", "sig"), "node").join(found, "node")
    again = again.select(*columns, "shingles").repartition("group").sortWithinPartitions("group")
    return again.mapInArrow(check, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, percent: int = 75, miss: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    bounded_batches(docs)
    least = least_matches(percent / 100, miss)
    sets = stored(sets_of(docs, id_col, text_col))
    usable = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")))

    with temporary(docs.sparkSession):
        buckets = buckets_of(classes)
        # the member whose id is nearest to the key, bit by bit: a random centre, found by a plain minimum
        centres = buckets.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("c")).filter("n > 1")
        shared = stored(buckets.join(centres.select("key", F.col("c").bitwiseXOR(F.col("key")).alias("centre")), "key"))
        spokes = shared.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        likely = stored(prune(spokes, classes, least))
        # the best centre of each text first; the next step sees to the rest
        ends = likely.select(F.explode(F.array("a", "b")).alias("node"), F.struct(F.col("matches"), "a", "b").alias("p"))
        first = ends.groupBy("node").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
        links = stored(confirm(first, docs, percent, id_col, text_col))
        labels = stored(components(links))
        new = between_components(shared.select("key", "node"), labels, classes, lambda table: _open_pairs(table, least), docs, percent, id_col, text_col)
        links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(new)
        labels = stored(components(links), keep=True)

    found = classes.select("set_key", "node").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("class_label"))
    placed = sets.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("class_label")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return placed.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
