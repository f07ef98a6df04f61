"""Whitening of embeddings: leading components by contour integration (FEAST).

Entries c become whole numbers x = floor(256 c). The fit list holds each distinct x vector once
(an aggregation on the whole vector, so copies cost a map-side step only). Count, exact sums and the
centred second moments are added up over it by tasks; what reaches the driver has the size of
the dimensions, never of the rows. There the d x d covariance V is solved:
1. V is brought to tridiagonal form once; inertia counts of shifted matrices (signs of the
   pivots of T - t I) tell how many eigenvalues exceed t, and bisection finds an interval around
   each leading one, or around those that are close to each other;
2. quadrature on the circle over an interval applies sum of w_j Re(r e^{i a_j} (z_j I - V)^-1) to a
   random block: a filter that keeps the interval's eigenspace and damps the rest;
3. Rayleigh-Ritz in the filtered block gives components; the two steps repeat until residuals
   are at the last digits and the count in the interval is the inertia's, so none is missed.
All rows are then projected in one pass over the table.

Defined results: rows whose vector is null, holds null or non-finite entries or entries too large for a
whole number (2^54 or more) go, as do vectors whose length is not the commonest (the greater of
equals). Repeated rows and null ids stay. Components of eigenvalue 0 (no spread; fewer distinct
vectors than components) are left out, so that a table of equal vectors or an empty one gives no
rows. `deviation` beyond 38 digits is null. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, release, stored, tidy

SCALE = 256
#: Points of the half circle, columns of the block beside twice the wanted ones, rounds of the filter.
POINTS, SPARE, ROUNDS = 8, 4, 60
#: Eigenvalues closer than this share of their size are sought together.
NEAR = 1e-4


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x of the rows whose vector is whole and of the commonest length."""
    v = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = v.filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**54)))
    lengths = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d")).alias("top")).select(F.col("top.d").alias("d"))
    fine = fine.join(F.broadcast(lengths), F.size("v") == F.col("d"))  # one row
    return fine.select("vec_id", F.transform("v", lambda c: F.floor(c * float(SCALE)).cast("long")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches):
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                part = [int(h) * (1 << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
                n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array(map(Decimal, [n, *sums]), pa.decimal128(38, 0))], ["dim", "total"])

    found = fit.mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).orderBy("dim").collect()  # a row a dimension
    return (int(found[0].total), [int(r.total) for r in found[1:]]) if found else (0, [])


def _centred(x: np.ndarray, floor: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x less the mean, which is whole numbers `floor` and fractions `rest`."""
    return (x - floor).astype(np.float64) - rest


def moments(fit: DataFrame, n: int, mean: tuple[np.ndarray, np.ndarray], onto: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors, or of their projections `onto` columns."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                z = _centred(_matrix(batch.column("x")), *mean)
                z = z if onto is None else z @ onto
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])
        tidy()

    cells = fit.mapInArrow(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    out = np.zeros((len(mean[0]) if onto is None else onto.shape[1],) * 2)
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d x d numbers
        out[r.i, r.j] = r.v / n
    return (out + out.T) / 2


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.sqrt(v @ v)
        if size == 0:
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.sqrt(v @ v)
        block = a[k + 1 :, k + 1 :]
        w = block @ v
        w = 2 * (w - (v @ w) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 2 :, k] = a[k, k + 2 :] = 0
        a[k + 1, k] = a[k, k + 1] = -size if v[0] >= 0 else size
    return np.diag(a).copy(), np.diag(a, -1).copy()


def exceeding(diagonal: np.ndarray, off: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each t, the number of eigenvalues above it: positive pivots of the shifted matrix."""
    t = np.asarray(t, float)
    tiny = np.finfo(float).tiny
    count, pivot = np.zeros(t.shape, np.int64), np.ones(t.shape)
    for i, d in enumerate(diagonal):
        pivot = d - t - (off[i - 1] ** 2 / pivot if i else 0.0)
        pivot = np.where(pivot == 0, -tiny, pivot)
        count += pivot > 0
    return count


def located(diagonal: np.ndarray, off: np.ndarray, k: int, top: float, floor: float) -> np.ndarray:
    """The first k eigenvalues, falling, to 1e-8 of each, by bisection between floor and top."""
    rank = np.arange(1, k + 1)
    lo, hi = np.full(k, floor), np.full(k, top)
    while ((hi - lo) > 1e-8 * hi).any():
        mid = (lo + hi) / 2
        above = exceeding(diagonal, off, mid) >= rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return (lo + hi) / 2


def leading_intervals(diagonal: np.ndarray, off: np.ndarray, wanted: int, top: float, floor: float) -> list[tuple[float, float]]:
    """Intervals that hold the leading eigenvalues above `floor`: neighbours closer than NEAR of their
    size share one, and every end lies in the middle of a gap."""
    most = int(exceeding(diagonal, off, floor))
    k = min(most, wanted + 1)
    while True:  # until the group that holds the last wanted one has ended
        values = [*located(diagonal, off, k, top, floor), *([floor] if k == most else [])]
        cuts = [i for i in range(1, len(values)) if values[i - 1] - values[i] > NEAR * values[i - 1]]
        if k == most or (cuts and cuts[-1] >= wanted):
            break
        k = min(most, 2 * k)
    edges = [2 * values[0] - (values[0] + values[cuts[0]]) / 2 if cuts else top]
    out, start = [], 0
    for cut in [*cuts, *([k] if k == most and (not cuts or cuts[-1] < k) else [])]:
        if start >= min(wanted, most):
            break
        low = (values[cut - 1] + values[cut]) / 2 if cut < len(values) else floor
        reach = (values[cut - 1] - low) if start else 0.0  # near groups above: no wider than to their middle
        high = min(edges[-1], values[start] + max(reach, values[start] - low)) if start else edges[-1]
        out.append((low, high))
        edges.append(low)
        start = cut
    return out


def feast(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit eigenvectors (columns)."""
    size = float(np.trace(v))
    if wanted < 1 or not size > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    a, d = v / size, len(v)
    diagonal, off = tridiagonal(a)
    floor = 64 * d * np.finfo(float).eps * float(located(diagonal, off, 1, 1.001, 0.0)[0])
    found = [_filtered(a, low, high, int(exceeding(diagonal, off, low) - exceeding(diagonal, off, high))) for low, high in leading_intervals(diagonal, off, wanted, 1.001, floor)]
    q, _ = np.linalg.qr(np.concatenate(found, axis=1))  # one last Rayleigh-Ritz over all intervals
    e, inner = np.linalg.eigh(q.T @ a @ q)
    order = np.argsort(-e, kind="stable")[:wanted]
    y = q @ inner[:, order]
    return e[order] * size, y / np.sqrt((y * y).sum(axis=0))


def _filtered(a: np.ndarray, low: float, high: float, count: int) -> np.ndarray:
    """Eigenvectors of the `count` eigenvalues between low and high."""
    d, centre, radius = len(a), (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(POINTS)
    around = radius * np.exp(1j * np.pi / 2 * (1 - x))
    random, columns = np.random.default_rng(5), min(d, 2 * count + SPARE)
    enough = 16 * np.finfo(float).eps * np.abs(a).sum(axis=0).max()
    while True:
        y = random.standard_normal((d, columns))
        for _ in range(ROUNDS):
            q = sum(0.5 * wj * (zj * np.linalg.solve((centre + zj) * np.eye(d) - a, y)).real for wj, zj in zip(w, around, strict=True))
            q, _ = np.linalg.qr(q)
            e, inner = np.linalg.eigh(q.T @ a @ q)
            y = q @ inner
            inside = np.flatnonzero((e > low) & (e < high))
            if len(inside) == count and np.abs(a @ y[:, inside] - y[:, inside] * e[inside]).max() <= enough:
                return y[:, inside]
        if columns == d:
            raise ArithmeticError(f"{count} eigenvalues lie between {low} and {high}, {len(inside)} were found")
        columns = min(d, 2 * columns)


@dataclass
class Whitening:
    """n and sums of the fit list, eigenvalues, share of the trace, components (columns) and the
    largest error of the whitened covariance against the identity."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    components: np.ndarray
    identity_error: float

    @property
    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])


def fit(vectors: DataFrame, components: int = 4) -> Whitening:
    """From vec_id, x (see quantised)."""
    bounded_batches(vectors)
    distinct = stored(vectors.select("x").distinct())
    n, sums = totals(distinct)
    model = Whitening(n, sums, np.zeros(0), np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    if n and sums:
        v = moments(distinct, n, model.mean)
        model.eigenvalues, model.components = feast(v, min(components, len(sums)))
        if len(model.eigenvalues):
            model.explained = model.eigenvalues / np.trace(v)
            white = moments(distinct, n, model.mean, model.components / np.sqrt(model.eigenvalues))
            model.identity_error = float(np.abs(white - np.eye(len(white))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row of vec_id, x."""
    bounded_batches(vectors)
    k = len(model.eigenvalues)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not k:
        return vectors.sparkSession.createDataFrame([], schema)
    mean, onto = model.mean, model.components / np.sqrt(model.eigenvalues)
    sums = np.array(model.sums, object)

    def deviations(x: np.ndarray) -> list:
        most = model.n * float(np.abs(x).max()) + max(map(abs, model.sums))
        if len(sums) * most**2 < 2.0**62:
            a = model.n * x - sums.astype(np.int64)
        else:
            a = model.n * x.astype(object) - sums
        return [Decimal(int(t)) if t < 10**38 else None for t in (a * a).sum(axis=1)]

    def run(batches):
        release()
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                rows = np.repeat(np.arange(len(x)), k)
                arrays = [
                    batch.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), model.n)),
                    pa.array(deviations(x), pa.decimal128(38, 0)).take(pa.array(rows)), pa.array((_centred(x, *mean) @ onto).ravel()),
                    pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(rows), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        tidy()

    return vectors.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
