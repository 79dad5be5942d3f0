"""Whitening of embeddings by an incremental eigendecomposition.

A partition of the distinct vectors keeps a spectrum: count, exact sums, and eigenvectors and eigenvalues of its
centred scatter. A block of rows enters as centred rank-one updates, each of which solves the secular equation
of the new eigenvalues after deflation; blocks of more rows than dimensions are first turned into as many rows
of the same scatter. Two spectra combine by successive rank-one updates with the scaled eigenvectors of the one
and the offset of the means. Partitions combine in two levels, so a task holds about the square root of their
number of spectra. Rayleigh-Ritz passes over all rows then refine the leading components until their residuals
are down to rounding: each looks in the span of the components and their residuals.

Entries count as integers, so counts, sums and offsets from the mean are exact before the one division. What
reaches the driver is a few matrices of the dimension; rows never do.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.llm.common import durable, row_struct, ship_package, with_outputs

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Further directions that the refinement works on, rows of a block, and most refinement passes.
SPARE, BLOCK, PASSES = 8, 16_384, 40
#: Eigenvalues up to this part of the trace count as none, and such directions are no components.
NOTHING = 1e-12
EPS = np.finfo(float).eps
OUTPUTS = ["n", "deviation", "whitened", "explained", "identity_error"]


def _deflated(d: np.ndarray, q: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Rotates entries of `a` at equal eigenvalues together (d ascending; d, q and a change); the entries left to solve."""
    tolerance = 8 * EPS * max(float(np.abs(d).max(initial=0.0)), float(a @ a))
    size, last = np.sqrt(a @ a), -1
    for j in range(len(d)):
        if abs(a[j]) * size <= tolerance:
            continue
        if last >= 0:
            r = np.hypot(a[last], a[j])
            c, s = a[j] / r, a[last] / r
            if abs(c * s * (d[j] - d[last])) <= tolerance:
                a[last], a[j] = 0.0, r
                q[:, last], q[:, j] = c * q[:, last] - s * q[:, j], s * q[:, last] + c * q[:, j]
                d[last], d[j] = c * c * d[last] + s * s * d[j], s * s * d[last] + c * c * d[j]
        last = j
    return np.flatnonzero(np.abs(a) * size > tolerance)


def secular_roots(d: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum a_j^2 / (d_j - x) = 0, as nearest pole (its place) and signed distance to it.

    d ascends strictly and no a_j is zero: one root lies between neighbouring poles, one beyond the last within
    |a|^2. Bisection runs over the floating-point numbers themselves, so small distances keep all digits.
    """
    n, square = len(d), a * a
    gap = np.append(np.diff(d), square.sum())
    middle = 1 + (square / ((d - d[:, None]) - gap[:, None] / 2)).sum(axis=1)
    right = (middle < 0) & (np.arange(n) < n - 1)  # nearer to the next pole
    pole = np.arange(n) + right
    sign = np.where(right, -1.0, 1.0)
    from_pole = d[None, :] - d[pole][:, None]
    lo = np.full(n, np.finfo(float).tiny).view(np.int64)
    hi = np.where(np.arange(n) < n - 1, gap / 2, gap * (1 + 4 * EPS)).view(np.int64)
    with np.errstate(divide="ignore", over="ignore"):
        while (hi - lo > 1).any():
            mid = lo + (hi - lo) // 2
            value = 1 + (square / (from_pole - (sign * mid.view(float))[:, None])).sum(axis=1)
            outward = (value < 0) != right  # the root is further from its pole
            lo, hi = np.where(outward, mid, lo), np.where(outward, hi, mid)
    return pole, sign * hi.view(float)


def rank_one(d: np.ndarray, q: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of q diag(d) q' + z z'."""
    d, q, a = d.copy(), q.copy(), q.T @ z
    if not a.any():
        return d, q
    left = _deflated(d, q, a)
    left = left[np.argsort(d[left], kind="stable")]
    if len(left):
        poles, weight = d[left], a[left]
        pole, far = secular_roots(poles, weight)
        # root minus pole, without cancellation, for all roots (rows) and poles
        apart = (poles[pole][:, None] - poles[None, :]) + far[:, None]
        # weights for which these roots are exact, so that the vectors are orthogonal
        n = len(left)
        others = np.arange(n)[:, None] + (np.arange(n)[:, None] >= np.arange(n)[None, :])
        below = np.append(poles, 0.0)[others] - poles[None, :]
        below[n - 1] = 1.0
        weight = np.copysign(np.sqrt(np.abs(np.prod(apart / below, axis=0))), weight)
        u = weight[None, :] / -apart
        u /= np.sqrt((u * u).sum(axis=1))[:, None]
        q[:, left] = q[:, left] @ u.T
        d[left] = poles[pole] + far
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


@dataclass
class Spectrum:
    """n vectors with sums S (Python integers) and scatter around their mean q diag(d) q'."""

    n: int
    sums: list[int]
    d: np.ndarray
    q: np.ndarray

    @staticmethod
    def none(dim: int) -> Spectrum:
        return Spectrum(0, [0] * dim, np.zeros(dim), np.eye(dim))

    def _updated(self, n: int, sums: list[int], rows: np.ndarray) -> Spectrum:
        """With n vectors more of these sums, whose scatter is that of the rows."""
        d, q = self.d, self.q
        for z in rows:
            d, q = rank_one(d, q, z)
        if self.n and n:  # what the means are apart, exact up to the division
            apart = np.array([(a * n - b * self.n) / (n * self.n) for a, b in zip(self.sums, sums)])
            d, q = rank_one(d, q, apart * np.sqrt(n * self.n / (n + self.n)))
        return Spectrum(self.n + n, [a + b for a, b in zip(self.sums, sums)], d, q)

    def with_rows(self, x: np.ndarray) -> Spectrum:
        n, sums = len(x), exact_sums(x)
        z = centred(x, n, sums)
        return self._updated(n, sums, np.linalg.qr(z, mode="r") if n > x.shape[1] else z) if n else self

    def combined(self, other: Spectrum) -> Spectrum:
        rows = (other.q * np.sqrt(np.maximum(other.d, 0))).T
        return self._updated(other.n, other.sums, rows[other.d > 0]) if other.n else self


def exact_sums(x: np.ndarray) -> list[int]:
    small = len(x) == 0 or int(np.abs(x).max(initial=0)) < 2**62 // len(x)
    return (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).tolist()


def scaled_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit where that holds them, else Python integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0) < 2**63:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (scaled_offsets(x, n, sums) / n).astype(np.float64)


def deviations(offsets: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; None where 64 bits don't hold it."""
    if offsets.dtype != object and offsets.shape[1] * float(np.abs(offsets).max(initial=0)) ** 2 < 2.0**62:
        return (offsets * offsets).sum(axis=1).tolist()
    return [v if v < 2**63 else None for v in (sum(int(y) ** 2 for y in row) for row in offsets)]


def whole_entries(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry, as longs; entries beyond 2^56 / 64 count as that."""
    most = float(2**56)
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c * F.lit(float(SCALE)), F.lit(-most)), F.lit(most))).cast("long") + F.lit(OFFSET).cast("long"))


def finite(vector: Column) -> Column:
    """Not null, not empty and without null, NaN or infinite entries."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def spectrum_of(distinct: DataFrame, dim: int) -> Spectrum:
    """The spectrum of all rows of x: one for each partition, combined in two levels."""

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, n = Spectrum.none(dim), [], 0
        for batch in batches:
            waiting.append(_matrix(batch["x"], dim))
            n += batch.num_rows
            if n >= BLOCK:
                own, waiting, n = own.with_rows(np.concatenate(waiting)), [], 0
        own = own.with_rows(np.concatenate(waiting)) if n else own
        if own.n:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], ["state"])

    def of_spectra(table: pa.Table) -> pa.Table:
        return pa.table({"state": [pickle.dumps(reduce(Spectrum.combined, map(pickle.loads, table["state"].to_pylist())))]})

    states = durable(distinct.mapInArrow(of_rows, "state binary"))
    groups = max(1, round(states.count() ** 0.5))
    states = states.groupBy(F.pmod(F.xxhash64("state"), F.lit(groups))).applyInArrow(of_spectra, "state binary")
    last = states.groupBy().applyInArrow(of_spectra, "state binary").first()
    return pickle.loads(last[0]) if last else Spectrum.none(dim)


def _summed(distinct: DataFrame, values) -> np.ndarray:
    """The sum over all batches of values(x), a flat array of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = values(batch["x"])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    rows = distinct.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for i, v in rows:
        out[i] = v
    return out


@dataclass
class Whitener:
    """What whitens a vector of one dimension; components are the columns of `axes`, by falling eigenvalue."""

    dim: int
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    def project(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.axes / np.sqrt(self.values)


def refine(distinct: DataFrame, start: Spectrum, components: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading eigenvectors and eigenvalues of the covariance, its trace, and the passes this took."""
    dim, n, sums = len(start.sums), start.n, start.sums
    wanted = min(components, dim)
    keep = min(dim, wanted + SPARE)
    basis = np.linalg.qr(start.q[:, ::-1][:, :keep])[0]
    best = None
    for passes in range(1, PASSES + 1):
        held = basis

        def products(column: pa.Array) -> np.ndarray:
            z = centred(_matrix(column, dim), n, sums)
            return np.append((z.T @ (z @ held)).ravel(), (z * z).sum())

        total = _summed(distinct, products) / n
        trace, image = float(total[-1]), total[:-1].reshape(dim, -1)  # V times the basis
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:keep], turn[:, ::-1][:, :keep]
        axes = basis @ turn
        residual = image @ turn - axes * values
        left = float(np.sqrt((residual[:, :wanted] ** 2).sum(axis=0)).max(initial=0))
        if best is None or left < best[0]:
            best = (left, axes[:, :wanted], values[:wanted], trace)
        if left <= 64 * EPS * max(trace, np.finfo(float).tiny) or passes > 2 and left >= best[0] * 4:
            break
        directions = residual - axes @ (axes.T @ residual)
        basis = np.linalg.qr(np.concatenate([axes, directions / np.maximum(np.sqrt((directions**2).sum(axis=0)), np.finfo(float).tiny)], axis=1))[0][:, :dim]
    return best[1], best[2], best[3], passes


def fit(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Whitener:
    """Fits to distinct rows of x (array<long> of this dimension, read several times)."""
    start = spectrum_of(distinct, dim)
    if not start.n:
        return Whitener(dim, 0, [0] * dim, np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0, 0)
    axes, values, trace, passes = refine(distinct, start, components)
    some = values > NOTHING * trace
    out = Whitener(dim, start.n, start.sums, axes[:, some], values[some], trace, 0.0, passes)
    k = int(some.sum())

    def products(column: pa.Array) -> np.ndarray:
        y = out.project(_matrix(column, dim))
        return np.append((y.T @ y).ravel(), y.sum(axis=0))

    total = _summed(distinct, products) / start.n
    mean = total[k * k:]
    out.identity_error = float(np.abs(total[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    return out


def whiten(vectors: DataFrame, vector_col: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """The columns `keep` of vectors (all, if None) and n, deviation, whitened, explained, identity_error, for each usable row.

    whitened and explained are arrays over the components: the projections over the root of the eigenvalues, and
    the eigenvalues' parts of the trace. n, covariance and identity_error are of the distinct vectors of the
    row's dimension; deviation is the exact sum of (n x - S)^2, null beyond 64 bits. A vector that is null or empty or
    holds null or non-finite entries has no row. Each dimension is fitted by itself. Directions without
    variance (eigenvalue up to 1e-12 of the trace) are no components, so equal vectors alone have empty arrays.
    Repeated rows count once in the fit and come back as often as given. An empty table gives an empty result.
    Input columns named like an output, in any case, give way to it.
    """
    ship_package(vectors.sparkSession)
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(row_struct(vectors, keep).alias("row"), vector.alias("vector")).where(finite(F.col("vector"))).select(
        "row", whole_entries(F.col("vector")).alias("x"))
    distinct = durable(rows.select("x").distinct())
    dims = [r[0] for r in distinct.select(F.size("x").alias("dim")).distinct().collect()]  # as many as lengths
    models = {dim: fit(distinct.where(F.size("x") == dim), dim, components) for dim in dims}
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["x"].value_lengths().to_numpy()
            for dim in np.unique(size).tolist():
                part = batch.filter(pa.array(size == dim))
                model, x = shared.value[dim], _matrix(part["x"], dim)
                constant = lambda v, kind: pa.array([v] * len(x), kind)
                yield pa.RecordBatch.from_arrays(
                    [part["row"], constant(model.n, pa.int64()), pa.array(deviations(scaled_offsets(x, model.n, model.sums)), pa.int64()),
                     pa.array(list(model.project(x)), pa.list_(pa.float64())), constant((model.values / model.trace if model.trace else model.values).tolist(), pa.list_(pa.float64())),
                     constant(model.identity_error, pa.float64())], ["row", *OUTPUTS])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())),
                           T.StructField("identity_error", T.DoubleType())])
    return with_outputs(rows.mapInArrow(run, schema), "row", OUTPUTS)
