"""Whitening of embeddings by the leading components of their covariance.

Every entry ``c`` becomes the integer ``floor(64 c) + 1000000``, so sums and squared
deviations are exact. One pass adds up the integers per dimension, a second one the
products of the centred vectors (one partial matrix per task, added row by row). The
covariance, whose size depends on the dimension only, is reduced to tridiagonal form by
Householder reflections; bisection on Sturm counts gives its leading eigenvalues and
inverse iteration, reorthogonalised within clusters, their vectors. The projection goes
to the tasks as a small matrix, and a third pass measures the covariance of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

SCALE, OFFSET = 64, 1_000_000
LIMIT = 1 << 62                # integers beyond are set to this bound
COMPONENTS = 32
RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")


# ---------------------------------------------------------------- vectors of a batch

def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, rows, integers)`` for each length of valid vectors in a batch."""
    col = batch.column("vector")
    sizes = np.array([-1 if n is None else n for n in col.value_lengths().to_pylist()], np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)    # null entries become NaN
    ends = np.cumsum(np.maximum(sizes, 0))
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            y = np.clip(np.floor(x[good] * SCALE), -float(LIMIT), float(LIMIT - 2 * OFFSET)).astype(np.int64)
            yield d, rows[good], y + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and dimension: vectors seen and the exact sum of their integers."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for b in batches:
        for d, rows, x in _vectors(b):
            n, s = total.get(d, (0, np.zeros(d, object)))
            # halves keep the partial sums far from the bounds of int64
            low, high = x & 0xFFFFFFFF, x >> 32
            total[d] = n + len(rows), s + (low.sum(0).astype(object) + (high.sum(0).astype(object) << 32))
    d = [k for k in total for _ in range(k)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(d, pa.int32()), pa.array([i for k in total for i in range(k)], pa.int32()),
         pa.array([total[k][0] for k in d], pa.int64()),
         pa.array([Decimal(int(v)) for k in total for v in total[k][1]], pa.decimal128(38, 0))], ["d", "i", "n", "s"])


@dataclass
class _Fit:
    """Dimension, number of vectors and their exact sums."""
    d: int
    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - sums``, exact: int64 where that has room, Python integers otherwise."""
        bound = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if bound < LIMIT:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def squares(self, dev: np.ndarray) -> list[int | None]:
        """Sum of squared deviations per vector; null where a long cannot hold it."""
        top = max((abs(int(v)) for v in (dev.min(initial=0), dev.max(initial=0))), default=0)
        if top * top * self.d < 1 << 63:
            return (dev * dev).sum(axis=1).tolist()
        exact = (dev.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def _moments(fit: _Fit, basis: np.ndarray | None):
    """Per task: the matrix of products of the centred (and projected) vectors by rows,
    and their sum as one more row."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for d, _, x in _vectors(b):
                if d == fit.d:
                    z = fit.deviations(x).astype(np.float64) / fit.n
                    z = z if basis is None else z @ basis
                    part = np.vstack([z.T @ z, z.sum(axis=0)])
                    total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                             ["i", "row"])
    return add


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the partial rows of each number; a task holds a share of the numbers."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, row in zip(b.column(0).to_pylist(), b.column(1)):
            v = row.values.to_numpy()
            total[i] = total[i] + v if i in total else v.copy()
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k].tolist() for k in keys], pa.list_(pa.float64()))],
                                     ["i", "row"])


def _covariance(vectors: DataFrame, fit: _Fit, basis: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the centred vectors, or of their projections. What
    reaches the driver is one matrix, whatever the number of vectors."""
    schema = "i int, row array<double>"
    rows = (vectors.mapInArrow(_moments(fit, basis), schema)
            .repartition("i").mapInArrow(_add_rows, schema).orderBy("i").collect())
    m = np.array([r["row"] for r in rows])
    mean = m[-1] / fit.n                                      # zero but for rounding
    return m[:-1] / fit.n - np.outer(mean, mean)


# ---------------------------------------------------------------- leading eigenvectors

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a symmetric matrix: diagonal, off-diagonal and the unit
    reflection vectors (an empty one where a column needed none)."""
    a = a.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1:, k]
        scale = np.abs(x[1:]).max(initial=0.0)
        if scale == 0.0:
            mirrors.append(np.empty(0))
            continue
        top = np.abs(x).max()
        v = x / top
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        sub = a[k + 1:, k + 1:]
        p = sub @ v
        w = p - (v @ p) * v
        sub -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        x -= 2.0 * v * (v @ x)
        a[k, k + 1:] = x
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are below each of the points."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    square = np.concatenate(([0.0], off * off))
    q = np.ones_like(at)
    below = np.zeros(len(at), np.int64)
    for a, b2 in zip(diag, square):
        q = a - at - b2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection to the last bits."""
    n = len(diag)
    reach = np.concatenate((np.abs(off), [0.0])) + np.concatenate(([0.0], np.abs(off)))
    margin = np.finfo(float).eps * n * max(np.abs(diag).max(), reach.max(), np.finfo(float).tiny)
    lo = np.full(k, (diag - reach).min() - margin)
    hi = np.full(k, (diag + reach).max() + margin)
    rank = n - 1 - np.arange(k)                               # eigenvalues below the one sought
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if ((mid <= lo) | (mid >= hi)).all():
            break
        above = sturm_counts(diag, off, mid) <= rank
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return lo + (hi - lo) / 2


def _solve(diag: np.ndarray, off: np.ndarray, shift: float, floor: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solver of ``(T - shift) x = b`` by elimination with row exchanges."""
    n = len(diag)
    main, up, up2 = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    low = off.tolist()
    factor, swap = [0.0] * n, [False] * n
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            swap[i] = True
            main[i], up[i], up2[i], row = low[i], main[i + 1], up[i + 1], (main[i], up[i])
            factor[i] = row[0] / main[i]
            main[i + 1], up[i + 1] = row[1] - factor[i] * up[i], -factor[i] * up2[i]
        else:
            main[i] = main[i] or floor
            factor[i] = low[i] / main[i]
            main[i + 1] -= factor[i] * up[i]
    main[-1] = main[-1] or floor

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(n - 1):
            if swap[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            v = x[i]
            if i + 1 < n:
                v -= up[i] * x[i + 1]
            if i + 2 < n:
                v -= up2[i] * x[i + 2]
            x[i] = v / (main[i] if abs(main[i]) > floor else floor)
            if abs(x[i]) > 1e150:                             # keep the growing solution in range
                x = [y * 1e-150 for y in x]
        return np.array(x)
    return solve


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, by inverse iteration;
    vectors of values closer than a thousandth of the norm are orthogonalised."""
    n = len(diag)
    norm = max(np.abs(diag).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    rng = np.random.default_rng(12)
    out = np.zeros((n, len(values)))
    first, last = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        shift = min(value, last - 10 * eps * norm) if k > first else value     # equal values need apart shifts
        last = shift
        solve = _solve(diag, off, shift, eps * norm)
        x = rng.uniform(0.5, 1.0, n) * rng.choice([-1.0, 1.0], n)
        for _ in range(5):
            for _ in range(2):
                x = x - out[:, first:k] @ (out[:, first:k].T @ x)
            x = solve(x / np.linalg.norm(x))
        for _ in range(2):
            x = x / np.abs(x).max()
            x = x - out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_components(cov: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` largest eigenvalues of a covariance, falling, and their unit
    eigenvectors as columns; values that are zero but for rounding are left out."""
    norm = np.abs(cov).max(initial=0.0)
    if norm == 0.0:
        return np.empty(0), np.empty((len(cov), 0))
    diag, off, mirrors = tridiagonal((cov + cov.T) / (2 * norm))
    values = leading_values(diag, off, min(k, len(cov)))
    values = values[values > 16 * len(cov) * np.finfo(float).eps * max(values[0], 0.0)]
    vectors = leading_vectors(diag, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        v = mirrors[i]
        if len(v):
            vectors[i + 1:] -= 2.0 * np.outer(v, v @ vectors[i + 1:])
    return values * norm, vectors


# ---------------------------------------------------------------- the operator

@dataclass
class Whitening:
    """A fitted whitening: exact sums, leading values and vectors, trace of the covariance."""
    fit: _Fit
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _ids_and_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    ship(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))


def fit_whitening(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  components: int = COMPONENTS) -> Whitening | None:
    """Fit on all valid vectors; None when there is none. A vector is valid if it holds
    neither null nor non-finite entries and has the most frequent length (of equally
    frequent ones the longest)."""
    vectors = _ids_and_vectors(df, id_col, vector_col)
    rows = (vectors.mapInArrow(_sums, "d int, i int, n long, s decimal(38,0)")
            .groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")))
    main = rows.groupBy("d").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1)
    kept = rows.join(F.broadcast(main.select("d")), "d").orderBy("i").collect()      # one row per dimension
    if not kept:
        return None
    fit = _Fit(kept[0]["d"], kept[0]["n"], [int(r["s"]) for r in kept])
    cov = _covariance(vectors, fit)
    values, basis = leading_components(cov, components)
    return Whitening(fit, values, basis, float(np.trace(cov)))


def identity_error(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Largest entry of the whitened vectors' covariance minus the identity."""
    cov = _covariance(_ids_and_vectors(df, id_col, vector_col), model.fit, model.projection)
    return float(np.abs(cov - np.eye(len(model.values))).max())


def _project(model: Whitening, error: float):
    basis, fit = model.projection, model.fit
    explained = model.values / model.trace
    k = len(explained)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, rows, x in _vectors(b):
                if d != fit.d:
                    continue
                dev = fit.deviations(x)
                m = len(rows)
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id").take(pa.array(rows)).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, fit.n)), pa.array(fit.squares(dev), pa.int64()).take(at),
                     pa.array((dev.astype(np.float64) / fit.n @ basis).ravel()), pa.array(np.tile(explained, m)),
                     pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return project


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per valid vector and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``.

    Null vectors, vectors with null or non-finite entries and vectors that have not the
    common length (see :func:`fit_whitening`) give no rows; null ids and repeated rows are
    vectors like any others. Components whose variance is zero but for rounding are left
    out, so equal vectors throughout, and an empty table, give no rows. Integers are held
    within 2**62; a ``deviation`` that a long cannot hold is null. Other columns are
    not read, whatever their names. Equal eigenvalues may give any basis of their space.
    """
    model = fit_whitening(df, id_col, vector_col, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], RESULT)
    error = identity_error(df, model, id_col, vector_col)
    return _ids_and_vectors(df, id_col, vector_col).mapInArrow(_project(model, error), RESULT)
