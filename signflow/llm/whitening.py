"""Whitening of embeddings: exact distributed scatter, cyclic Jacobi on the driver, projection in the tasks.

Entries become integers (64ths, shifted), so sums and centred products are exact whatever the partitioning: a pass
sums, a second multiplies what is left of each vector after the nearest whole mean, and the driver corrects for the
rest of the mean in unbounded integers. Partial matrices are added in two steps, so the driver gets at most
``MERGERS`` of them. It then rotates pairs of dimensions (all disjoint pairs of a round at once, every pair once a
sweep) until no off-diagonal entry matters beside its two diagonal ones, a relative test that also settles small
eigenvalues. Eigenvectors over roots of eigenvalues are broadcast (dimensions x components), and a third pass
measures the covariance of what they give before the last one returns it.

A vector that is null, or holds null or non-finite entries, is dropped; so is one of another length than the
commonest (of equally common ones the longest). Integers beyond 2**62 are held at it. Sums beyond a long go on in
Python integers; a ``deviation`` beyond a long is null. A component without variance (beyond rounding) has null
``whitened`` values and no part in ``identity_error``, which is null where none has any. Repeated rows and null ids
are kept and count; an empty table gives no rows; columns besides the two named are ignored. Vectors of some
thousand dimensions are the limit: a task and the driver hold a few square matrices.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.llm.common import prepare

#: Components, units in 1, what is added to each integer, and partial results that the driver gets at most.
COMPONENTS, UNITS, SHIFT, MERGERS = 32, 64, 1_000_000, 32
SWEEPS, ROUNDING = 60, np.finfo(float).eps
SAFE = 1 << 62


def usable(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int, int]:
    """The rows that take part, their number of dimensions and of rows."""
    e = F.col(vector)
    finite = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.where(e.isNotNull() & (F.size(e) > 0) & finite)
    most = rows.groupBy(F.size(e).alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return rows.limit(0), 0, 0
    return rows.where(F.size(e) == most["dims"]), most["dims"], most["n"]


def integers(batch: pa.RecordBatch, dims: int, vector: str) -> np.ndarray:
    """The batch's vectors as integers (rows x dims)."""
    entries = batch.column(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(UNITS * entries), SHIFT - SAFE, SAFE - SHIFT).astype(np.int64) + SHIFT


def exact(a: np.ndarray, times: int = 1) -> np.ndarray:
    """``a``, in Python integers where sums of ``times`` products of such entries may pass a long."""
    most = max((abs(int(a.max())), abs(int(a.min()))), default=0) if a.size else 0
    return a if most * most * times < SAFE else a.astype(object)


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object or b.dtype == object or max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))) >= SAFE // 2:
        return a.astype(object) + b.astype(object)
    return a + b


def gather(rows: DataFrame, measure: Callable[[pa.RecordBatch], object], merge: Callable[[object, object], object]) -> object:
    """``measure`` of all batches merged: by task, then by MERGERS tasks, then here; in the order of tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = measure(b)
                total = own if total is None else merge(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], ["part", "value"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = None, None
        for b in batches:
            for part, value in zip(b.column("part").to_pylist(), b.column("value").to_pylist(), strict=True):
                own = pickle.loads(value)
                total, least = (own, part) if total is None else (merge(total, own), least)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int32()), pa.array([pickle.dumps(total)], pa.binary())], ["part", "value"])

    kind = "part int, value binary"
    few = rows.mapInArrow(first, kind).repartition(MERGERS, "part").sortWithinPartitions("part").mapInArrow(again, kind)
    total = None
    for r in sorted(few.collect(), key=lambda r: r["part"]):
        own = pickle.loads(r["value"])
        total = own if total is None else merge(total, own)
    return total


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its unit eigenvectors as columns, by cyclic rotations."""
    a, n = np.array(matrix, float), len(matrix)
    turned, seats = np.eye(n), list(range(n + n % 2))
    half = len(seats) // 2
    for _ in range(SWEEPS):
        still = True
        for _ in range(len(seats) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[:half], seats[:half - 1:-1], strict=True) if max(x, y) < n]
            seats[1:] = [seats[-1], *seats[1:-1]]  # each two meet once in a sweep
            p, q = np.array(pairs).T if pairs else (np.zeros(0, int), np.zeros(0, int))
            off = a[p, q]
            ask = np.abs(off) > np.maximum(ROUNDING * np.sqrt(np.abs(a[p, p] * a[q, q])), np.finfo(float).tiny)
            if not ask.any():
                continue
            still = False
            p, q, off = p[ask], q[ask], off[ask]
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            low, high = a[p, p] - t * off, a[q, q] + t * off
            a[p], a[q] = c[:, None] * a[p] - s[:, None] * a[q], s[:, None] * a[p] + c[:, None] * a[q]
            a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
            turned[:, p], turned[:, q] = turned[:, p] * c - turned[:, q] * s, turned[:, p] * s + turned[:, q] * c
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = low, high
        if still:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], turned[:, order]


@dataclass
class Whitening:
    """n rows; whole: nearest whole mean by dimension; rest: sum of what is left of it (|rest| < n); matrix: dims x components, zero columns without variance; explained: shares of the trace."""

    n: int
    dims: int
    whole: np.ndarray
    rest: list[int]
    matrix: np.ndarray
    explained: np.ndarray
    vector: str = "embedding"

    def centred(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Integers without the whole mean, and without the mean."""
        d = integers(batch, self.dims, self.vector)
        d = (d.astype(object) if self.whole.dtype == object else exact(d)) - self.whole
        return d, d.astype(float) - np.array([float(Fraction(r, self.n)) for r in self.rest])

    def values(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.centred(batch)[1] @ self.matrix

    def deviations(self, d: np.ndarray) -> list[int | None]:
        """Sums of squares of n times the centred vectors."""
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        safe = most * most * self.dims < SAFE
        q = (d if safe else d.astype(object)) * self.n - np.array(self.rest, np.int64 if safe else object)
        return [int(x) if x < 1 << 63 else None for x in (q * q).sum(1)]


def fit(rows: DataFrame, dims: int, n: int, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of rows of ``dims`` dimensions (see ``usable``); n > 0."""
    prepare(rows.sparkSession)
    sums = gather(rows.select(vector), lambda b: (lambda x: (x if int(np.abs(x).max()) * len(x) < SAFE else x.astype(object)).sum(0))(integers(b, dims, vector)), plus)
    whole = [(2 * int(s) + n) // (2 * n) for s in sums]
    rest = [int(s) - n * w for s, w in zip(sums, whole, strict=True)]
    centre = np.array(whole, np.int64)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        d = exact(integers(batch, dims, vector)) - centre
        most = int(np.abs(d).max())
        if most * most * len(d) < 1 << 53:  # whole numbers stay exact in doubles, whose products are faster
            return (d.astype(float).T @ d.astype(float)).astype(np.int64)
        d = exact(d, len(d))
        return d.T @ d

    scatter = gather(rows.select(vector), products, plus).astype(object)
    r = np.array(rest, object)
    times_n = scatter * n - r[:, None] * r[None, :]
    covariance = np.array([[float(Fraction(int(x), n * n)) for x in line] for line in times_n])
    e, q = jacobi(covariance)
    k, trace = min(components, dims), float(Fraction(int(np.trace(times_n)), n * n))
    varies = e[:k] > dims * ROUNDING * max(e[0], 0.0)
    matrix = np.where(varies, q[:, :k] / np.sqrt(np.where(varies, e[:k], 1.0)), 0.0)
    return Whitening(n, dims, centre, rest, matrix, np.where(varies, e[:k], 0.0) / trace if trace else np.zeros(k), vector)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest entry by which the covariance of the whitened rows differs from the identity."""
    varies = np.flatnonzero(model.matrix.any(0))
    if not len(varies):
        return None
    held = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batch: pa.RecordBatch) -> tuple:
        w = held.value.values(batch)[:, varies]
        mean = w.mean(0)
        return len(w), mean, (w - mean).T @ (w - mean)

    def merge(x: tuple, y: tuple) -> tuple:
        n, gap = x[0] + y[0], y[1] - x[1]
        return n, x[1] + gap * y[0] / n, x[2] + y[2] + np.outer(gap, gap) * (x[0] * y[0] / n)

    n, _, scatter = gather(rows.select(model.vector), measure, merge)
    return float(np.abs(scatter / n - np.eye(len(varies))).max())


OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each usable vector and component."""
    spark = vectors.sparkSession
    prepare(spark)
    vectors = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).alias("vector_"))
    rows, dims, n = usable(vectors, "vector_")
    if not n:
        return spark.createDataFrame([], OUT)
    model = fit(rows, dims, n, "vector_", components)
    error, held = identity_error(rows, model), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k, varies = len(m.explained), m.matrix.any(0)
        for b in batches:
            d, c = m.centred(b)
            w = (c @ m.matrix).ravel()
            count = len(d)
            one = lambda x, kind: pa.array(np.full(count * k, x), kind)
            columns = [
                b.column("vec_id").take(pa.array(np.repeat(np.arange(count), k))), pa.array(np.tile(np.arange(1, k + 1), count), pa.int32()), one(m.n, pa.int64()),
                pa.array(m.deviations(d), pa.int64()).take(pa.array(np.repeat(np.arange(count), k))), pa.array(w, pa.float64(), mask=~np.tile(varies, count)), pa.array(np.tile(m.explained, count), pa.float64()),
                pa.nulls(count * k, pa.float64()) if error is None else one(error, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)
