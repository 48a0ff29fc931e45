"""Whitening of embeddings: projection on the leading eigenvectors of their covariance, scaled to unit variance.

Spark sums over the distinct vectors (totals, then products of centred entries), one row of the covariance
a dimension.  The driver holds that matrix of dimension by dimension and finds its leading eigenpairs by
Householder reflections to a tridiagonal matrix, bisection on Sturm counts, and inverse iteration with
reorthogonalisation inside clusters.  Means and components travel with the tasks that project.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventscope.llm.common import materialize

#: Steps of a vector's entries to one.
STEPS = 256
#: Rows that are computed at a time.
ROWS = 4096
#: Eigenvalues nearer than this share of the norm are a cluster.
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the Householder reflections that lead to them."""
    a, size, vectors = matrix.copy(), len(matrix), []
    for k in range(size - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += math.copysign(float(np.linalg.norm(x)), x[0])
        length = float(np.linalg.norm(v))
        v = v / length if length else v
        vectors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = x - 2 * v * (v @ x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each of the numbers ``at``."""
    tiny = EPS * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)), np.finfo(float).tiny / EPS)
    count, q = np.zeros(len(at), dtype=int), np.ones(len(at))
    for k, d in enumerate(diagonal):
        q = d - at - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny * EPS, -tiny * EPS, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection down to neighbouring numbers."""
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, float((diagonal - reach).min())), np.full(k, float((diagonal + reach).max()))
    high = high + EPS * np.abs(high)
    rank = len(diagonal) - 1 - np.arange(k)  # so many are smaller
    while True:
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            return middle
        over = below(diagonal, off, middle) > rank
        high, low = np.where(over, middle, high), np.where(over, low, middle)


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves ``(T - shift) y = b`` by elimination with row exchanges; a pivot of zero counts as a tiny one."""
    size = len(diagonal)
    tiny = EPS * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0)), np.finfo(float).tiny / EPS)
    rows, factors, swaps = np.zeros((size, 3)), np.zeros(size), np.zeros(size, dtype=bool)
    now = [diagonal[0] - shift, off[0] if size > 1 else 0.0, 0.0]
    for k in range(size - 1):
        then = [off[k], diagonal[k + 1] - shift, off[k + 1] if k + 2 < size else 0.0]
        swaps[k] = abs(then[0]) > abs(now[0])
        if swaps[k]:
            now, then = then, now
        now[0] = now[0] or tiny
        factors[k] = then[0] / now[0]
        rows[k] = now
        now = [then[1] - factors[k] * now[1], then[2] - factors[k] * now[2], 0.0]
    rows[-1] = [now[0] if abs(now[0]) > tiny else tiny, 0, 0]

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k in range(size - 1):
            if swaps[k]:
                y[k], y[k + 1] = y[k + 1], y[k]
            y[k + 1] -= factors[k] * y[k]
        for k in range(size - 1, -1, -1):
            y[k] = (y[k] - (rows[k, 1] * y[k + 1] if k + 1 < size else 0) - (rows[k, 2] * y[k + 2] if k + 2 < size else 0)) / rows[k, 0]
        return y

    return solve


def eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    The entry of largest absolute value of each vector is positive.
    """
    scale = float(np.abs(matrix).max()) or 1.0
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading(diagonal, off, k)
    near = CLUSTER * float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    random, found = np.random.default_rng(0), []
    for j, value in enumerate(values):
        cluster = [found[i] for i in range(j) if values[i] - value <= near]
        solve, y = _solver(diagonal, off, value - EPS * abs(value) * len(cluster)), random.standard_normal(len(diagonal))
        for _ in range(5):
            y = solve(y / np.linalg.norm(y))
            y = y / np.abs(y).max()
            for _ in range(2):
                for other in cluster:
                    y = y - (other @ y) * other
        found.append(y / np.linalg.norm(y))
    vectors = np.stack(found, axis=1)
    for at in range(len(reflections) - 1, -1, -1):
        v = reflections[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * scale, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(k)] < 0, -1.0, 1.0)


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows of whole numbers."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            yield batch, np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, size)


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Rows ``(dim, part, values)`` of all tasks, added by ``dim`` in order of task."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = np.sum(np.stack(table.column("values").to_numpy()), axis=0)
        return pa.table({"dim": table.column("dim")[:1], "values": pa.array([total], pa.list_(pa.float64()))})

    return {r["dim"]: np.array(r["values"]) for r in parts.groupBy("dim").applyInArrow(add, "dim int, values array<double>").collect()}


def _products(fit: DataFrame, size: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of the products of their centred (``project``) entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for _, x in _matrices(batches, size):
            made = project(x)
            total = made.T @ made if total is None else total + made.T @ made
        if total is not None:
            part = np.full(len(total), TaskContext.get().partitionId())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(part, pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["dim", "part", "values"])

    rows = _summed(fit.mapInArrow(run, "dim int, part int, values array<double>"))
    return np.stack([rows[k] for k in range(len(rows))])


def _totals(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for _, x in _matrices(batches, size):
            n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        sums = [Decimal((h << 32) + l) for h, l in zip(high.tolist(), low.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([Decimal(n), *sums], pa.decimal128(38, 0))], ["dim", "total"])

    rows = {r["dim"]: int(r["total"]) for r in fit.mapInArrow(run, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
    return rows.get(-1, 0), [rows.get(k, 0) for k in range(size)]


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key`` and ``x``: entries in whole steps; vectors that are null or hold null or non-finite entries go."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.select(key, vector).filter(F.col(vector).isNotNull() & sound).select(key, F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS)).alias("x"))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """One row per sound vector and component: ``component, n, deviation, whitened, explained, identity_error``.

    The covariance is that of the distinct vectors, so repeated rows change nothing; each repeated row is
    projected.  Shorter vectors are read as if zeros followed.  ``whitened`` and ``explained`` are null where
    the variance along a component is zero (within rounding), ``identity_error`` is over the other components;
    ``deviation`` is null where it exceeds a long.  There are no more components than dimensions; without sound
    vectors, or without dimensions, there are no rows.  Other columns are not read.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    every = quantised(vectors, key, vector)
    sizes = every.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    size = sizes["most"] or 0
    if not size:
        return spark.createDataFrame([], schema)
    if sizes["least"] < size:
        every = every.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("x"))))
    fit = materialize(every.select("x").distinct(), "fit-vectors")
    n, sums = _totals(fit, size)
    means = np.array([s / n for s in sums])
    covariance = _products(fit, size, lambda x: x - means) / n
    trace, k = float(np.trace(covariance)), min(components, size)
    values, axes = eigenpairs((covariance + covariance.T) / 2, k)
    sound = values > size * EPS * max(trace, 0.0)
    axes = axes[:, sound] / np.sqrt(values[sound])
    error = float(np.abs(_products(fit, size, lambda x: (x - means) @ axes) / n - np.eye(int(sound.sum()))).max()) if sound.any() else None
    explained = [float(v) / trace if trace > 0 else None for v in values]
    square, largest = sum(s * s for s in sums), max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, dtype=object)
        for batch, x in _matrices(batches, size):
            top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
            whole = x if max(top, largest) * top * size < 1 << 62 else x.astype(object)
            other = exact.astype(np.int64) if whole is x else exact
            squares, crossed = (whole * whole).sum(axis=1).astype(object), (whole @ other).astype(object)
            deviation = [d if d < 1 << 63 else None for d in (n * n * squares - 2 * n * crossed + square).tolist()]
            white = np.full((len(x), k), np.nan)
            white[:, sound] = (x - means) @ axes
            hidden = np.tile(~sound, len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, n), pa.int64()),
                    pa.array([d for d in deviation for _ in range(k)], pa.int64()), pa.array(white.ravel(), pa.float64(), mask=hidden),
                    pa.array(explained * len(x), pa.float64()), pa.array([error] * (len(x) * k), pa.float64()),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return every.mapInArrow(run, schema)
