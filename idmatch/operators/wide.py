"""PCA and LDA of vectors too wide for a d x d matrix: a few directions are kept, and each pass multiplies them.

A pass reads the rows once and gives the scatter matrix times a basis of l directions, without the matrix: a task adds up
its d x l part, cut into blocks of dimensions, which are summed by number. What the driver holds and sends out is d x l
numbers, as many as the model itself has. PCA is block subspace iteration with Rayleigh-Ritz values; LDA iterates on
within^-1 between, whose solves are conjugate gradients on all directions at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.operators.matrices import matrix

#: Dimensions of a block, bytes that all tasks together send in a pass (about), and directions beyond those asked for.
BLOCK, SENT_BYTES, MORE = 1024, 4 << 30, 10
#: Passes at most, and where they end: leftover over the largest value (PCA), leftover of a solve, change of a value (LDA).
PASSES, LEFT, SOLVED, SETTLED = 200, 1e-9, 1e-10, 1e-9
ROUNDS = 30

#: A matrix times a basis.
Times = Callable[[np.ndarray], np.ndarray]


def scatter_times(rows: DataFrame, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum of w (x - mean)(x - mean)' basis over the rows (v, w)."""
    d, l = basis.shape
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = shared.value
        total = np.zeros((d, l))
        step = max(1, (8 << 20) // d)
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                x = matrix(part.column("v")) - mean
                total += x.T @ (part.column("w").to_numpy(zero_copy_only=False)[:, None] * (x @ basis))
        for i in range(0, d, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i : i + BLOCK].reshape(-1)], pa.list_(pa.float64()))], ["i", "sums"])

    few = rows.coalesce(max(8, SENT_BYTES // (8 * d * l)))
    merged = few.mapInArrow(run, "i long, sums array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums")).toArrow()
    shared.destroy()
    out = np.zeros((d, l))
    for i, sums in zip(merged.column("i").to_pylist(), merged.column("sums").combine_chunks() if merged.num_rows else [], strict=True):
        part = sums.values.to_numpy(zero_copy_only=False).reshape(-1, l)
        out[i : i + len(part)] = part
    return out


def _start(d: int, l: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(42).normal(size=(d, min(d, l))))[0]


def _directions(k: int) -> int:
    return k + max(MORE, k // 2)


def principal(rows: DataFrame, mean: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, components) of the sample covariance of the rows (v, w)."""
    basis = _start(len(mean), _directions(k))
    for _ in range(PASSES):
        turned = scatter_times(rows, mean, basis) / max(n - 1, 1)
        small = basis.T @ turned
        values, mix = np.linalg.eigh((small + small.T) / 2)
        best = mix[:, ::-1][:, :k]
        values = values[::-1][:k]
        left = np.linalg.norm(turned @ best - (basis @ best) * values, axis=0)
        if left.max() <= LEFT * max(values[0], 1e-300):
            break
        basis = np.linalg.qr(turned)[0]
    return values, (basis @ best).T


def solve(times: Times, right: np.ndarray) -> np.ndarray:
    """Conjugate gradients for every column of ``right`` side by side; ``times`` is one pass."""
    x, left = np.zeros_like(right), right.copy()
    way, size = left.copy(), (left**2).sum(axis=0)
    goal = SOLVED**2 * np.maximum(size, 1e-300)
    for _ in range(PASSES):
        open_ = size > goal
        if not open_.any():
            break
        turned = times(way)
        along = (way * turned).sum(axis=0)
        step = np.where(open_ & (along > 0), size / np.where(along > 0, along, 1.0), 0.0)
        x, left = x + step * way, left - step * turned
        new = (left**2).sum(axis=0)
        way = left + np.where(open_, new / np.maximum(size, 1e-300), 0.0) * way
        size = new
    return x


def trace(rows: DataFrame, mean: np.ndarray) -> float:
    """Trace of the scatter matrix of rows (v, w) around their mean: weighted squares less those of the mean."""
    sums = rows.agg(F.sum(F.col("w") * V.sum_squares(F.col("v"))).alias("squares"), F.sum("w").alias("n")).first()
    return sums["squares"] - sums["n"] * float(mean @ mean)


def discriminants(total: Times, between: Times, d: int, add: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, directions) of between w = value * within w, within being total less between plus ``add`` everywhere."""
    within = lambda b: total(b) - between(b) + add * b
    basis, last = _start(d, _directions(k)), None
    for _ in range(ROUNDS):
        found = solve(within, between(basis))
        found = np.linalg.qr(found)[0]
        a, b = found.T @ between(found), found.T @ within(found)
        root = np.linalg.inv(np.linalg.cholesky((b + b.T) / 2))
        values, mix = np.linalg.eigh(root @ ((a + a.T) / 2) @ root.T)
        basis = found @ (root.T @ mix[:, ::-1])
        values = values[::-1][:k]
        if last is not None and np.abs(values - last).max() <= SETTLED * max(values[0], 1e-300):
            break
        last = values
    w = basis[:, :k].T
    return values, w / np.linalg.norm(w, axis=1, keepdims=True)
