"""One-vs-rest linear classifiers of all classes, fitted together to their one optimum.

For class k the objective is the weighted mean of a hinge of the margin, rounded within WIDTH of its corner so that it
has a curvature, plus reg / 2 |w|^2; the bias is free. It is strictly convex, so the model depends on the rows alone: not
on their order, their partitions or the number of tasks.

A pass reads the rows once and gives loss and gradient of all classes at their trial points, as one block product and one
partial aggregate per task. While the second derivatives of all classes together fit GROUP_BYTES, the pass gives them too
and steps are Newton's (some ten passes). Beyond that steps are limited-memory quasi-Newton (L-BFGS) with one start matrix
for all classes: the second moments of the rows over WIDTH, which no class's curvature exceeds. Both end at the same
optimum. A class whose step did not lower its loss enough tries a shorter one in the next pass, while the others go on.
Classes are fitted in groups whose state is bounded by GROUP_BYTES; a group's problems are independent of all others, so
groups change nothing but the number of passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.operators.matrices import by_width
from idmatch.session import durable

#: Where the hinge is rounded; steps remembered; state of a group; width up to which the start matrix is full.
WIDTH, MEMORY, GROUP_BYTES, FULL = 0.5, 8, 64 << 20, 1024
PAIRS, ENOUGH, TINY, LEAST = 1_000_000, 1e-4, 1e-9, 1e-7
#: Bytes of fitting input in a partition, about (never more partitions than the rows have).
PARTITION_BYTES = 64 << 20


def _pass(rows: DataFrame, classes: np.ndarray, weight: np.ndarray, w: np.ndarray, curved: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Summed loss (k), gradient (k, d + 1) and, if ``curved``, second derivatives (k, d + 1, d + 1) at w; the bias is last."""
    k, d = len(classes), w.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, bend = np.zeros(k), np.zeros((k, d + 1)), np.zeros((k, d + 1, d + 1) if curved else (k, 0))
        for batch in batches:
            for _, (at, x) in by_width(batch.column("v")).items():
                label = batch.column("label").to_numpy(zero_copy_only=False)[at]
                for s in range(0, len(at), step := max(1, PAIRS // k)):
                    part, own = x[s : s + step], label[s : s + step, None] == classes[None, :]
                    short = 1.0 - np.where(own, 1.0, -1.0) * (part @ w[:, :d].T + w[:, d])
                    cost = np.where(own, weight, 1.0)
                    loss += (cost * np.where(short < WIDTH, np.maximum(short, 0.0) ** 2 / (2 * WIDTH), short - WIDTH / 2)).sum(axis=0)
                    push = -cost * np.clip(short / WIDTH, 0.0, 1.0) * np.where(own, 1.0, -1.0)
                    slope[:, :d] += push.T @ part
                    slope[:, d] += push.sum(axis=0)
                    for i in range(k) if curved else ():
                        at_bend = np.flatnonzero((short[:, i] > 0.0) & (short[:, i] < WIDTH))
                        one = np.c_[part[at_bend], np.ones(len(at_bend))]
                        bend[i] += (one * cost[at_bend, i, None]).T @ one / WIDTH
        sums = np.c_[loss, slope, bend.reshape(k, -1)]
        ends = pa.array(np.arange(0, sums.size + 1, sums.shape[1]), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.ListArray.from_arrays(ends, pa.array(sums.reshape(-1)))], ["k", "sums"])

    sums = rows.mapInArrow(run, "k long, sums array<double>").groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    found = np.array([r["sums"] for r in sorted(sums.collect(), key=lambda r: r["k"])])
    return found[:, 0], found[:, 1 : d + 2], found[:, d + 2 :].reshape(k, d + 1, d + 1) if curved else None


def _moments(rows: DataFrame, d: int) -> np.ndarray:
    """Summed products of the values of a row (and 1); only the diagonal for wide rows."""
    full = d < FULL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1) if full else d + 1)
        for batch in batches:
            for _, (_, x) in by_width(batch.column("v")).items():
                x = np.c_[x, np.ones(len(x))]
                total += x.T @ x if full else (x**2).sum(axis=0)
        lines = total.reshape(-1, d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lines))), pa.array(lines.tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    sums = rows.mapInArrow(run, "i long, sums array<double>").groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    found = np.array([r["sums"] for r in sorted(sums.collect(), key=lambda r: r["i"])])
    return found if full else np.diag(found[0])


class Steps:
    """Directions of many problems side by side, from the last steps and changes of gradient of each."""

    def __init__(self, start: np.ndarray):
        self.inverse, self.held = np.linalg.inv(start), []

    def add(self, step: np.ndarray, change: np.ndarray) -> None:
        bend = (step * change).sum(axis=1)
        good = bend > 1e-14 * np.sqrt((step**2).sum(axis=1) * (change**2).sum(axis=1)).clip(1e-300)
        self.held = [*self.held, (step, change, np.where(good, 1.0 / np.where(good, bend, 1.0), 0.0))][-MEMORY:]

    def down(self, slope: np.ndarray) -> np.ndarray:
        q, shares = slope.copy(), []
        for step, change, bend in reversed(self.held):
            share = bend * (step * q).sum(axis=1)
            q -= share[:, None] * change
            shares.append(share)
        q = q @ self.inverse
        for (step, change, bend), share in zip(self.held, reversed(shares), strict=True):
            q += (share - bend * (change * q).sum(axis=1))[:, None] * step
        return -q


def _group(rows: DataFrame, classes: np.ndarray, weight: np.ndarray, total: np.ndarray, start: np.ndarray, newton: bool, reg: float, passes: int, tolerance: float) -> np.ndarray:
    """Weights (k, d + 1) of some classes; ``total`` is the summed cost of the rows for each.

    A Newton step leans on ``start`` (no curvature exceeds it, so leaning on all of it always goes down): ten times less
    after a step that fits, ten times more after one that does not. A quasi-Newton step that does not fit is halved.
    """
    k, d = len(classes), len(start) - 1
    ridge, worst = np.append(np.full(d, reg), 0.0), max(1.0, weight.max())

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        loss, slope, bend = _pass(rows, classes, weight, w, newton)
        bend = bend / total[:, None, None] + np.diag(ridge) if newton else None
        return loss / total + (ridge * w**2).sum(axis=1) / 2, slope / total[:, None] + ridge * w, bend

    def downhill() -> np.ndarray:
        return -np.linalg.solve(bend + worst * lean[:, None, None] * start, slope[:, :, None])[:, :, 0] if newton else steps.down(slope)

    w, length, lean, steps = np.zeros((k, d + 1)), np.ones(k), np.ones(k), None if newton else Steps(start)
    loss, slope, bend = at(w)
    way = downhill()
    for _ in range(passes):
        if np.abs(slope).max() <= tolerance:
            break
        tried = w + length[:, None] * way
        new_loss, new_slope, new_bend = at(tried)
        fits = new_loss <= loss + ENOUGH * length * (way * slope).sum(axis=1) + 1e-15
        moved = np.where(fits[:, None], tried, w)
        change = np.where(fits[:, None], new_slope - slope, 0.0)
        step, w, loss, slope = moved - w, moved, np.where(fits, new_loss, loss), slope + change
        if newton:
            bend = np.where(fits[:, None, None], new_bend, bend)
            lean = np.where(fits, np.maximum(lean / 10, LEAST), np.minimum(lean * 10, 1.0))
            way = downhill()
        else:
            steps.add(step, change)
            way = np.where(fits[:, None], downhill(), way)
            length = np.where(fits, 1.0, length / 2)
    return w


def joint_fit(df: DataFrame, reg: float = 0.001, weights: Mapping[int, float] | None = None, passes: int = 100, tolerance: float = 1e-7,
              only: list[int] | None = None, label: str = "label", v: str = "v", group_bytes: int = GROUP_BYTES) -> list[tuple[int, list[float], float]]:
    """(class, weights, bias) of every class (or those in ``only``), each against all other rows.

    ``weights`` gives the cost of a class's own rows; other rows cost 1. The fit stops when no class's gradient exceeds
    ``tolerance``, after ``passes`` passes at the latest. Rows with a null label, or a vector that is null, of another
    width than the widest, or not finite take no part.
    """
    rows = df.select(V.as_vector(v).alias("v"), F.col(label).cast("long").alias("label"))
    rows = durable(rows.filter(F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))))
    size = rows.agg(F.max(F.size("v")).alias("d"), F.sum(F.size("v")).alias("values")).first()
    d = size["d"] or 0
    if d < 1:
        return []
    rows_d = rows.filter(F.size("v") == d).coalesce(size["values"] * 8 // PARTITION_BYTES + 1).persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["label"]: r["n"] for r in rows_d.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, names = sum(counts.values()), sorted(counts if only is None else only)
    weight = np.array([(weights or {}).get(c, 1.0) for c in names])
    total = np.array([n + (cost - 1.0) * counts.get(c, 0) for c, cost in zip(names, weight, strict=True)])
    newton = len(names) * 8 * (d + 1) ** 2 <= group_bytes
    start = _moments(rows_d, d) / (n * WIDTH) + np.diag(np.append(np.full(d, reg), 0.0) + TINY)
    per_group = len(names) if newton else max(1, group_bytes // ((2 * MEMORY + 6) * 8 * (d + 1)))
    out = []
    for a in range(0, len(names), per_group):
        part = slice(a, a + per_group)
        w = _group(rows_d, np.array(names[part]), weight[part], total[part], start, newton, reg, passes, tolerance)
        out += [(int(c), x[:d].tolist(), float(x[d])) for c, x in zip(names[part], w, strict=True)]
    rows_d.unpersist()
    return out
