"""Train / test leakage: exact copies, near pairs, and a sampled distance summary.

Copies are combined before any join, so a group of copies that holds a third of the rows is one row with
a multiplicity. Candidate pairs come from grid cells of fixed projections: two vectors within distance r
differ by at most r in every unit projection, so looking in the cells within r misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.functions.draws import shuffle_key
from idmatch.operators import exact
from idmatch.operators.rows import beside
from idmatch.operators.matrices import matrix

# Tolerances and verdict levels.
SAME_TOLERANCE = 1e-9
LEAK_PERCENT = 1.0
NEAR = 0.01
EXTREME = 0.001
SAMPLED_PAIRS = 100

MAX_AXES = 16
MAX_VISITS = 32.0  # expected cells per vector


def _copies(df: DataFrame, v: str) -> DataFrame:
    """Distinct vectors with their multiplicity."""
    return df.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("m"))


def exact_leaks(train: DataFrame, test: DataFrame, v: str = "v") -> DataFrame:
    """Distinct test vectors that equal a train vector within the tolerance in every value: (v, m).

    Two such vectors lie in the same or neighbouring cells of two projections, the sum and the alternating sum of the
    values, each at most size * tolerance apart; so no pair is missed, and vectors that agree in one are still split.
    """
    a, b = _copies(test, v), _copies(train, v).drop("m")
    width = F.size("v") * (2 * SAME_TOLERANCE) + SAME_TOLERANCE
    cell = lambda values: F.floor(F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / width)
    even = cell("v")
    odd = cell(F.transform("v", lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)))
    near = F.array(*[F.xxhash64(F.size("v"), F.col("even") + i, F.col("odd") + j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = a.withColumns({"even": even, "odd": odd}).select("v", "m", F.explode(near).alias("cell"))
    right = b.select(F.col("v").alias("w"), F.xxhash64(F.size("v"), even, odd).alias("cell"))
    same = F.forall(F.zip_with("v", "w", lambda x, y: F.abs(x - y) <= SAME_TOLERANCE), lambda ok: ok)
    hits = left.join(right, "cell").filter((F.size("v") == F.size("w")) & same)
    return hits.select("v", "m").distinct()


def leakage_exact(train: DataFrame, test: DataFrame, v: str = "v") -> DataFrame:
    """One row: train and test sizes, leaked test rows, percent, and whether the sets count as disjoint."""
    leaked = exact_leaks(train, test, v).agg(F.coalesce(F.sum("m"), F.lit(0)).alias("leaked"))
    sizes = [df.agg(F.count("*").alias(name)) for df, name in ((train, "train_n"), (test, "test_n"))]
    pct = F.col("leaked") * 100.0 / F.col("test_n")
    return beside(*sizes, leaked).select(
        "train_n", "test_n", "leaked", pct.alias("pct"), (pct < LEAK_PERCENT).alias("disjoint")
    )


@dataclass(frozen=True)
class Grid:
    """Cells of fixed orthonormal projections, ``width`` wide; at least four radii, so a ball meets two cells per axis.

    A cell is named by a sum of its coordinates times odd constants, modulo 2^64. Two cells may share a name;
    that only adds a candidate, which the distance check removes.
    """

    basis: np.ndarray
    width: float
    radius: float

    def _coordinates(self, x: np.ndarray, shift: float) -> np.ndarray:
        return np.floor((x @ self.basis + shift) / self.width).astype(np.int64)

    def _constants(self) -> np.ndarray:
        return np.random.default_rng(11).integers(-(2**62), 2**62, self.basis.shape[1]) * 2 + 1

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, name) of the cell each row lies in."""
        return np.arange(len(x)), (self._coordinates(x, 0.0) * self._constants()).sum(axis=1)

    def reached(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, name) of all cells within the radius: both sides of each near border, combined over the axes."""
        slack, constants = self.radius * (1 + 1e-9) + 1e-12, self._constants()
        low, high = self._coordinates(x, -slack), self._coordinates(x, slack)
        row, name = np.arange(len(x)), (low * constants).sum(axis=1)
        for axis in range(low.shape[1]):
            both = (high[row, axis] > low[row, axis])
            row, name = np.concatenate([row, row[both]]), np.concatenate([name, name[both] + constants[axis]])
        return row, name

    def cells(self, df: DataFrame, pick: str) -> DataFrame:
        """Rows (v, m) repeated for each of their cells, with column ``cell``."""
        place = getattr(self, pick)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    row, name = place(matrix(batch.column("v")))
                    out = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([out.column("v"), out.column("m"), pa.array(name)], ["v", "m", "cell"])

        return df.select("v", "m").mapInArrow(run, "v array<double>, m long, cell long")


def fit_grid(df: DataFrame, dims: int, radius: float, v: str = "v") -> Grid:
    """A grid as fine as the data spread allows, with a bounded number of cells to visit per vector."""
    spread = df.agg(Summarizer.variance(array_to_vector(V.as_vector(v))).alias("s")).first()["s"]
    sd = float(np.sqrt(np.mean(spread.toArray()))) if spread is not None else 0.0
    width = max(4 * radius, sd)
    count = max(1, min(dims, MAX_AXES, int(np.log(MAX_VISITS) / np.log(1 + 2 * radius / width))))
    basis, _ = np.linalg.qr(np.random.default_rng(7).normal(size=(dims, count)))
    return Grid(basis, width, radius)


def near_pairs(train: DataFrame, test: DataFrame, dims: int, radius: float = NEAR, v: str = "v") -> DataFrame:
    """Every distinct (test, train) vector pair closer than ``radius``: (m_test, m_train, distance).

    Exact, without comparing all pairs: a test vector visits its own cell and those within the radius.
    """
    train, test = train.filter(F.size(v) == dims), test.filter(F.size(v) == dims)
    grid = fit_grid(train, dims, radius, v)
    visits = grid.cells(_copies(test, v), "reached").withColumnRenamed("m", "m_test")
    homes = grid.cells(_copies(train, v), "home").withColumnsRenamed({"v": "w", "m": "m_train"})
    distance = V.euclidean(F.col("v"), F.col("w"))
    return visits.join(homes, "cell").select("m_test", "m_train", distance.alias("distance")).filter(
        F.col("distance") < radius
    )


def near_summary(pairs: DataFrame) -> DataFrame:
    """Pair count and least distance over whole tables; least distance is null when no pair is near."""
    return pairs.agg(
        F.coalesce(F.sum(F.col("m_test") * F.col("m_train")), F.lit(0)).alias("near_pairs"),
        F.min("distance").alias("min_near_distance"),
    ).withColumn("extreme", F.coalesce(F.col("min_near_distance") < EXTREME, F.lit(False)))


def leakage_near(
    train: DataFrame, test: DataFrame, key: str = "sample_id", pairs: int = SAMPLED_PAIRS, seed: int = 42,
    v: str = "v",
) -> DataFrame:
    """Sampled pair distances, as a sampling operator: draw i pairs the i-th shuffled test row with the
    i-th shuffled train row. One row: (pairs, min_distance, mean_distance, near).
    """

    def drawn(df: DataFrame, column: str, s: int) -> DataFrame:
        picked = exact.mark_first(df.select(key, v), [], key, s, F.lit(pairs)).filter("chosen")
        digest = shuffle_key(F.col(key), s)
        i = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(digest, key))
        return picked.select(i.alias("i"), F.col(v).alias(column))

    d = drawn(test, "a", seed).join(drawn(train, "b", seed + 1), "i").select(
        V.euclidean(F.col("a"), F.col("b")).alias("d")
    )
    return d.agg(
        F.count("*").alias("pairs"), F.min("d").alias("min_distance"), F.avg("d").alias("mean_distance"),
        F.count_if(F.col("d") < NEAR).alias("near"),
    )
