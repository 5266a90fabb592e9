"""Linear reductions (PCA, LDA): distributed scatter, a d x d solve on the driver, projection in batches.

Vectors wider than MAX_DIMS are reduced without that matrix (``wide``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.operators import wide
from idmatch.operators.matrices import matrix
from idmatch.session import durable

# Fixed values.
PCA_COMPONENTS = 120
LDA_RIDGE = 0.001
#: Up to this width the d x d problem is solved on the driver: 200 MB a matrix.
MAX_DIMS = 5000
#: Bytes of scatter matrices that all tasks together send, about.
SCATTER_BYTES = 4 << 30

MODEL_SCHEMA = "mean array<double>, components array<array<double>>, values array<double>"


def _model(spark: SparkSession, mean: np.ndarray, components: np.ndarray, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(mean.tolist(), components.tolist(), values.tolist())], MODEL_SCHEMA)


def _dims(df: DataFrame, v: str) -> int:
    d = df.agg(F.max(F.size(v))).first()[0] or 0
    if d < 1:
        raise ValueError("there is no vector to fit")
    return d


def _signed(components: np.ndarray) -> np.ndarray:
    return components * np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])[:, None]


def vector_mean(df: DataFrame, v: str = "v") -> np.ndarray:
    mean = df.agg(vector_to_array(Summarizer.mean(array_to_vector(V.as_vector(v)))).alias("m")).first()["m"]
    return np.array(mean)


def scatter(df: DataFrame, centre: np.ndarray, v: str = "v", weight: str | None = None) -> np.ndarray:
    """Sum of weight * (x - centre)(x - centre)' over all rows.

    Each task adds up one matrix and sends its upper triangle row by row; rows are summed by number, so the merge is
    spread over d keys and the driver receives d rows in all. Wide vectors are read by fewer tasks, so that what they
    send stays near ``SCATTER_BYTES`` whatever the number of rows. Rows of another width are left out.
    """
    d = len(centre)
    rows = _weighted(df, d, v, weight)
    if d > 512:
        rows = rows.coalesce(max(8, SCATTER_BYTES // (4 * d * d)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                x = matrix(part.column("v")) - centre
                total += (x * part.column("w").to_numpy(zero_copy_only=False)[:, None]).T @ x
        upper = total[np.triu_indices(d)]
        ends = np.concatenate([[0], np.cumsum(np.arange(d, 0, -1))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(upper))], ["i", "row"])

    merged = rows.mapInArrow(partial, "i long, row array<double>").groupBy("i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")
    )
    out = np.zeros((d, d))
    for batch in merged.toArrow().to_batches():
        for i, row in zip(batch.column("i").to_pylist(), batch.column("row"), strict=True):
            out[i, i:] = row.values.to_numpy(zero_copy_only=False)
    return out + np.triu(out, 1).T


def pca_fit(df: DataFrame, k: int = PCA_COMPONENTS, v: str = "v") -> DataFrame:
    """One-row model (mean, components, eigenvalues of the sample covariance); k is bounded by the dimension.

    A component's sign makes its largest value positive.
    """
    d = _dims(df, v)
    k = min(k, d)
    mean = vector_mean(df.filter(F.size(v) == d), v)
    n = df.filter(F.size(v) == d).count()
    if d > MAX_DIMS:
        values, components = wide.principal(durable(_weighted(df, d, v)), mean, n, k)
        return _model(df.sparkSession, mean, _signed(components), values)
    values, vectors = np.linalg.eigh(scatter(df, mean, v) / max(n - 1, 1))
    order = np.argsort(-values, kind="stable")[:k]
    return _model(df.sparkSession, mean, _signed(vectors[:, order].T), values[order])


def _weighted(df: DataFrame, d: int, v: str, weight: str | None = None) -> DataFrame:
    """Rows (v, w) of one width."""
    return df.select(V.as_vector(v).alias("v"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).filter(F.size("v") == d)


def lda_fit(df: DataFrame, k: int, label: str = "label", v: str = "v") -> DataFrame:
    """Fisher discriminants: leading solutions of Sb w = l Sw w, with a small ridge on Sw.

    Within-scatter is total minus between scatter, so the rows are read once and never joined to class means.
    """
    d = _dims(df, v)
    df = durable(df.select(F.col(label).alias(label), V.as_vector(v).alias(v)).filter(F.size(v) == d))
    mean = vector_mean(df, v)
    groups = df.groupBy(label).agg(
        Summarizer.metrics("mean", "count").summary(array_to_vector(V.as_vector(v))).alias("s")
    ).select(vector_to_array("s.mean").alias("v"), F.col("s.count").alias("n"))
    groups = durable(groups)
    if d > MAX_DIMS:
        k = max(1, min(k, groups.count() - 1, d))
        rows, centres = _weighted(df, d, v), _weighted(groups, d, "v", "n")
        add = LDA_RIDGE * (wide.trace(rows, mean) - wide.trace(centres, mean)) / d
        values, w = wide.discriminants(lambda b: wide.scatter_times(rows, mean, b), lambda b: wide.scatter_times(centres, mean, b), d, add, k)
        return _model(df.sparkSession, mean, w, values)
    between = scatter(groups, mean, "v", "n")
    within = scatter(df, mean, v) - between
    within += np.eye(d) * (LDA_RIDGE * np.trace(within) / d)
    classes = groups.count()
    k = max(1, min(k, classes - 1, d))
    root = np.linalg.cholesky(within)
    half = np.linalg.solve(root, np.linalg.solve(root, between).T)
    values, vectors = np.linalg.eigh((half + half.T) / 2)
    order = np.argsort(-values)[:k]
    w = np.linalg.solve(root.T, vectors[:, order]).T
    return _model(df.sparkSession, mean, w / np.linalg.norm(w, axis=1, keepdims=True), values[order])


def project_vectors(df: DataFrame, model: DataFrame, v: str = "v") -> DataFrame:
    """(x - mean) on every component; rows of another dimension are dropped.

    The model is one row; rows stay in place.
    """
    row = model.first()
    mean, components = np.array(row["mean"]), np.array(row["components"])
    rows = df.withColumn(v, V.as_vector(v)).filter(F.size(v) == len(mean))
    at = rows.columns.index(v)
    k = len(components)
    shared = df.sparkSession.sparkContext.broadcast((mean, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, components = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            y = (matrix(batch.column(at)) - mean) @ components.T
            ends = pa.array(np.arange(0, (batch.num_rows + 1) * k, k), pa.int32())
            yield batch.set_column(at, v, pa.ListArray.from_arrays(ends, pa.array(y.reshape(-1))))

    return rows.mapInArrow(run, rows.schema)


def component_table(model: DataFrame) -> DataFrame:
    """(comp, value, c) rows of a reduction model."""
    pairs = F.arrays_zip(F.col("components").alias("c"), F.col("values").alias("x"))
    return model.select(F.posexplode(pairs).alias("comp", "p")).select("comp", F.col("p.x").alias("value"), F.col("p.c").alias("c"))
