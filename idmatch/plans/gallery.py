"""Fit a gallery: standardise, reduce, template, calibrate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.operators import curves, reduce, scoring, vectorsets
from idmatch.operators.rows import beside
from idmatch.session import durable


@dataclass
class FittedGallery:
    """Everything a probe needs on its way to a decision, as tables."""

    zscore: DataFrame
    pca: DataFrame
    lda: DataFrame
    templates: DataFrame
    curve: DataFrame
    threshold: DataFrame

    def transform(self, df: DataFrame, v: str = "v") -> DataFrame:
        """The same chain for every later vector."""
        z = vectorsets.zscore_transform(df.withColumn(v, V.as_vector(v)), self.zscore, v)
        return unit(reduce.project_vectors(unit(reduce.project_vectors(z, self.pca, v), v), self.lda, v), v)


def unit(df: DataFrame, v: str = "v") -> DataFrame:
    return df.withColumn(v, V.l2_normalize(F.col(v)))


def fit_gallery(train: DataFrame, calibration: DataFrame, pca_k: int = reduce.PCA_COMPONENTS, lda_k: int = 99,
                steps: int = curves.STEPS, key: str = "sample_id", label: str = "label", v: str = "v") -> FittedGallery:
    """z-score, PCA, unit norm, LDA, unit norm, class means, then FAR / FRR on the calibration rows.

    The calibration counts are reduced inside the scoring tasks: two passes over the probes (range, then
    steps), no score table.
    """
    train = durable(train.withColumn(v, V.as_vector(v)))
    z = vectorsets.zscore_fit(train, v)
    z_rows = z.first()
    z = train.sparkSession.createDataFrame([z_rows], z.schema)
    scaled = durable(vectorsets.zscore_transform(train.select(key, label, v), z, v))
    pca = reduce.pca_fit(scaled, pca_k, v)
    reduced = durable(unit(reduce.project_vectors(scaled, pca, v), v))
    lda = reduce.lda_fit(reduced, lda_k, label, v)
    final = unit(reduce.project_vectors(reduced, lda, v), v)
    templates = durable(vectorsets.class_centroids(final, label, v))
    fitted = FittedGallery(z, pca, lda, templates, templates, templates)
    probes = fitted.transform(calibration, v).select(
        F.col(key).cast("long").alias("probe_id"), F.col(label).cast("long").alias("label"), F.col(v).alias("v")
    )
    fitted.curve = calibrate(probes, templates, steps)
    best = curves.eer(fitted.curve)
    sizes = scoring.known_claims(probes, templates).agg(F.count("*").alias("genuine"))
    fitted.threshold = beside(best.select("threshold", "eer"), sizes)
    return fitted


def calibrate(probes: DataFrame, templates: DataFrame | scoring.Enrolled, steps: int = curves.STEPS, metric: str = scoring.COSINE,
              digits: int | None = None) -> DataFrame:
    """FAR / FRR curve of probes against a gallery without materialising a pair.

    Only finite scores count, in the range as in the rates; ``scoring.score_range`` tells how many others there are.
    """
    steps = max(steps, curves.MIN_STEPS)
    templates = scoring.enrol(templates)
    probes = durable(scoring.known_claims(probes, templates))  # read twice: range, then steps
    bounds = scoring.score_range(probes, templates, metric).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None or not hi > lo:
        lo, hi = (lo or 0.0), (lo or 0.0)
    if digits is not None:
        lo, hi = round(lo, digits), round(hi, digits)
    counts = scoring.score_histogram(probes, templates, lo, hi, steps, metric, digits=digits)
    curve = curves.curve_from_counts(counts, F.lit(lo), F.lit(hi), steps)
    return curve if hi > lo else curve.filter(F.lit(False))
