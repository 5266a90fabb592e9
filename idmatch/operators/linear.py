"""Linear one-vs-rest models: fitting, bias rules, adding a class, sweeps.

A model is a table with one row per class: (class, w, b, platt_a, platt_b, thr). The last three are
carried for stored models and stay null: nothing here fits them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.functions.draws import shuffle_key
from idmatch.operators import exact, joint, metrics, reduce, scoring, split
from idmatch.operators.rows import beside
from idmatch.session import durable

# Shares and limits of the training rules.
NEGATIVE_CLASS_SHARE = 0.75
BIAS_REACH, BIAS_TARGET = 3.0, 2.5
BAD_F1, BAD_FP_SHARE, BIAS_PENALTY = 15.0, 0.15, 1.5
MIN_CURVE_ROWS = 42
PCA_SWEEP = (35, 45, 55, 65, 75, 85, 95)

MODEL_SCHEMA = "class long, w array<double>, b double, platt_a double, platt_b double, thr double"
PASSES = 100


def _model_rows(spark, rows: list[tuple[int, list[float], float]]) -> DataFrame:
    return spark.createDataFrame([(c, w, b, None, None, None) for c, w, b in rows], MODEL_SCHEMA)


def ova_svm_fit(df: DataFrame, reg: float = 0.001, passes: int = PASSES, label: str = "label", v: str = "v") -> DataFrame:
    """One hinge-loss classifier per class, all fitted together (:func:`joint.joint_fit`)."""
    return _model_rows(df.sparkSession, joint.joint_fit(df, reg, passes=passes, label=label, v=v))


def positive_weight(negatives: int, positives: int, logarithmic: bool = False) -> float:
    """Driver-side form of ``class_weight`` for one class."""
    ratio = negatives / max(1, positives)
    raw = (math.log(ratio + 1.0) if logarithmic else math.sqrt(ratio)) * V.WEIGHT_FACTOR
    return min(max(raw, V.WEIGHT_MIN), V.WEIGHT_MAX)


def ova_svm_fit_weighted(df: DataFrame, c: float = 1.0, passes: int = PASSES, label: str = "label", v: str = "v",
                         logarithmic: bool = False) -> DataFrame:
    """One classifier per class with the positive side weighted by its imbalance and 1 / (C m) as L2."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    m = sum(counts.values())
    weights = {k: positive_weight(m - n, n, logarithmic) for k, n in counts.items()}
    return _model_rows(df.sparkSession, joint.joint_fit(df, 1.0 / (c * max(m, 1)), weights, passes, label=label, v=v))


def negative_class_sample(df: DataFrame, new_class: int, share: float = NEGATIVE_CLASS_SHARE, seed: int = 42,
                          label: str = "label") -> DataFrame:
    """All rows of the new class and of ceil(share * k) seeded other classes."""
    share = share if 0.0 < share <= 1.0 else NEGATIVE_CLASS_SHARE
    others = df.select(label).filter(F.col(label) != new_class).distinct()
    wanted = F.least(F.greatest(F.ceil(F.col("n") * share), F.lit(1)), F.col("n"))
    kept = exact.mark_first(others, [], label, seed, wanted).filter("chosen").select(label)
    mine = df.filter(F.col(label) == new_class)
    return mine.unionByName(df.join(kept, label, "left_semi").select(*df.columns))


def bias_clamp(new: DataFrame, model: DataFrame) -> DataFrame:
    """A bias beyond mean +- 3 sd of the model's is averaged with mean +- 2.5 sd."""
    stats = model.agg(F.struct(F.avg("b").alias("m"), F.stddev_pop("b").alias("s"))).scalar()
    m, s, b = stats.getField("m"), stats.getField("s"), F.col("b")
    clamped = (
        F.when(b > m + s * BIAS_REACH, (b + m + s * BIAS_TARGET) / 2.0)
        .when(b < m - s * BIAS_REACH, (b + m - s * BIAS_TARGET) / 2.0)
        .otherwise(b)
    )
    return new.withColumn("b", clamped)


def bias_penalty(model: DataFrame, binary: DataFrame, met_targets: DataFrame | None = None) -> DataFrame:
    """Classes that never met the targets and are poor (F1 < 15, or false positives above 15 % of the
    negatives) get a lower bias. ``binary`` holds one-vs-rest metric rows; ``met_targets`` the saved classes.
    """
    allowed = F.floor((F.col("tn") + F.col("fp")) * BAD_FP_SHARE)
    poor = binary.filter((F.col("f1") < BAD_F1) | (F.col("fp") > allowed)).select("class", F.lit(True).alias("__poor"))
    if met_targets is not None:
        poor = poor.join(met_targets.select("class").distinct(), "class", "left_anti")
    b = F.when(F.col("__poor"), F.col("b") - BIAS_PENALTY).otherwise(F.col("b"))
    return model.join(poor, "class", "left").withColumn("b", b).drop("__poor")


def one_vs_rest_counts(df: DataFrame, model: DataFrame, label: str = "label", key: str = "sample_id", v: str = "v") -> DataFrame:
    """tp, tn, fp, fn per class with acceptance at score >= 0, each class decided on its own."""
    probes = df.select(F.col(key).alias("probe_id"), F.col(label).alias("label"), F.col(v).alias("v"))
    scored = scoring.score_all(probes, model.withColumnRenamed("w", "t"), scoring.LINEAR)
    truth = scored.join(probes.select("probe_id", "label"), "probe_id")
    hit, own = F.col("score") >= 0.0, F.col("label") == F.col("class")
    counts = truth.groupBy("class").agg(
        F.count_if(hit & own).alias("tp"), F.count_if(~hit & ~own).alias("tn"),
        F.count_if(hit & ~own).alias("fp"), F.count_if(~hit & own).alias("fn"),
    )
    return metrics.binary_columns(counts)


def add_class(model: DataFrame, df: DataFrame, new_class: int, reg: float = 0.001, passes: int = PASSES,
              share: float = NEGATIVE_CLASS_SHARE, seed: int = 42, label: str = "label", v: str = "v") -> DataFrame:
    """Model with one more class, fitted against a seeded share of the other classes.

    An already known class is refused. Only the bias is adjusted afterwards; metrics are for
    :func:`one_vs_rest_counts` to compute from data.
    """
    if model.filter(F.col("class") == new_class).limit(1).count():
        raise ValueError(f"class {new_class} is already in the model")
    rows = negative_class_sample(df, new_class, share, seed, label)
    fitted = _model_rows(df.sparkSession, joint.joint_fit(rows, reg, passes=passes, only=[new_class], label=label, v=v))
    return model.unionByName(bias_clamp(fitted, model))


def predict(df: DataFrame, model: DataFrame, key: str = "sample_id", label: str = "label", v: str = "v") -> DataFrame:
    """(probe_id, real, pred, s1, s2) of the linear model."""
    probes = df.select(F.col(key).alias("probe_id"), F.col(label).alias("label"), F.col(v).alias("v"))
    best = scoring.claimed_scores(probes, model.withColumnRenamed("w", "t"), scoring.LINEAR)
    return best.select("probe_id", F.col("label").alias("real"), "pred", "s1", "s2")


def evaluate(df: DataFrame, model: DataFrame, **names) -> DataFrame:
    """Summary metrics and MCC of a model on labelled rows, one row."""
    counts = durable(metrics.confusion(predict(df, model, **names)))  # read by several metrics
    return beside(metrics.summary_metrics(counts), metrics.mcc_multiclass(counts))


def sweep(train: DataFrame, test: DataFrame, regs: Iterable[float] = (), pca: Iterable[int] = (),
          reg: float = 0.001, passes: int = PASSES, **names) -> DataFrame:
    """One row per tried value: regularisations on the given vectors, then component counts at ``reg``.

    The component counts share one PCA fit: the k leading components are the same for every k.
    """
    out: list[DataFrame] = []
    for r in regs:
        result = evaluate(test, ova_svm_fit(train, r, passes), **names)
        out.append(result.select(F.lit("reg").alias("parameter"), F.lit(float(r)).alias("value"), *result.columns))
    counts = sorted(set(pca))
    if counts:
        fitted = reduce.pca_fit(train, counts[-1])
        for k in counts:
            cut = fitted.select("mean", F.slice("components", 1, k).alias("components"), F.slice("values", 1, k).alias("values"))
            a, b = reduce.project_vectors(train, cut), reduce.project_vectors(test, cut)
            result = evaluate(b, ova_svm_fit(a, reg, passes), **names)
            out.append(result.select(F.lit("components").alias("parameter"), F.lit(float(k)).alias("value"), *result.columns))
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


def learning_curve(df: DataFrame, class_counts: Iterable[int], repeats: int = 3, min_rows: int = MIN_CURVE_ROWS,
                   ratio: float = 0.2, reg: float = 0.001, passes: int = PASSES, seed: int = 42,
                   key: str = "sample_id", label: str = "label") -> DataFrame:
    """One row per (class count, repeat): seeded classes with enough rows, split, fit, metrics."""
    big = df.groupBy(label).agg(F.count("*").alias("__n")).filter(F.col("__n") >= min_rows).select(label)
    out: DataFrame | None = None
    for k in class_counts:
        for r in range(repeats):
            s = seed + r
            chosen = big.orderBy(shuffle_key(F.col(label), s), label).limit(k)
            parts = split.split_ratio(df.join(chosen, label, "left_semi"), ratio, key, label, s)
            model = ova_svm_fit(parts.filter("split = 'train'"), reg, passes, label)
            result = evaluate(parts.filter("split = 'test'"), model, key=key, label=label)
            row = result.select(
                F.lit(k).cast("long").alias("classes"), F.lit(r).cast("long").alias("run"), "accuracy",
                F.col("f1_macro").alias("f1"), F.col("balanced_accuracy").alias("balanced"), "mcc",
            )
            out = row if out is None else out.unionByName(row)
    return out


def regression_gate(new_accuracy: DataFrame, baseline: DataFrame, drop: float = 2.0) -> DataFrame:
    """One row: holdout accuracy, baseline, change, and keep / reject. Without a baseline the new one is kept."""
    named = lambda df, name: df.select(F.col(df.columns[0]).alias(name))
    j = beside(named(new_accuracy, "accuracy"), named(baseline, "baseline"))
    change = F.col("accuracy") - F.col("baseline")
    verdict = F.when(change < -drop, "reject").otherwise("keep")
    return j.withColumn("change", change).withColumn("verdict", verdict)
