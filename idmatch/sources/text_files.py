"""Delimited text: labelled vectors, templates, label maps, parameters, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idmatch.operators import metrics

# Delimiters and line patterns of the stored files.
DELIMITER = ";"
MAP_LINE = r"Etiqueta real (\d+) \S+ clase interna (\d+)"
PAIR_LINE = r"^\s*(\d+)\s*=\s*(\d+)\s*$"
CSV_PAIR_LINE = r"^\s*(\d+)\s*,\s*(\d+)\s*$"


def _tokens(delimiter: str) -> Column:
    return F.filter(F.split("value", rf"\Q{delimiter}\E"), lambda t: F.trim(t) != "")


def _numbers(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.trim(t).try_cast("double"))


def _parsed(spark: SparkSession, path: str, delimiter: str, least: int, label: bool) -> DataFrame:
    """(value, x, bad): each line, its numbers, and whether one of its tokens is no number or its label no integer."""
    lines = spark.read.text(path).select("value", _numbers(_tokens(delimiter)).alias("x")).filter(F.size("x") >= least)
    bad = F.exists("x", lambda n: n.isNull())
    if label:
        last = F.element_at("x", -1)
        bad = bad | F.isnan(last) | (F.abs(last) >= 2.0**31)
    return lines.withColumn("bad", F.coalesce(bad, F.lit(True)))


def _strict(lines: DataFrame) -> DataFrame:
    """Lines without bad tokens; a bad one ends the job, naming the line."""
    return lines.withColumn("x", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("bad value in line: "), "value"))).otherwise(F.col("x")))


def read_labeled_csv(spark: SparkSession, path: str, delimiter: str = DELIMITER, strict: bool = True) -> DataFrame:
    """(label, v): label last and truncated; lines with fewer than two values are dropped.

    A token that is no number ends the job; with ``strict=False`` its line is left out, see :func:`labeled_csv_rejects`.
    """
    lines = _parsed(spark, path, delimiter, 2, True)
    return (_strict(lines) if strict else lines.filter("NOT bad")).select(
        F.element_at("x", -1).cast("int").alias("label"), F.slice("x", F.lit(1), F.size("x") - 1).alias("v")
    )


def labeled_csv_rejects(spark: SparkSession, path: str, delimiter: str = DELIMITER) -> DataFrame:
    """(line, bad_tokens): the lines that a lenient reading leaves out."""
    return _parsed(spark, path, delimiter, 2, True).filter("bad").select(
        F.col("value").alias("line"), F.size(F.filter("x", lambda n: n.isNull())).cast("long").alias("bad_tokens"))


def read_vector_csv(spark: SparkSession, path: str, delimiter: str = DELIMITER, strict: bool = True) -> DataFrame:
    """(v) of each line with at least one value; bad tokens as in :func:`read_labeled_csv`."""
    lines = _parsed(spark, path, delimiter, 1, False)
    return (_strict(lines) if strict else lines.filter("NOT bad")).select(F.col("x").alias("v"))


def _joined(delimiter: str, *parts: Column) -> Column:
    return F.concat_ws(delimiter, *parts)


def _as_text(v: str) -> Column:
    return F.transform(v, lambda x: x.cast("string"))


def write_labeled_csv(df: DataFrame, path: str, label: str = "label", v: str = "v", delimiter: str = DELIMITER,
                      mode: str = "errorifexists") -> None:
    """One line per row, label last. Empty input and rows without label or vector are refused."""
    check = df.agg(F.count("*").alias("n"), F.count_if(F.col(label).isNull() | F.col(v).isNull()).alias("bad")).first()
    if check["n"] == 0 or check["bad"]:
        raise ValueError(f"{check['n']} rows, {check['bad']} of them without label or vector")
    df.select(_joined(delimiter, _as_text(v), F.col(label).cast("string")).alias("value")).write.mode(mode).text(path)


def read_templates(spark: SparkSession, path: str, delimiter: str = DELIMITER) -> DataFrame:
    """(class, t): class first; a bad class drops the row, a bad value counts as 0."""
    line = F.regexp_replace("value", rf"\Q{delimiter}\E$", "")
    tokens = spark.read.text(path).select(F.split(line, rf"\Q{delimiter}\E").alias("t"))
    values = F.transform(
        F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))),
        lambda x: F.coalesce(F.trim(x).try_cast("double"), F.lit(0.0)),
    )
    rows = tokens.select(F.trim(F.element_at("t", 1)).try_cast("long").alias("class"), values.alias("t"))
    return rows.filter(F.col("class").isNotNull() & (F.size("t") > 0))


def write_templates(df: DataFrame, path: str, delimiter: str = DELIMITER, mode: str = "errorifexists") -> None:
    df.select(_joined(delimiter, F.col("class").cast("string"), _as_text("t")).alias("value")).write.mode(mode).text(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(ext_id, class_idx) from any of three line forms: sentence, k=v, or two-column CSV."""
    line = F.col("value")
    found = lambda i: F.coalesce(*[
        F.when(F.regexp_extract(line, p, i) != "", F.regexp_extract(line, p, i)) for p in (MAP_LINE, PAIR_LINE, CSV_PAIR_LINE)
    ]).cast("long")
    return spark.read.text(path).select(found(1).alias("ext_id"), found(2).alias("class_idx")).dropna()


def write_label_map(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col("ext_id").alias("speaker_id"), F.col("class_idx").alias("index")).write.mode(mode).csv(path, header=True)


def read_phase_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Phase logs of all workers; header lines and short lines fall out when numbers are parsed."""
    return spark.read.schema(metrics.PHASE_LOG).csv(paths)


def write_report(df: DataFrame, path: str, delimiter: str = DELIMITER, mode: str = "errorifexists") -> None:
    """Report rows as delimited text with a header: metrics, confusion, curves, quality batches."""
    df.write.mode(mode).csv(path, header=True, sep=delimiter)


def feature_csv(df: DataFrame, d: int, v: str = "v", ids: tuple[str, ...] = ()) -> DataFrame:
    """Wide form with one named column per value, for report files."""
    return df.select(*ids, *[F.get(F.col(v), F.lit(i)).alias(f"f{i}") for i in range(d)])


def far_frr_report(curve: DataFrame, percent: bool = True) -> DataFrame:
    """Curve rows in report form: percent (umbral, FAR, FRR) or fractions (umbral, far, frr, err)."""
    if percent:
        return curve.select(F.col("threshold").alias("umbral"), F.col("far").alias("FAR"), F.col("frr").alias("FRR"))
    share = lambda c: (F.col(c) / 100.0).alias({"gap": "err"}.get(c, c))
    return curve.select(F.col("threshold").alias("umbral"), share("far"), share("frr"), share("gap"))


def roc_report(points: DataFrame) -> DataFrame:
    return points.select("threshold", *[F.col(c).alias(c.upper()) for c in ("tpr", "fpr", "far", "frr")])


def per_class_report(per_class: DataFrame) -> DataFrame:
    return per_class.select(
        F.col("class").alias("Clase"), F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
        F.col("f1").alias("F1"), F.col("support").alias("Soporte"),
    )


def confusion_report(counts: DataFrame, classes: list[int]) -> DataFrame:
    """Counts (real, pred, n) as one row Real_i for each listed class, with a column Pred_j for each; absent pairs are 0."""
    wide = metrics.confusion_matrix(counts, classes)
    listed = counts.sparkSession.createDataFrame([(c,) for c in classes], f"real {counts.schema['real'].dataType.simpleString()}")
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"Pred_{c}") for c in classes]
    return listed.join(wide, "real", "left").select(F.concat(F.lit("Real_"), F.col("real")).alias("Real"), *cells)


def quality_batch_report(rows: DataFrame) -> DataFrame:
    """Batch of recognitions under changed conditions in report form.

    ``rows`` holds (user_real, y_true, filename, condition, pred, s1, s2, time_ms) and the columns of
    :func:`quality.value_profile`. A recognition without a class is not ok.
    """
    profile = {"mean_x": "qc_mean", "sd_x": "qc_std", "low_pct": "qc_pct_dark", "high_pct": "qc_pct_bright", "min_x": "qc_min", "max_x": "qc_max"}
    return rows.select(
        "user_real", "y_true", "filename", "condition", *[F.col(a).alias(b) for a, b in profile.items()], "pred",
        F.col("s1").alias("score1"), F.col("s2").alias("score2"), (F.col("s1") - F.col("s2")).alias("margin"),
        F.coalesce((F.col("pred") == F.col("y_true")).cast("int"), F.lit(0)).alias("ok"), "time_ms")
