"""Classification metrics over (real, pred) pairs. Everything after D3 works on the confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idmatch.operators import exact


def confusion(pairs: DataFrame, real: str = "real", pred: str = "pred") -> DataFrame:
    """Counts (real, pred, n)."""
    return pairs.groupBy(F.col(real).alias("real"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def closed_confusion(counts: DataFrame) -> DataFrame:
    """K x K form: predictions that are no real class (such as -1 for rejected) are dropped."""
    classes = counts.select(F.col("real").alias("pred")).distinct()
    return counts.join(classes, "pred", "left_semi").select("real", "pred", "n")


def confusion_matrix(counts: DataFrame, classes: list) -> DataFrame:
    """Wide report form for a given, bounded list of classes."""
    return counts.groupBy("real").pivot("pred", classes).agg(F.sum("n")).na.fill(0)


def _marginals(counts: DataFrame) -> DataFrame:
    """(class, tp, row_n, col_n) from one pass over the counts."""
    real_key = F.struct(F.col("real").alias("class"), F.when(F.col("real") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                        F.col("n").alias("row_n"), F.lit(0).cast("long").alias("col_n"))
    pred_key = F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"),
                        F.lit(0).cast("long").alias("row_n"), F.col("n").alias("col_n"))
    both = counts.select(F.explode(F.array(real_key, pred_key)).alias("m")).select("m.*")
    return both.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("row_n").alias("row_n"), F.sum("col_n").alias("col_n"))


def _ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    return F.when(b > 0, a * scale / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, p * r * 2.0 / (p + r)).otherwise(0.0)


def per_class_metrics(counts: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support), percent; zero denominators give 0."""
    m = _marginals(counts)
    p, r = _ratio(F.col("tp"), F.col("col_n"), 100.0), _ratio(F.col("tp"), F.col("row_n"), 100.0)
    return m.select(
        "class", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), F.col("row_n").alias("support")
    )


def summary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy; macro, weighted and micro precision, recall and F1; balanced accuracy; percent."""
    m = _marginals(counts)
    p, r = _ratio(F.col("tp"), F.col("col_n")), _ratio(F.col("tp"), F.col("row_n"))
    scored = m.select("tp", "row_n", "col_n", p.alias("p"), r.alias("r"), _f1(p, r).alias("f"))
    macro = lambda c: (F.avg(c) * 100.0)
    weighted = lambda c: _ratio(F.sum(F.col(c) * F.col("row_n")), F.sum("row_n"), 100.0)
    sums = scored.agg(
        F.sum("tp").alias("tp"), F.sum("row_n").alias("rows_all"), F.sum("col_n").alias("cols_all"),
        macro("p").alias("precision_macro"), macro("r").alias("recall_macro"), macro("f").alias("f1_macro"),
        weighted("p").alias("precision_weighted"), weighted("r").alias("recall_weighted"),
        weighted("f").alias("f1_weighted"),
    )
    pm, rm = _ratio(F.col("tp"), F.col("cols_all"), 100.0), _ratio(F.col("tp"), F.col("rows_all"), 100.0)
    return sums.select(
        rm.alias("accuracy"), F.col("recall_macro").alias("balanced_accuracy"), "precision_macro",
        "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted",
        pm.alias("precision_micro"), rm.alias("recall_micro"), _f1(pm, rm).alias("f1_micro"),
    )


def mcc_multiclass(counts: DataFrame) -> DataFrame:
    """Multiclass Matthews correlation x 100; 0 when a denominator is not positive."""
    m = _marginals(counts).select(*[F.col(c).cast("double") for c in ("tp", "row_n", "col_n")])
    s = m.agg(
        F.sum("tp").alias("tr"), F.sum("row_n").alias("n"), F.sum(F.col("row_n") * F.col("col_n")).alias("rc"),
        F.sum(F.col("row_n") * F.col("row_n")).alias("rr"), F.sum(F.col("col_n") * F.col("col_n")).alias("cc"),
    )
    n2 = F.col("n") * F.col("n")
    left, right = n2 - F.col("cc"), n2 - F.col("rr")
    top = F.col("tr") * F.col("n") - F.col("rc")
    return s.select(
        F.when((left > 0) & (right > 0), top * 100.0 / F.sqrt(left * right)).otherwise(0.0).alias("mcc")
    )


def binary_columns(df: DataFrame) -> DataFrame:
    """Adds the binary metrics to rows holding tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    p, r = _ratio(tp, tp + fp, 100.0), _ratio(tp, tp + fn, 100.0)
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return df.select(
        "*", _ratio(tp + tn, tp + tn + fp + fn, 100.0).alias("accuracy"), p.alias("precision"), r.alias("recall"),
        _ratio(tn, tn + fp, 100.0).alias("specificity"), _f1(p, r).alias("f1"),
        F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(0.0).alias("mcc"),
        _ratio(fp, tn + fp, 100.0).alias("fpr"), _ratio(fn, tp + fn, 100.0).alias("fnr"),
    )


def binary_counts(pairs: DataFrame, real: Column, pred: Column) -> DataFrame:
    """One row tp, tn, fp, fn of a two-class problem."""
    return pairs.agg(
        F.count_if(real & pred).alias("tp"), F.count_if(~real & ~pred).alias("tn"),
        F.count_if(~real & pred).alias("fp"), F.count_if(real & ~pred).alias("fn"),
    )


def binary_metrics(counts: DataFrame) -> DataFrame:
    """One-vs-rest metrics of every class at once."""
    total = counts.agg(F.sum("n")).scalar()
    tp, row_n, col_n = F.col("tp"), F.col("row_n"), F.col("col_n")
    m = _marginals(counts).select(
        "class", tp, (total - row_n - col_n + tp).alias("tn"), (col_n - tp).alias("fp"), (row_n - tp).alias("fn")
    )
    return binary_columns(m)


def macro_stats(counts: DataFrame) -> DataFrame:
    """Class averages of the one-vs-rest metrics, and correct / wrong totals."""
    per_class = binary_metrics(counts)
    names = ("accuracy", "precision", "recall", "f1", "specificity", "mcc")
    return per_class.agg(
        *[F.avg(c).alias(f"{c}_avg") for c in names], F.sum("tp").alias("correct"), F.sum("fn").alias("wrong"),
        F.sum(F.col("tp") + F.col("fn")).alias("total"),
    )


def error_pairs(counts: DataFrame) -> DataFrame:
    return counts.filter(F.col("real") != F.col("pred"))


def class_error_rate(counts: DataFrame) -> DataFrame:
    """(class, errors, total, error_rate, accuracy), percent."""
    wrong = F.when(F.col("real") != F.col("pred"), F.col("n")).otherwise(0)
    s = counts.groupBy(F.col("real").alias("class")).agg(F.sum(wrong).alias("errors"), F.sum("n").alias("total"))
    rate = F.col("errors") * 100.0 / F.col("total")
    return s.select("class", "errors", "total", rate.alias("error_rate"), (F.lit(100.0) - rate).alias("accuracy"))


def explained_variance(eigenvalues: DataFrame, k: int) -> DataFrame:
    """Share of the k largest values in the sum of all; 0 when the sum is not positive.

    ``eigenvalues`` holds (comp, value); the k first components are the largest.
    """
    s = eigenvalues.agg(
        F.sum(F.when(F.col("comp") < k, F.col("value")).otherwise(0.0)).alias("top"), F.sum("value").alias("all")
    )
    return s.select(F.when(F.col("all") > 0, F.col("top") / F.col("all")).otherwise(0.0).alias("explained"))


PHASE_LOG = T.StructType([
    T.StructField("nombre", T.StringType()), T.StructField("fase", T.StringType()),
    T.StructField("tiempo_s", T.StringType()), T.StructField("cpu_s", T.StringType()),
    T.StructField("cpu_pct", T.StringType()), T.StructField("ram_max_kb", T.StringType()),
])


def consolidate_phases(log: DataFrame) -> DataFrame:
    """Per phase: longest time, total cpu, cpu percent of that time, largest memory. Unparsable rows are skipped."""
    t, c, ram = (F.col(x).try_cast(k) for x, k in (("tiempo_s", "double"), ("cpu_s", "double"), ("ram_max_kb", "long")))
    rows = log.select(F.col("fase"), t.alias("t"), c.alias("c"), ram.alias("ram")).dropna()
    s = rows.groupBy("fase").agg(F.max("t").alias("tiempo_s"), F.sum("c").alias("cpu_s"), F.max("ram").alias("ram_max_kb"))
    pct = F.when(F.col("tiempo_s") > 0, F.col("cpu_s") * 100.0 / F.col("tiempo_s")).otherwise(0.0)
    return s.select("fase", "tiempo_s", "cpu_s", pct.alias("cpu_pct"), "ram_max_kb").orderBy("fase")


def latency_stats(df: DataFrame, by: list[str], ms: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"),
                               F.sum(ms).alias("total_ms"))


def latency_percentiles(df: DataFrame, by: list[str], ms: str, percents: tuple[int, ...] = (50, 90, 95, 99)) -> DataFrame:
    """(by..., p50_ms, p90_ms, ...): exact interpolated percentiles, without a group in one task."""
    found = exact.quantiles(df, by, ms, [p / 100 for p in percents])
    at = lambda p: F.max(F.when(F.abs(F.col("share") - p / 100) < 1e-9, F.col("value"))).alias(f"p{p}_ms")
    return found.groupBy(*by).agg(*[at(p) for p in percents])


def learning_curve_summary(runs: DataFrame, by: str = "classes",
                           measures: tuple[str, ...] = ("accuracy", "f1", "balanced", "mcc")) -> DataFrame:
    """Mean and sample sd of each measure per class count."""
    aggs = [f(c).alias(f"{c}_{n}") for c in measures for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))]
    return runs.groupBy(by).agg(F.count("*").alias("runs"), *aggs)


def robustness_report(rows: DataFrame, condition: str = "condition") -> DataFrame:
    """Accuracy, mean margin and quality pass rate per perturbation condition."""
    share = lambda c: F.avg(F.col(c).cast("double")) * 100.0
    return rows.groupBy(condition).agg(
        F.count("*").alias("n"), share("ok").alias("accuracy"), F.avg("margin").alias("mean_margin"),
        share("qc_pass").alias("qc_pass_pct"),
    )
