"""Verification curves and thresholds.

A curve over n thresholds never compares every score with every threshold: each score is placed in its
step once, steps are counted with a map-side combined aggregate, and a running sum over the n + 1 counted
steps gives all error rates. Edges are exact because a candidate step is corrected against the threshold
expression itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idmatch.operators.rows import beside

# Grid sizes, sentinel rates and grade bands.
MIN_STEPS = 200
STEPS = 1000
MAX_STEPS = 100_000
SENTINEL = 100.0
ROC_WIDEN = 0.05
FLAT_RANGE = 1e-10
FAR_TARGETS = (1.0, 5.0, 10.0)
EER_GRADES = ((1.0, "excellent"), (5.0, "good"), (10.0, "fair"))
AUC_GRADES = ((0.95, "excellent"), (0.85, "good"), (0.70, "moderate"))


def _steps(n: int) -> int:
    if n > MAX_STEPS:
        raise ValueError(f"at most {MAX_STEPS} thresholds")
    return n


def _even(lo: Column, hi: Column, n: int, i: Column) -> Column:
    return lo + (hi - lo) * i / float(n)


def _strided(lo: Column, hi: Column, n: int, i: Column) -> Column:
    return lo + i * ((hi - lo) / float(n))


def place_scores(scores: DataFrame, lo: Column, hi: Column, n: int, edge=_even) -> DataFrame:
    """Counts per step: (step, genuine, impostor); step i holds scores in [threshold i, threshold i+1).

    Step -1 holds scores below the first threshold.
    """
    s = F.col("score")
    flat = hi <= lo
    guess = F.floor((s - lo) / (hi - lo) * n).cast("long")
    guess = F.when(flat, F.lit(0)).otherwise(F.least(F.greatest(guess, F.lit(0)), F.lit(n)))
    guessed = scores.filter(s.isNotNull() & ~F.isnan(s)).select(
        s, F.col("genuine"), lo.alias("__lo"), hi.alias("__hi"), guess.alias("__g")
    )
    g = F.col("__g")
    at = lambda i: edge(F.col("__lo"), F.col("__hi"), n, i.cast("double"))
    step = F.when(s < at(g), g - 1).when((g < n) & (s >= at(g + 1)), g + 1).otherwise(g)
    return guessed.groupBy(step.alias("step")).agg(
        F.count_if("genuine").alias("genuine"), F.count_if(~F.col("genuine")).alias("impostor")
    )


def curve_from_counts(counts: DataFrame, lo: Column, hi: Column, n: int, edge=_even) -> DataFrame:
    """(i, threshold, far, frr, gap) in percent from per-step counts. The grid has n + 1 rows."""
    grid = counts.sparkSession.range(-1, n + 1).withColumnRenamed("id", "step")
    filled = grid.join(counts, "step", "left").na.fill(0, ["genuine", "impostor"])
    whole = W.partitionBy(F.lit(0))
    below = whole.orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    sums = filled.select(
        "step",
        F.coalesce(F.sum("genuine").over(below), F.lit(0)).alias("genuine_below"),
        F.coalesce(F.sum("impostor").over(below), F.lit(0)).alias("impostor_below"),
        F.sum("genuine").over(whole).alias("genuine"), F.sum("impostor").over(whole).alias("impostor"),
    ).filter("step >= 0")
    usable = (F.col("genuine") > 0) & (F.col("impostor") > 0)
    far = (F.col("impostor") - F.col("impostor_below")) * 100.0 / F.col("impostor")
    frr = F.col("genuine_below") * 100.0 / F.col("genuine")
    return (
        sums.filter(usable)
        .select(F.col("step").alias("i"), edge(lo, hi, n, F.col("step").cast("double")).alias("threshold"),
                far.alias("far"), frr.alias("frr"))
        .withColumn("gap", F.abs(F.col("far") - F.col("frr")))
    )


def finite_scores(scores: DataFrame) -> DataFrame:
    """The rows whose score is a finite number; no others count in a range or a rate."""
    return scores.filter(F.coalesce(F.abs("score") < float("inf"), F.lit(False)) & ~F.isnan("score"))


def _range(scores: DataFrame) -> tuple[Column, Column, DataFrame]:
    """Least and largest finite score as literals (one pass), and the finite rows."""
    real = finite_scores(scores)
    lo, hi = real.agg(F.min("score").cast("double"), F.max("score").cast("double")).first()
    return F.lit(lo if lo is not None else 0.0), F.lit(hi if hi is not None else 0.0), real


def far_frr_curve(scores: DataFrame, n: int = STEPS) -> DataFrame:
    """Error rates on n + 1 even thresholds over the score range.

    ``scores`` holds (score, genuine). No rows when a side is empty or all scores are equal; :func:`eer`
    turns that into the sentinel.
    """
    n = _steps(max(n, MIN_STEPS))
    lo, hi, scores = _range(scores)
    return curve_from_counts(place_scores(scores, lo, hi, n), lo, hi, n).filter(hi > lo)


def eer(curve: DataFrame) -> DataFrame:
    """First threshold of least |FAR - FRR|: (threshold, far, frr, eer). Sentinel rates on an empty curve."""
    best = F.min_by(F.struct("threshold", "far", "frr"), F.struct("gap", "i")).alias("b")
    at = lambda name, fallback: F.coalesce(F.col(f"b.{name}"), F.lit(fallback)).alias(name)
    return curve.agg(best).select(
        at("threshold", 0.0), at("far", SENTINEL), at("frr", SENTINEL),
        F.coalesce((F.col("b.far") + F.col("b.frr")) / 2.0, F.lit(SENTINEL)).alias("eer"),
    )


def threshold_at_far(curve: DataFrame, targets: tuple[float, ...] = FAR_TARGETS) -> DataFrame:
    """Per FAR target: the point of least FRR among those that meet it (lowest threshold on ties)."""
    wanted = curve.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    best = F.min_by(F.struct("threshold", "far", "frr"), F.struct("frr", "i")).alias("b")
    return (
        wanted.filter(F.col("far") <= F.col("target")).groupBy("target").agg(best)
        .select("target", "b.threshold", "b.far", "b.frr")
    )


def roc_points(scores: DataFrame, n: int = STEPS) -> DataFrame:
    """n thresholds over the range widened by 5 % on each side: (i, threshold, tpr, fpr, far, frr), percent."""
    n = _steps(n)
    raw_lo, raw_hi, scores = _range(scores)
    margin = (raw_hi - raw_lo) * ROC_WIDEN
    lo, hi = raw_lo - margin, raw_hi + margin
    counts = place_scores(scores, lo, hi, n - 1, _strided)
    curve = curve_from_counts(counts, lo, hi, n - 1, _strided).filter((hi - lo) >= FLAT_RANGE)
    return curve.select("i", "threshold", (F.lit(100.0) - F.col("frr")).alias("tpr"),
                        F.col("far").alias("fpr"), "far", "frr")


def _roc_summary(points: DataFrame) -> DataFrame:
    """One row: (auc, eer, threshold_eer, b: the point of least |FAR - FRR|); trapezoids over the points in rising FPR.

    FPR and TPR both fall as the threshold rises, so descending threshold order is rising FPR order.
    """
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("i"))
    base = (F.col("fpr") - F.lag("fpr").over(w)) / 100.0
    height = (F.col("tpr") + F.lag("tpr").over(w)) / 200.0
    gap = F.abs(F.col("far") - F.col("frr"))
    best = F.min_by(F.struct("threshold", "far", "frr"), F.struct(gap, -F.col("i"))).alias("b")
    return points.withColumn("area", base * height).agg(F.sum("area").alias("auc"), best).select(
        "auc", ((F.col("b.far") + F.col("b.frr")) / 2.0).alias("eer"), F.col("b.threshold").alias("threshold_eer"), "b"
    )


def roc_auc(points: DataFrame) -> DataFrame:
    """One row: (auc, eer, threshold_eer)."""
    return _roc_summary(points).drop("b")


def _grade(value: Column, bands, below: bool, last: str) -> Column:
    out = None
    for limit, name in bands:
        test = value < limit if below else value > limit
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(last)


def biometric_summary(scores: DataFrame, n: int = STEPS) -> DataFrame:
    """EER, AUC, the confusion counts at the EER threshold, and quality grades."""
    summary = _roc_summary(roc_points(scores, n))
    sizes = finite_scores(scores).agg(F.count_if("genuine").alias("g"), F.count_if(~F.col("genuine")).alias("m"))
    # the curve's rates are counts over these sizes, so the counts come back exactly
    share = lambda rate, of: F.round(F.col(rate) * F.col(of) / 100.0).cast("long")
    counted = beside(summary, sizes).withColumns({"fp": share("b.far", "m"), "fn": share("b.frr", "g")})
    counts = counted.withColumns({"tp": F.col("g") - F.col("fn"), "tn": F.col("m") - F.col("fp")}).select(
        "auc", "eer", "threshold_eer", "tp", "tn", "fp", "fn")
    return (
        counts.withColumn("far", F.col("fp") * 100.0 / (F.col("fp") + F.col("tn")))
        .withColumn("frr", F.col("fn") * 100.0 / (F.col("tp") + F.col("fn")))
        .withColumn("eer_grade", _grade(F.col("eer"), EER_GRADES, True, "poor"))
        .withColumn("auc_grade", _grade(F.col("auc"), AUC_GRADES, False, "low"))
    )


def score_separation(scores: DataFrame) -> DataFrame:
    """Mean and population sd of genuine and impostor scores."""
    kind = F.when(F.col("genuine"), "genuine").otherwise("impostor").alias("kind")
    return scores.groupBy(kind).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("sd_score")
    )


def publish_threshold(eer_row: DataFrame, scores: DataFrame) -> DataFrame:
    """One-row table (threshold, eer, genuine, impostor) to store beside a model."""
    sizes = scores.agg(F.count_if("genuine").alias("genuine"), F.count_if(~F.col("genuine")).alias("impostor"))
    return beside(eer_row.select("threshold", "eer"), sizes)
