"""Value profiles, quality gates and model audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.functions.rules import collapse_flag

# Value levels, report bands and gate limits.
LOW_LEVEL, HIGH_LEVEL = 10, 245
FULL_SCALE = 255.0
SSIM_C1, SSIM_C2 = 6.5025, 58.5225
MASK_LEVEL = 127
PSNR_CAP, PSNR_SAME = 100.0, 1e-10
UNTRAINED_BIAS, UNTRAINED_EPS = -3.891820, 1e-6
BIAS_LOW, BIAS_NEAR_ZERO = -3.0, 0.5
NORM_LOW, NORM_HIGH = 0.05, 0.5
CONTRAST_GAIN_PCT = 5.0
RMS_AFTER_ENHANCE, RMS_AFTER_SMOOTH = 30.0, 25.0
MICHELSON_MIN = 0.70
VARIANCE_DROP = 10.0
ENTROPY_KEPT = 0.90
MIN_SAMPLES, EXACT_ITEMS = 6, 5


@dataclass(frozen=True)
class GateLimits:
    """Limits of :func:`quality_gate`; the defaults are recorded P5 / P95 values."""

    mean_min: float = 49.314
    mean_max: float = 90.156
    sd_min: float = 23.294
    min_min: float = 10
    max_max: float = 245
    low_pct_max: float = 28.481
    high_pct_max: float = 0.001


def value_profile(
    df: DataFrame, by: list[str], x: str, low: float = LOW_LEVEL, high: float = HIGH_LEVEL,
    mask: Column | None = None,
) -> DataFrame:
    """Mean, sd, extremes, low / high shares and contrast of the values of each group.

    With ``mask`` only masked values count; a group without any gets the empty-region defaults. All
    measures are partial aggregates, so a hot group costs one row per task in the shuffle.
    """
    value = F.col(x).cast("double")
    v = value if mask is None else F.when(mask, value)
    n = F.count(v)
    share = lambda test: F.when(n > 0, F.count_if(test) * 100.0 / n)
    stats = df.groupBy(*by).agg(
        n.alias("n"), F.avg(v).alias("mean_x"), F.stddev_pop(v).alias("sd_x"), F.min(v).alias("min_x"),
        F.max(v).alias("max_x"), share(v <= low).alias("low_pct"), share(v >= high).alias("high_pct"),
    )
    empty = {"mean_x": 0.0, "sd_x": 0.0, "min_x": 0.0, "max_x": 0.0, "low_pct": 100.0, "high_pct": 0.0}
    stats = stats.na.fill(empty)
    spread, total = F.col("max_x") - F.col("min_x"), F.col("max_x") + F.col("min_x")
    return stats.select(
        "*", F.col("sd_x").alias("rms_contrast"), F.when(total > 0, spread / total).otherwise(0.0).alias("michelson"),
        spread.alias("dynamic_range"),
    )


def entropy(df: DataFrame, by: list[str], bin_column: str) -> DataFrame:
    """Shannon entropy (bits) of the value histogram per group: counts first, then one row per bin."""
    counts = df.groupBy(*by, bin_column).agg(F.count("*").alias("c"))
    c = F.col("c").cast("double")
    s = counts.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(c * F.log2(c)).alias("clogc"))
    return s.select(*by, "n", (F.log2(F.col("n")) - F.col("clogc") / F.col("n")).alias("entropy"))


def pair_fidelity(reference: DataFrame, result: DataFrame, by: list[str], idx: str, x: str) -> DataFrame:
    """Two aligned series per key: MSE, SNR, PSNR (uncapped and capped), global SSIM, IoU, density."""
    left = reference.select(*by, idx, F.col(x).cast("double").alias("a"))
    right = result.select(*by, idx, F.col(x).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    both = left.join(right, [*by, idx])
    s = both.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("aa"),
        F.avg(b * b).alias("bb"), F.avg(a * b).alias("ab"), F.sum((a - b) * (a - b)).alias("err"),
        F.sum(a * a).alias("power"),
        F.count_if((a > MASK_LEVEL) & (b > MASK_LEVEL)).alias("inter"),
        F.count_if((a > MASK_LEVEL) | (b > MASK_LEVEL)).alias("uni"), F.count_if(b > 0).alias("active"),
    )
    mse = F.col("err") / F.col("n")
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, cov = F.col("aa") - ma * ma, F.col("bb") - mb * mb, F.col("ab") - ma * mb
    ssim = ((ma * mb * 2 + SSIM_C1) * (cov * 2 + SSIM_C2)) / ((ma * ma + mb * mb + SSIM_C1) * (va + vb + SSIM_C2))
    psnr = F.log10(F.lit(FULL_SCALE * FULL_SCALE) / mse) * 10.0
    infinite = F.lit(float("inf"))
    return s.select(
        *by, "n", mse.alias("mse"),
        F.when(F.col("err") == 0, infinite).otherwise(F.log10(F.col("power") / F.col("err")) * 10.0).alias("snr"),
        F.when(mse == 0, infinite).otherwise(psnr).alias("psnr"),
        F.when(mse < PSNR_SAME, PSNR_CAP).otherwise(psnr).alias("psnr_capped"), ssim.alias("ssim"),
        F.when(F.col("uni") == 0, 1.0).otherwise(F.col("inter") / F.col("uni")).alias("iou"),
        (F.col("active") / F.col("n")).alias("density"),
    )


def quality_gate(profile: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """Adds ``passed`` and ``reason``: the first failing check in a fixed order."""
    reason = (
        F.when((F.col("mean_x") < limits.mean_min) | (F.col("mean_x") > limits.mean_max), "mean_range")
        .when(F.col("sd_x") < limits.sd_min, "low_contrast")
        .when(F.col("min_x") < limits.min_min, "too_dark")
        .when(F.col("max_x") > limits.max_max, "too_bright")
        .when(F.col("low_pct") > limits.low_pct_max, "many_dark")
        .when(F.col("high_pct") > limits.high_pct_max, "many_bright")
    )
    return profile.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def batch_gate(gated: DataFrame, batch: str, min_share: float, enforce: bool) -> DataFrame:
    """Passes per enrolment against a minimum share of its items: ok, warn or reject."""
    s = gated.groupBy(batch).agg(F.count("*").alias("items"), F.count_if("passed").alias("passes"))
    needed = F.ceil(F.col("items") * min_share)
    verdict = F.when(F.col("passes") >= needed, "ok").otherwise("reject" if enforce else "warn")
    return s.select(batch, "items", "passes", needed.alias("needed"), verdict.alias("verdict"))


def enrolment_ready(samples: DataFrame, identity: str, valid: Column, minimum: int = MIN_SAMPLES, exactly: bool = False) -> DataFrame:
    """Valid samples per identity against the number an enrolment needs: (identity, valid, ready)."""
    s = samples.groupBy(identity).agg(F.count_if(valid).alias("valid"))
    return s.withColumn("ready", F.col("valid") == minimum if exactly else F.col("valid") >= minimum)


def stage_effect(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Before / after checks per key. Both sides hold sd_x, entropy, michelson, rms_contrast."""
    names = ("sd_x", "entropy", "michelson", "rms_contrast")
    take = lambda df, p: df.select(*by, *[F.col(c).alias(f"{p}_{c}") for c in names])
    j = take(before, "b").join(take(after, "a"), by)
    gain = F.when(F.col("b_sd_x") > 0, (F.col("a_sd_x") - F.col("b_sd_x")) * 100.0 / F.col("b_sd_x")).otherwise(0.0)
    drop = F.col("b_sd_x") * F.col("b_sd_x") - F.col("a_sd_x") * F.col("a_sd_x")
    kept = F.when(F.col("b_entropy") > 0, F.col("a_entropy") / F.col("b_entropy")).otherwise(0.0)
    j = j.select(
        *by, gain.alias("contrast_gain_pct"), (F.col("a_entropy") - F.col("b_entropy")).alias("entropy_gain"),
        kept.alias("entropy_ratio"), drop.alias("variance_drop"), "a_rms_contrast", "a_michelson",
    )
    return j.select(
        *by, "contrast_gain_pct", "entropy_gain", "entropy_ratio", "variance_drop",
        (F.col("contrast_gain_pct") >= CONTRAST_GAIN_PCT).alias("contrast_ok"),
        (F.col("entropy_gain") > 0).alias("entropy_ok"),
        (F.col("a_michelson") >= MICHELSON_MIN).alias("michelson_ok"),
        ((F.col("a_rms_contrast") >= RMS_AFTER_ENHANCE) & (F.col("entropy_gain") > 0)).alias("enhance_ok"),
        ((F.col("variance_drop") >= VARIANCE_DROP) & (F.col("entropy_ratio") >= ENTROPY_KEPT)
         & (F.col("a_rms_contrast") >= RMS_AFTER_SMOOTH)).alias("smooth_ok"),
    )


def model_audit(model: DataFrame) -> DataFrame:
    """One row of sanity counts over a linear model table (class, w, b)."""
    size = lambda test: F.size(F.filter("w", test))
    per_class = model.select(
        "b", F.sqrt(V.sum_squares(F.col("w"))).alias("norm"), size(F.isnan).alias("nans"),
        size(lambda x: F.abs(x) == float("inf")).alias("infs"), F.forall("w", lambda x: x == 0.0).alias("zero"),
    )
    b = F.col("b")
    return per_class.agg(
        F.count("*").alias("classes"), F.min("b").alias("min_bias"), F.max("b").alias("max_bias"),
        F.count_if(b > 0).alias("bias_positive"), F.count_if(b < BIAS_LOW).alias("bias_low"),
        F.count_if((b <= 0) & (b >= BIAS_LOW) & (F.abs(b) < BIAS_NEAR_ZERO)).alias("bias_near_zero"),
        F.count_if(F.abs(b - UNTRAINED_BIAS) < UNTRAINED_EPS).alias("bias_untrained"),
        F.min("norm").alias("min_norm"), F.max("norm").alias("max_norm"),
        F.count_if(F.col("norm") < NORM_LOW).alias("norm_low"), F.count_if(F.col("norm") > NORM_HIGH).alias("norm_high"),
        F.count_if((F.col("nans") > 0) | (F.col("infs") > 0)).alias("invalid_weights"),
        F.count_if("zero").alias("zero_weights"),
    )


def bias_stats(model: DataFrame) -> DataFrame:
    return model.agg(F.avg("b").alias("mean_b"), F.min("b").alias("min_b"), F.max("b").alias("max_b"),
                     F.stddev_pop("b").alias("sd_b"))


def collapsed_classes(binary: DataFrame) -> DataFrame:
    """One-vs-rest metric rows with a flag for classes that accept everything."""
    return binary.withColumn("collapsed", collapse_flag(F.col("recall"), F.col("specificity")))


def robust_bounds(quantile_rows: DataFrame, by: list[str]) -> DataFrame:
    """P5, median and P95 columns from exact quantile rows."""
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    aggs = [at(0.05).alias("p5"), at(0.5).alias("median"), at(0.95).alias("p95")]
    return quantile_rows.groupBy(*by).agg(*aggs) if by else quantile_rows.agg(*aggs)
