"""Ordered-sample series in long form (series_id, idx, x), idx dense from 0.

No operator sorts or holds a whole series in one task: neighbours come from position runs with a halo,
running totals from per-run totals, per-series measures from partial aggregates, and per-frame work from
groups of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idmatch.functions.signal import soft_clip
from idmatch.operators import exact
from idmatch.session import durable

# Levels, floors and gate limits.
CLIP_LEVEL = 0.99
ZERO_LEVEL = 1e-12
SILENT = 1e-12
RMS_TARGET, PEAK_TARGET = 0.1, 0.95
GAIN_FLOOR, GAIN_MAX, WEIGHT_FLOOR = 1e-4, 10.0, 1e-6
ENTROPY_BINS, ENERGY_FLOOR = 8, 1e-12
MIN_SECONDS, MIN_RMS, MAX_CLIP_PCT = 3.5, 0.005, 5.0
MIN_RATE, MAX_RATE, MAX_CHANNELS, MIN_SAMPLES, MAX_SECONDS = 8000, 48000, 2, 1000, 300


@dataclass(frozen=True)
class Activity:
    """Sizes in samples and thresholds of :func:`activity_segments`."""

    frame: int
    stride: int
    padding: int
    min_length: int
    merge_gap: int
    energy_floor: float = 0.0005

    @classmethod
    def at_rate(cls, rate: int) -> "Activity":
        """25 ms frames every 10 ms, 150 ms padding, 100 ms minimum, 250 ms merge gap."""
        ms = lambda t: t * rate // 1000
        return cls(max(1, ms(25)), max(1, ms(10)), ms(150), max(1, ms(100)), ms(250))


def from_events(df: DataFrame, series: str, ts: str, tie: str, x: str) -> DataFrame:
    """(series_id, idx, x) from timestamped rows."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = df.select(F.col(series).alias("series_id"), micros.alias("t"), F.col(tie).alias("k"), F.col(x).alias("x"))
    return exact.row_index(timed, ["series_id"], "t", "k").select("series_id", "idx", F.col("x").cast("double"))


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("series_id").agg(F.count("*").alias("n"))


def series_profile(df: DataFrame) -> DataFrame:
    """Mean, population sd, min, max, mean first difference.

    The differences of a dense series add up to last minus first, so no look-back is needed.
    """
    n = F.count("*")
    delta = (F.max_by("x", "idx") - F.min_by("x", "idx")) / (n - 1)
    return df.groupBy("series_id").agg(
        n.alias("n"), F.avg("x").alias("mean_x"), F.stddev_pop("x").alias("sd_x"), F.min("x").alias("min_x"),
        F.max("x").alias("max_x"), F.when(n > 1, delta).otherwise(0.0).alias("delta"),
    )


def series_levels(df: DataFrame) -> DataFrame:
    """RMS, mean abs, peak, min, max, sd, clipped and zero percent."""
    x, size = F.col("x"), F.abs("x")
    pct = lambda test: F.count_if(test) * 100.0 / F.count("*")
    return df.groupBy("series_id").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(x * x)).alias("rms"), F.avg(size).alias("mean_abs"),
        F.max(size).alias("peak"), F.min(x).alias("min_x"), F.max(x).alias("max_x"),
        F.stddev_pop(x).alias("sd_x"), pct(size >= CLIP_LEVEL).alias("clip_pct"),
        pct(size < ZERO_LEVEL).alias("zero_pct"),
    )


def first_difference(df: DataFrame) -> DataFrame:
    """x[t] - x[t-1]; no row for the first sample."""
    d = exact.with_previous(df, "series_id", "idx", "x", "__p")
    return d.filter(F.col("__p").isNotNull()).select("series_id", "idx", (F.col("x") - F.col("__p")).alias("dx"))


def downmix(df: DataFrame, channels: int) -> DataFrame:
    """Mean over interleaved channels; an incomplete last frame is dropped."""
    mono = df.groupBy("series_id", F.floor(F.col("idx") / channels).alias("idx")).agg(
        F.avg("x").alias("x"), F.count("*").alias("__c")
    )
    return mono.filter(F.col("__c") == channels).drop("__c")


def _by_series(df: DataFrame, gain: DataFrame) -> DataFrame:
    return df.join(gain, "series_id")


def rms_normalize(df: DataFrame, target: float = RMS_TARGET) -> DataFrame:
    """x * target / RMS with soft clip; silence unchanged. A bad target falls back to the default."""
    target = target if 0.0 < target <= 1.0 else RMS_TARGET
    level = df.groupBy("series_id").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("__l"))
    scaled = soft_clip(F.col("x") * (F.lit(target) / F.col("__l")))
    y = F.when(F.col("__l") < SILENT, F.col("x")).otherwise(scaled)
    return _by_series(df, level).select("series_id", "idx", y.alias("x"))


def peak_normalize(df: DataFrame, target: float = PEAK_TARGET) -> DataFrame:
    """x * target / peak; silence unchanged."""
    target = target if 0.0 < target <= 1.0 else PEAK_TARGET
    level = df.groupBy("series_id").agg(F.max(F.abs("x")).alias("__l"))
    y = F.when(F.col("__l") < SILENT, F.col("x")).otherwise(F.col("x") * (F.lit(target) / F.col("__l")))
    return _by_series(df, level).select("series_id", "idx", y.alias("x"))


def _in_frames(df: DataFrame, size: int, stride: int) -> DataFrame:
    """One row per (sample, frame that covers it)."""
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / stride)).cast("long")
    last = F.floor(F.col("idx") / stride)
    covered = F.when(last >= first, F.sequence(first, last))
    return df.withColumn("frame", F.explode(covered)).withColumn("j", F.col("idx") - F.col("frame") * stride)


def frames(df: DataFrame, size: int, stride: int) -> DataFrame:
    """Complete overlapping frames: (series_id, frame, energy, zcr, entropy).

    A frame is complete when it holds ``size`` samples, so series lengths need not be joined.
    """
    sample = exact.with_previous(df, "series_id", "idx", "x", "__p")
    x, p = F.col("x"), F.col("__p")
    crossed = F.coalesce(((x >= 0) & (p < 0)) | ((x < 0) & (p >= 0)), F.lit(False))
    rows = _in_frames(sample.withColumn("__c", crossed).drop("__p"), size, stride)
    width = max(1, size // ENTROPY_BINS)
    bin_of = F.least(F.lit(ENTROPY_BINS - 1), F.floor(F.col("j") / width))
    power = x * x
    bins = [F.sum(F.when(bin_of == b, power).otherwise(0.0)).alias(f"__b{b}") for b in range(ENTROPY_BINS)]
    s = rows.groupBy("series_id", "frame").agg(
        F.count("*").alias("__n"), F.sum(power).alias("__e"),
        F.count_if(F.col("__c") & (F.col("j") > 0)).alias("__z"), *bins,
    ).filter(F.col("__n") == size)
    total = F.greatest(sum((F.col(f"__b{b}") for b in range(1, ENTROPY_BINS)), F.col("__b0")), F.lit(ENERGY_FLOOR))
    term = lambda b: F.when(F.col(f"__b{b}") > 0, -(F.col(f"__b{b}") / F.col("__t")) * F.log2(F.col(f"__b{b}") / F.col("__t"))).otherwise(0.0)
    h = sum((term(b) for b in range(1, ENTROPY_BINS)), term(0)) / math.log2(ENTROPY_BINS)
    zcr = F.col("__z") / float(size - 1) if size > 1 else F.lit(0.0)
    return s.withColumn("__t", total).select(
        "series_id", "frame", F.sqrt(F.col("__e") / float(size)).alias("energy"), zcr.alias("zcr"), h.alias("entropy")
    )


def active_frames(framed: DataFrame, cfg: Activity) -> DataFrame:
    """Adaptive thresholds per series, one flag per frame, then 1- and 2-frame holes filled."""
    median = exact.quantiles(framed, ["series_id"], "energy", [0.5]).select(
        "series_id", F.col("value").alias("__med")
    )
    level = framed.groupBy("series_id").agg(
        F.avg("energy").alias("__me"), F.avg("zcr").alias("__mz"), F.avg("entropy").alias("__mh"),
        F.count("*").alias("__frames"),
    ).join(median, "series_id")
    e = F.greatest(F.lit(cfg.energy_floor), F.col("__med") * 0.75, F.col("__me") * 0.6)
    z = F.greatest(F.lit(0.02), F.col("__mz") * 0.9)
    h = F.greatest(F.lit(0.05), F.col("__mh") * 0.95)
    level = level.select("series_id", "__frames", e.alias("__te"), z.alias("__tz"), h.alias("__th"))
    energy, zcr, ent = F.col("energy"), F.col("zcr"), F.col("entropy")
    te, tz, th = F.col("__te"), F.col("__tz"), F.col("__th")
    loud = (energy >= te) & ((zcr <= tz * 1.15) | (ent <= th * 1.1))
    soft = (energy >= te * 0.5) & (zcr <= tz * 0.9) & (ent <= th)
    flagged = framed.join(level, "series_id").select("series_id", "frame", "__frames", (loud | soft).alias("v"))

    spread, w = exact.neighbourhood(flagged, "series_id", "frame", 3, 3)
    at = lambda column, k: F.coalesce(exact.neighbour(w, "frame", column, k), F.lit(False))
    one = spread.withColumn("s", F.col("v") | (at("v", -1) & at("v", 1)))
    # A 2-frame hole directly before the last frame stays open.
    inner = lambda k: F.col("frame") + k < F.col("__frames") - 2
    second = ~at("s", -1) & at("s", -2) & at("s", 1) & inner(0)
    first = ~at("s", 1) & at("s", -1) & at("s", 2) & inner(1)
    two = one.withColumn("active", F.col("s") | (~F.col("s") & (second | first)))
    return exact.own_rows(two).select("series_id", "frame", "active")


def activity_segments(df: DataFrame, cfg: Activity) -> DataFrame:
    """Kept segments [start, stop) in samples: (series_id, segment, start, stop).

    A series shorter than a frame, or without any segment, is kept whole. Frames, flags and islands are
    each read more than once, so they are written instead of being derived again from the samples.
    """
    flags = active_frames(durable(frames(df, cfg.frame, cfg.stride)), cfg)
    on = exact.with_previous(flags, "series_id", "frame", "active", "__p").withColumn(
        "__start", (F.col("active") & ~F.coalesce(F.col("__p"), F.lit(False))).cast("int")
    )
    on = durable(on)
    islands = durable(
        exact.running_sum(on, "series_id", "frame", "__start", "island").filter("active")
        .groupBy("series_id", "island").agg(F.min("frame").alias("f0"), (F.max("frame") + 1).alias("f1"))
    )
    lengths = sizes(df)
    start = F.greatest(F.lit(0), F.col("f0") * cfg.stride - cfg.padding)
    stop = F.least(F.col("n"), F.col("f1") * cfg.stride + cfg.frame + cfg.padding)
    padded = islands.join(lengths, "series_id").select("series_id", "island", start.alias("start"), stop.alias("stop"))
    long = padded.withColumn("__keep", ((F.col("stop") - F.col("start")) >= cfg.min_length).cast("int"))
    kept = durable(exact.running_sum(long, "series_id", "island", "__keep", "pos").filter("__keep = 1"))
    linked = exact.with_previous(kept, "series_id", "pos", "stop", "__prev").withColumn(
        "__new", F.when((F.col("start") - F.col("__prev")) <= cfg.merge_gap, 0).otherwise(1)
    )
    merged = (
        exact.running_sum(linked, "series_id", "pos", "__new", "segment")
        .groupBy("series_id", "segment").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    )
    whole = lengths.join(merged.select("series_id").distinct(), "series_id", "left_anti").select(
        "series_id", F.lit(1).cast("long").alias("segment"), F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")
    )
    return merged.select("series_id", "segment", "start", "stop").unionByName(whole)


def retention(segments: DataFrame, df: DataFrame) -> DataFrame:
    """Kept samples and percent per series."""
    kept = segments.groupBy("series_id").agg(
        F.count("*").alias("segments"), F.sum(F.col("stop") - F.col("start")).alias("kept")
    )
    return kept.join(sizes(df), "series_id").select(
        "series_id", "segments", "kept", "n", (F.col("kept") * 100.0 / F.col("n")).alias("retention_pct")
    )


def rolling_gain(df: DataFrame, window: int, target: float = RMS_TARGET) -> DataFrame:
    """Half-overlapping windows, a bounded gain each, blended by a Hann weight and clamped to [-1, 1].

    A series shorter than the window is normalised as a whole.
    """
    hop = window // 2
    if window <= 1 or hop == 0:
        return rms_normalize(df, target)
    rows = _in_frames(df, window, hop)
    w = W.partitionBy("series_id", "frame")
    complete = F.count("*").over(w) == window
    level = F.sqrt(F.avg(F.col("x") * F.col("x")).over(w))
    gain = F.when(level > GAIN_FLOOR, F.least(F.lit(target) / level, F.lit(GAIN_MAX))).otherwise(1.0)
    hann = (1.0 - F.cos(F.col("j") * (2.0 * math.pi) / float(window - 1))) * 0.5
    weighted = rows.select("series_id", "idx", "x", F.when(complete, hann).otherwise(0.0).alias("h"), gain.alias("g"))
    out = weighted.groupBy("series_id", "idx").agg(
        F.first("x").alias("x"), F.sum(F.col("x") * F.col("g") * F.col("h")).alias("num"), F.sum("h").alias("den")
    )
    blended = F.when(F.col("den") > WEIGHT_FLOOR, F.col("num") / F.col("den")).otherwise(F.col("x"))
    clamped = F.greatest(F.least(blended, F.lit(1.0)), F.lit(-1.0))
    short = sizes(df).filter(F.col("n") < window).select("series_id")
    long_part = out.select("series_id", "idx", clamped.alias("x")).join(short, "series_id", "left_anti")
    return long_part.unionByName(rms_normalize(df.join(short, "series_id", "left_semi"), target))


def resample_linear(df: DataFrame, factor: float) -> DataFrame:
    """n / factor points at position i * factor, linearly interpolated; the last sample is held."""
    if factor <= 0:
        raise ValueError("factor must be positive")
    spread, w = exact.neighbourhood(df, "series_id", "idx", 0, 1)
    paired = exact.own_rows(spread.withColumn("__next", exact.neighbour(w, "idx", "x", 1)))
    lo = F.greatest(F.lit(0), F.floor(F.col("idx") / factor) - 1)
    near = F.sequence(lo, F.ceil((F.col("idx") + 1) / factor) + 1)
    mine = F.filter(near, lambda i: F.floor(i.cast("double") * factor) == F.col("idx"))
    rows = paired.select("series_id", "idx", "x", "__next", F.explode(mine).alias("i"))
    part = F.col("i") * F.lit(float(factor)) - F.col("idx")
    y = F.when(F.col("__next").isNull(), F.col("x")).otherwise(F.col("x") * (1.0 - part) + F.col("__next") * part)
    points = F.greatest(F.lit(1), F.floor(F.col("n") / factor))
    return rows.join(sizes(df), "series_id").filter(F.col("i") < points).select(
        "series_id", F.col("i").alias("idx"), soft_clip(y).alias("x")
    )


def series_gate(levels: DataFrame, rate: int, channels: int = 1) -> DataFrame:
    """First failing check of sampling parameters and levels: (series_id, ..., reason, passed)."""
    seconds = F.col("n") / float(rate * channels)
    reason = (
        F.when(F.lit(not MIN_RATE <= rate <= MAX_RATE), "sample_rate")
        .when(F.lit(not 1 <= channels <= MAX_CHANNELS), "channels")
        .when(F.col("n") < MIN_SAMPLES, "few_samples")
        .when(F.floor(seconds) > MAX_SECONDS, "too_long")
        .when(seconds < MIN_SECONDS, "too_short")
        .when(F.col("rms") < MIN_RMS, "too_quiet")
        .when(F.col("clip_pct") > MAX_CLIP_PCT, "clipped")
    )
    return levels.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())
