"""Seeded variants of vector rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.functions.draws import gaussian, uniform
from idmatch.functions.signal import soft_clip
from idmatch.functions.vectors import let

# Perturbation strengths.
NOISE_SD, SOFT_NOISE = 0.05, 0.7
VOLUME = (0.70, 1.30)
SPEED = (0.85, 1.15)
MAX_VARIANTS = 10
KINDS = ("noise", "noise", "volume", "noise_volume", "speed")  # by variant number modulo 5


def _between(limits: tuple[float, float], draw: Column) -> Column:
    return draw * (limits[1] - limits[0]) + limits[0]


def _noisy(v: Column, key: Column, sd: float, seed: int) -> Column:
    element = lambda i: F.concat_ws(":", key, i.cast("string"))
    return F.transform(v, lambda x, i: soft_clip(x + gaussian(element(i), f"{seed}:n") * sd))


def _scaled(v: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(v, lambda x: soft_clip(x * f)))


def _stretched(v: Column, factor: Column) -> Column:
    def at_factor(f: Column) -> Column:
        points = F.greatest(F.lit(1), F.floor(F.size(v) / f).cast("int"))

        def point(i: Column) -> Column:
            pos = i * f
            low = F.floor(pos).cast("int")
            part = pos - low
            here, after = F.get(v, low), F.get(v, low + 1)
            return soft_clip(F.when(after.isNull(), F.coalesce(here, F.lit(0.0))).otherwise(here * (1.0 - part) + after * part))

        return F.transform(F.sequence(F.lit(0), points - 1), point)

    return let(factor, at_factor)


def augment(df: DataFrame, n: int, key: str = "sample_id", v: str = "v", seed: int = 42) -> DataFrame:
    """The original row (variant 0) and ``n`` seeded variants: (..., variant, kind, v).

    Draws depend on row key, variant and position only; no state is shared between rows.
    """
    if not 0 <= n <= MAX_VARIANTS:
        raise ValueError(f"0..{MAX_VARIANTS} variants")
    rows = df.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n))))
    vec, draw_key = F.col(v), F.concat_ws(":", F.col(key).cast("string"), F.col("variant").cast("string"))
    kind = F.when(F.col("variant") == 0, "original")
    for i, name in enumerate(KINDS):
        kind = kind.when(F.col("variant") % 5 == i, name)
    rows = rows.withColumn("kind", kind)
    volume = _between(VOLUME, uniform(draw_key, f"{seed}:f"))
    speed = _between(SPEED, uniform(draw_key, f"{seed}:f"))
    changed = (
        F.when(F.col("kind") == "original", vec)
        .when(F.col("kind") == "noise", _noisy(vec, draw_key, NOISE_SD, seed))
        .when(F.col("kind") == "volume", _scaled(vec, volume))
        .when(F.col("kind") == "noise_volume", _scaled(_noisy(vec, draw_key, NOISE_SD * SOFT_NOISE, seed), volume))
        .otherwise(_stretched(vec, speed))
    )
    return rows.withColumn(v, changed)
