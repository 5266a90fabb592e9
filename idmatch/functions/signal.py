"""Scalar functions over single samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The eight perturbation conditions and their parameters.
CONDITIONS = (
    "base", "bright_p20", "bright_m20", "contrast_1p1", "gamma_0p9", "gamma_1p1", "noise_p10", "noise_m10",
)
BRIGHT_DELTA = 20.0
CONTRAST = 1.1
GAMMAS = {"gamma_0p9": 0.9, "gamma_1p1": 1.1}
NOISE_LEVELS = 11
LEVEL_MAX = 255.0
MIDDLE = 128.0


def soft_clip(x: Column) -> Column:
    """Identity inside [-1, 1], a saturating tail outside."""
    tail = lambda excess: 1.0 - (1.0 - F.tanh(excess * 2.0)) * 0.1
    return F.when(x > 1.0, tail(x - 1.0)).when(x < -1.0, -tail(-x - 1.0)).otherwise(x)


def clamp_level(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(LEVEL_MAX))


def tone_map(x: Column, condition: str, noise: Column | None = None) -> Column:
    """One perturbation condition applied to a 0..255 level; ``noise`` is an integer draw 0..10."""
    if condition == "base":
        changed = x
    elif condition == "bright_p20":
        changed = x + BRIGHT_DELTA
    elif condition == "bright_m20":
        changed = x - BRIGHT_DELTA
    elif condition == "contrast_1p1":
        changed = F.round((x - MIDDLE) * CONTRAST + MIDDLE)
    elif condition in GAMMAS:
        changed = F.round(F.pow(x / LEVEL_MAX, F.lit(GAMMAS[condition])) * LEVEL_MAX)
    elif condition in ("noise_p10", "noise_m10"):
        if noise is None:
            raise ValueError("noise conditions need a draw")
        changed = x + noise if condition == "noise_p10" else x - noise
    else:
        raise ValueError(f"unknown condition {condition!r}")
    return clamp_level(changed)
