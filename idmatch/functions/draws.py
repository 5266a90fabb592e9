"""Seeded draws that depend on row keys only, so a re-run task draws the same values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_DIGITS = 3  # hex digits of the draw used as a coarse bucket: 4096 buckets


def shuffle_key(key: Column, seed: int) -> Column:
    """Hex digest whose order is a seeded shuffle of ``key``."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def shuffle_bucket(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, BUCKET_DIGITS), 16, 10).cast("int")


def uniform(key: Column, salt: str) -> Column:
    """Uniform in [0, 1) from the first 32 bits of the digest."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def gaussian(key: Column, salt: str) -> Column:
    """Standard normal by the polar-angle transform of two uniforms."""
    u = uniform(key, f"{salt}:r")
    angle = uniform(key, f"{salt}:a") * (2.0 * math.pi)
    return F.sqrt(F.log(1.0 - u) * -2.0) * F.cos(angle)
