"""Scalar functions over ``array<double>`` columns.

A value used more than once inside a higher-order function is bound with :func:`let`; without it
Catalyst would re-evaluate (say) the norm for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards and weights that results depend on.
NORM_FLOOR = 1e-12
L2_EPS = 1e-8
SERIES_L2_EPS = 1e-10
SUM_EPS = 1e-10
ROOT_EPS = 1e-8
WEIGHT_FACTOR = 1.5
WEIGHT_MIN = 1.0
WEIGHT_MAX = 15.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_vector(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the common prefix."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda acc, x: acc + x
    )


def sum_squares(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.greatest(sum_squares(v), F.lit(NORM_FLOOR)))


def l2_normalize(v: Column, eps: float = L2_EPS) -> Column:
    return let(
        F.sqrt(sum_squares(v)),
        lambda n: F.when(n > eps, F.transform(v, lambda x: x / n)).otherwise(v),
    )


def cosine(a: Column, b: Column) -> Column:
    return let(
        l2_norm(a) * l2_norm(b),
        lambda d: F.when(d <= NORM_FLOOR, F.lit(-1.0)).otherwise(dot(a, b) / d),
    )


def euclidean(a: Column, b: Column) -> Column:
    """Distance over the common prefix."""
    squared = F.zip_with(a, b, lambda x, y: F.coalesce((x - y) * (x - y), F.lit(0.0)))
    return F.sqrt(_total(squared))


def sum_normalize(v: Column) -> Column:
    return let(
        _total(v),
        lambda s: F.when(s > SUM_EPS, F.transform(v, lambda x: x / s)).otherwise(
            F.transform(v, lambda x: F.lit(0.0))
        ),
    )


def root_l2_blocks(v: Column, length: int) -> Column:
    """Per block of ``length`` values: square root, then unit norm."""
    starts = F.sequence(F.lit(1), F.size(v), F.lit(length))
    rooted = lambda s: F.transform(F.slice(v, s, length), lambda x: F.sqrt(x + ROOT_EPS))
    unit = lambda block: let(
        F.sqrt(sum_squares(block)), lambda n: F.transform(block, lambda x: F.when(n > 0, x / n).otherwise(0.0))
    )
    return F.flatten(F.transform(starts, lambda s: let(rooted(s), unit)))


def zscore_apply(v: Column, mean: Column, sd: Column) -> Column:
    """(x - mean) / sd; null when the sizes differ."""
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    return F.when(
        (F.size(v) == F.size(mean)) & (F.size(v) == F.size(sd)),
        F.zip_with(centred, sd, lambda x, s: x / s),
    )


def project(v: Column, mean: Column, components: Column) -> Column:
    """(x - mean) on each component; ``components`` is an array of arrays. Null when sizes differ."""
    return F.when(
        F.size(v) == F.size(mean),
        let(
            F.zip_with(v, mean, lambda x, m: x - m),
            lambda c: F.transform(components, lambda w: dot(c, w)),
        ),
    )


def poly_expand(v: Column) -> Column:
    return F.concat(v, F.transform(v, lambda x: x * x))


def _finite(x: Column) -> Column:
    return ~(F.isnan(x) | (F.abs(x) == float("inf")))


def sanitize(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(_finite(x), x).otherwise(0.0))


def has_invalid(v: Column) -> Column:
    return F.exists(v, lambda x: ~_finite(x))


def class_weight(negatives: Column, positives: Column, logarithmic: bool = False) -> Column:
    """Weight of the positive side, from the imbalance ratio."""
    ratio = negatives / positives
    raw = F.log(ratio + 1.0) if logarithmic else F.sqrt(ratio)
    return F.least(F.greatest(raw * WEIGHT_FACTOR, F.lit(WEIGHT_MIN)), F.lit(WEIGHT_MAX))
