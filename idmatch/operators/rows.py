"""One-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of further one-row tables next to ``first``, as scalar subqueries (null where one is empty)."""
    for other in others:
        row = other.select(F.struct(*other.columns)).scalar()
        first = first.withColumns({c: row.getField(c) for c in other.columns})
    return first
