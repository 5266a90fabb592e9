"""Text, number-validation, date and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acceptance levels of the phrase comparison.
LOGIN_SIMILARITY = 0.70
STRICT_SIMILARITY = 0.85

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"
VERSION_STAMP = "yyyyMMdd_HHmmss"


def normalize_text(t: Column) -> Column:
    """ASCII letters (lowered), digits and single spaces."""
    kept = F.lower(F.regexp_replace(t, r"[^A-Za-z0-9\s]", ""))
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def text_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length on normalised text; null when both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest)


def similar_at_least(a: Column, b: Column, level: float) -> Column:
    """``text_similarity(a, b) >= level``, with an edit distance that stops where the level is out of reach.

    A level allows a pair so many edits, which depends on its longer text. Texts whose lengths differ by more are settled
    at once; the others are compared within a band of that width around the diagonal, not over the whole matrix. The
    answer is exact.
    """
    longest = F.greatest(F.length(a), F.length(b))
    edits = F.ceil((1.0 - level) * longest).cast("int")  # one too many at most; the last comparison decides
    distance = F.call_function("levenshtein", a, b, edits)
    return (
        F.when(longest == 0, F.lit(None).cast("boolean"))
        .when(F.abs(F.length(a) - F.length(b)) > edits, False)
        .otherwise((distance >= 0) & ((1.0 - distance / longest) >= level))
    )


def id_from_name(name: Column, digits: int = 3) -> Column:
    """Leading ``digits`` digits as a number, else null."""
    found = F.regexp_extract(name, rf"^(\d{{{digits}}})", 1)
    return F.when(found != "", found.cast("long"))


def first_number(name: Column) -> Column:
    """First run of digits as a number, else -1."""
    found = F.regexp_extract(name, r"(\d+)", 1)
    return F.when(found != "", found.cast("long")).otherwise(F.lit(-1).cast("long"))


def is_int(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^[+-]?\d+$") & t.try_cast("long").isNotNull(), F.lit(False))


def is_number(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.lit(False))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, ISO_UTC)


def version_ts(ts: Column) -> Column:
    return F.date_format(ts, VERSION_STAMP)
