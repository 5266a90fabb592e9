"""Decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Acceptance and confidence levels.
MIN_SCORE = 0.1
MIN_GAP = 0.20
MAX_SECOND_SHARE = 0.75
SURE_SCORE = 0.8
RELATIVE_MARGIN = 0.6
MARGIN_EPS = 1e-6
COLLAPSE_RECALL = 98.0
COLLAPSE_SPECIFICITY = 30.0
DEFAULT_THRESHOLD = 0.5
THRESHOLD_MAX = 10.0
REJECTED = -1


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce((~F.isnan(x)) & (F.abs(x) < float("inf")), F.lit(False))


def accept_three_way(s1: Column, s2: Column) -> Column:
    """Enough score, enough gap, weak runner-up; a sure score passes alone, score plus one of the rest passes.

    A score that is not finite is not accepted; a runner-up that is not finite counts as none.
    """
    s2 = F.when(finite(s2), s2).otherwise(F.lit(float("-inf")))
    enough = s1 >= MIN_SCORE
    gap = (s1 - s2) >= MIN_GAP
    weak_second = s2 < s1 * MAX_SECOND_SHARE
    return finite(s1) & ((s1 >= SURE_SCORE) | (enough & (gap | weak_second)))


def confidence(s1: Column, margin: Column, accepted: Column) -> Column:
    """0..1 confidence of a decision."""
    refused = F.least(F.greatest(s1 / MIN_SCORE, F.lit(0.0)), F.lit(0.40))
    base = (
        F.when(s1 >= SURE_SCORE, F.least((s1 - SURE_SCORE) * 0.02, F.lit(0.05)) + 0.95)
        .when(s1 >= MIN_SCORE, (s1 - MIN_SCORE) * 0.25 / 0.7 + 0.70)
        .otherwise(0.50)
    )
    boosted = F.when(margin > 2.0, F.least(base * 1.05, F.lit(1.0))).otherwise(base)
    return F.when(accepted, boosted).otherwise(refused)


def relative_margin(s1: Column, s2: Column) -> Column:
    return (s1 - s2) / (s1 + MARGIN_EPS)


def accept_relative(pred: Column, claimed: Column, s1: Column, s2: Column) -> Column:
    return (pred == claimed) & finite(s1) & finite(s2) & (relative_margin(s1, s2) >= RELATIVE_MARGIN)


def reject_low_score(pred: Column, s1: Column, minimum: float) -> Column:
    return F.when(~finite(s1) | (s1 < minimum), F.lit(REJECTED)).otherwise(pred)


def reject_low_margin(pred: Column, margin: Column, minimum: float) -> Column:
    return F.when(~finite(margin) | (margin < minimum), F.lit(REJECTED)).otherwise(pred)


def verify_claim(pred: Column, claimed: Column, claimed_score: Column, s1: Column, threshold: Column) -> Column:
    """Accept iff the best class is the claim and its score is finite and reaches the threshold."""
    score = F.coalesce(claimed_score, s1)
    return F.coalesce((pred != REJECTED) & (pred == claimed) & finite(score) & (score >= threshold), F.lit(False))


def refusal(pred: Column, claimed: Column, claimed_score: Column, s1: Column, threshold: Column) -> Column:
    """Why ``verify_claim`` does not accept, null where it does."""
    score = F.coalesce(claimed_score, s1)
    return (F.when(~finite(s1), "no finite score").when(claimed.isNull(), "no claim").when(pred != claimed, "another class")
            .when(pred == REJECTED, "rejected").when(~finite(score) | ~(score >= threshold), "below threshold"))


def collapse_flag(recall: Column, specificity: Column) -> Column:
    return (recall >= COLLAPSE_RECALL) & (specificity < COLLAPSE_SPECIFICITY)


def resolve_threshold(requested: Column, configured: Column, stored: Column) -> Column:
    """Request (clamped) before configuration before stored value before the default."""
    clamped = F.when(
        requested.isNotNull(), F.least(F.greatest(requested, F.lit(0.0)), F.lit(THRESHOLD_MAX))
    )
    return F.coalesce(clamped, configured, stored, F.lit(DEFAULT_THRESHOLD))
