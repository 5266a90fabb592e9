"""Login decisions for any number of attempts in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.functions import rules, text
from idmatch.operators import relations, scoring


def verify_attempts(attempts: DataFrame, gallery: DataFrame, threshold: Column, metric: str = scoring.COSINE) -> DataFrame:
    """1:1 decisions. ``attempts`` holds (probe_id, label = claimed class, v).

    Every attempt keeps its row: one without a claim is identified but not accepted, one without a finite score (a
    damaged vector, a width that no template has, an empty gallery) has neither class nor score.
    Output: (probe_id, claimed, pred, s1, claimed_score, accepted, reason).
    """
    best = scoring.claimed_scores(attempts, gallery, metric)
    claimed = F.coalesce(F.col("own"), F.col("s1"))
    accepted = rules.verify_claim(F.col("pred"), F.col("label"), F.col("own"), F.col("s1"), threshold)
    reason = rules.refusal(F.col("pred"), F.col("label"), F.col("own"), F.col("s1"), threshold)
    return best.select("probe_id", F.col("label").alias("claimed"), "pred", "s1", claimed.alias("claimed_score"),
                       accepted.alias("accepted"), reason.alias("reason"))


def eligible_attempts(attempts: DataFrame, users: DataFrame, credentials: DataFrame, modality: str,
                      user_key: str = "id_usuario") -> DataFrame:
    """Attempts of active users holding an active credential; rejected ones never reach scoring."""
    active = users.filter(F.col("estado") == relations.ACTIVE).select(user_key)
    held = relations.active_credentials(credentials, modality).select(user_key).distinct()
    return attempts.join(active, user_key, "left_semi").join(held, user_key, "left_semi")


def phrase_scores(transcripts: DataFrame, phrases: DataFrame, key: str, said: str, expected: str) -> DataFrame:
    """What was said beside the attached phrase, both normalised (said_norm, phrase_norm)."""
    joined = relations.attach_phrase(relations.spread(transcripts, key), phrases, key)
    a, b = text.normalize_text(F.col(said)), text.normalize_text(F.col(expected))
    return joined.withColumn("said_norm", a).withColumn("phrase_norm", b)


def accept_final(top2: DataFrame, claims: DataFrame, phrase_ok: DataFrame | None = None) -> DataFrame:
    """Score rule, phrase rule (where a phrase was given) and identity rule together.

    ``top2`` holds (probe_id, pred, s1, s2, margin), ``claims`` (probe_id, claimed), ``phrase_ok``
    (probe_id, phrase_match).
    """
    j = top2.join(claims, "probe_id")
    if phrase_ok is None:
        j = j.withColumn("phrase_match", F.lit(None).cast("boolean"))
    else:
        j = j.join(phrase_ok.select("probe_id", "phrase_match"), "probe_id", "left")
    by_score = rules.accept_three_way(F.col("s1"), F.coalesce(F.col("s2"), F.lit(float("-inf"))))
    accepted = by_score & F.coalesce(F.col("phrase_match"), F.lit(True)) & F.coalesce(F.col("pred") == F.col("claimed"), F.lit(False))
    return j.withColumn("score_ok", by_score).withColumn("accepted", accepted).withColumn(
        "confidence", rules.confidence(F.col("s1"), F.col("margin"), by_score)
    )
