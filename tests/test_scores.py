"""Scoring, curves and metrics on small hand-made sets, and properties on random ones."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idmatch.operators import curves, leakage, linear, metrics, quality, scoring, split, vectorsets
from idmatch.plans import gallery, login

QUIET = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def gauss(spark, classes=5, rows=20, d=6, seed=1, spread=8.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, d)) * spread
    data = [(c * rows + i, c, (centres[c] + rng.normal(size=d)).tolist()) for c in range(classes) for i in range(rows)]
    return spark.createDataFrame(data, "sample_id long, label long, v array<double>")


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, genuine boolean")


TINY = [(s, True) for s in (0.9, 0.8, 0.8, 0.6, 0.5, 0.2)] + [(s, False) for s in (0.0, 0.1, 0.1, 0.2, 0.3, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 1.0)]


def brute_curve(rows, n):
    g, m = [s for s, k in rows if k], [s for s, k in rows if not k]
    lo, hi = min(g + m), max(g + m)
    out = {}
    for i in range(n + 1):
        t = lo + (hi - lo) * float(i) / float(n)
        out[i] = (t, 100.0 * sum(s >= t for s in m) / len(m), 100.0 * sum(s < t for s in g) / len(g))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_far_frr_edges_are_exact(spark, seed):
    rng = random.Random(seed)
    rows = TINY if seed == 0 else [(round(rng.random(), 2), rng.random() < 0.3) for _ in range(200)]
    got = curves.far_frr_curve(scores(spark, rows), 200).orderBy("i").select("threshold", "far", "frr").collect()
    assert np.array(got) == pytest.approx(np.array(list(brute_curve(rows, 200).values())))


def test_empty_and_flat_sides_give_the_sentinel(spark):
    for rows in ([(0.1, True), (0.4, True)], [(0.5, True), (0.5, False)]):
        curve = curves.far_frr_curve(scores(spark, rows))
        assert curve.count() == 0
        assert curves.eer(curve).first()["eer"] == 100.0


@QUIET
@given(st.lists(st.tuples(st.floats(-5, 5, width=32), st.booleans()), min_size=4, max_size=60))
def test_curve_properties(spark, rows):
    rows = [(float(s), k) for s, k in rows] + [(0.0, True), (1.0, False)]
    points = curves.far_frr_curve(scores(spark, rows), 200).orderBy("i").collect()
    assert all(a["far"] >= b["far"] and a["frr"] <= b["frr"] for a, b in zip(points, points[1:]))


def test_auc_is_the_rank_statistic(spark):
    rng = random.Random(5)
    rows = [(round(rng.randrange(50) / 50 + (0.2 if k else 0.0), 2), k) for k in [True] * 40 + [False] * 60]
    pairs = [(g > m) + 0.5 * (g == m) for g, a in rows if a for m, b in rows if not b]
    auc = curves.roc_auc(curves.roc_points(scores(spark, rows), 5000)).first()["auc"]
    assert auc == pytest.approx(sum(pairs) / len(pairs), abs=1e-9)


def test_threshold_at_far_takes_the_least_frr(spark):
    best = {r["target"]: r for r in curves.threshold_at_far(curves.far_frr_curve(scores(spark, TINY), 200), (10.0,)).collect()}[10.0]
    want = min((v for v in brute_curve(TINY, 200).values() if v[1] <= 10.0), key=lambda v: (v[2], v[0]))
    assert (best["threshold"], best["far"], best["frr"]) == pytest.approx(want)


@pytest.mark.parametrize("limit", [2**26, 200])
def test_scores_equal_brute_force_in_both_plans(spark, limit):
    df = gauss(spark, 6, 4)
    p = df.select(F.col("sample_id").alias("probe_id"), "label", "v")
    g = vectorsets.class_centroids(df).unionByName(
        spark.createDataFrame([(2, 1, [1.0] * 6, 1.0), (99, 1, [0.0] * 6, 1e-6)], "class long, n long, t array<double>, norm double"))
    probe, gal = {r["probe_id"]: r for r in p.collect()}, g.collect()

    def cos(a, b):
        d = max(math.sqrt(sum(x * x for x in a)), 1e-6) * max(math.sqrt(sum(x * x for x in b)), 1e-6)
        return sum(x * y for x, y in zip(a, b)) / d

    want = {}
    for i, r in probe.items():
        for c in gal:
            want[i, c["class"]] = max(want.get((i, c["class"]), -9), cos(r["v"], c["t"]))
    got = {(r["probe_id"], r["class"]): r["score"] for r in scoring.score_all(p, g, gallery_bytes=limit).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    for r in scoring.claimed_scores(p, g, gallery_bytes=limit).collect():
        mine = sorted(((-s, c) for (i, c), s in want.items() if i == r["probe_id"]))
        assert r["pred"] == mine[0][1] and r["class2"] == mine[1][1]
        assert r["better"] == [c for _, c in mine].index(r["label"])
    bounds = scoring.score_range(p, g, gallery_bytes=limit).first()
    assert (bounds["lo"], bounds["hi"]) == pytest.approx((min(want.values()), max(want.values())))
    hist = scoring.score_histogram(p, g, -1.0, 1.0, 50, gallery_bytes=limit).agg(F.sum("genuine"), F.sum("impostor")).first()
    assert tuple(hist) == (len(probe), len(want) - len(probe))


def test_claim_outside_the_gallery(spark):
    df = gauss(spark, 3, 4)
    g = vectorsets.class_centroids(df.filter("label < 2"))
    p = df.select(F.col("sample_id").alias("probe_id"), "label", "v")
    rows = login.verify_attempts(p, g, F.lit(-1.0)).filter("claimed = 2").collect()
    assert rows and all(r["claimed_score"] == r["s1"] and not r["accepted"] for r in rows)
    assert {r["probe_id"] for r in scoring.genuine_impostor(scoring.score_all(p, g), p).collect()} == {r["probe_id"] for r in p.filter("label < 2").collect()}


def test_calibration_equals_the_score_table(spark):
    df = gauss(spark, 4, 10, spread=0.5)
    p, g = df.select(F.col("sample_id").alias("probe_id"), "label", "v"), vectorsets.class_centroids(df)
    fused = gallery.calibrate(p, g, 200, digits=6)
    table = scoring.genuine_impostor(scoring.score_all(p, g), p).withColumn("score", F.round("score", 6))
    plain = curves.far_frr_curve(table, 200)
    key = lambda c: [(r["i"], round(r["far"], 9), round(r["frr"], 9)) for r in c.orderBy("i").collect()]
    assert key(fused) == key(plain)


def test_metrics_by_hand(spark):
    pairs = [(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2 + [(1, 0)] * 2 + [(2, -1)]
    counts = metrics.confusion(spark.createDataFrame(pairs, "real long, pred long"))
    assert counts.agg(F.sum("n")).first()[0] == len(pairs)
    closed = metrics.closed_confusion(counts)
    assert closed.filter("pred = -1").count() == 0
    by_class = {r["class"]: r for r in metrics.per_class_metrics(closed).collect()}
    assert by_class[0]["precision"] == pytest.approx(60.0) and by_class[0]["recall"] == pytest.approx(75.0)
    binary = {r["class"]: r for r in metrics.binary_metrics(closed).collect()}
    assert (binary[1]["tp"], binary[1]["tn"], binary[1]["fp"], binary[1]["fn"]) == (2, 3, 1, 2)
    perfect = metrics.confusion(spark.createDataFrame([(0, 0), (1, 1)], "real long, pred long"))
    assert metrics.mcc_multiclass(perfect).first()["mcc"] == pytest.approx(100.0)
    one_class = metrics.confusion(spark.createDataFrame([(0, 0), (0, 0)], "real long, pred long"))
    assert metrics.mcc_multiclass(one_class).first()["mcc"] == 0.0
    assert metrics.summary_metrics(perfect).first()["accuracy"] == 100.0


@QUIET
@given(st.lists(st.integers(0, 4), min_size=3, max_size=60), st.floats(0.05, 0.9))
def test_split_is_a_partition(spark, labels, ratio):
    df = spark.createDataFrame(list(enumerate(labels)), "sample_id long, label long")
    rows = split.split_ratio(df, ratio).collect()
    assert sorted(r["sample_id"] for r in rows) == list(range(len(labels)))
    for c in set(labels):
        n, test = labels.count(c), sum(r["split"] == "test" for r in rows if r["label"] == c)
        assert test == 0 if n < 2 else 1 <= test <= n - 1


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 25))
    base[:, :20] = np.where(rng.random(30)[:, None] < 0.5, 0.0, base[:, :20])  # many rows share a zero prefix
    test = np.vstack([base[:6], base[6:9] + 1e-10, base[9:12] + 2e-3 / 5, base[12:14], base[12:14], rng.normal(size=(5, 25))])
    test[6:9, :20] = base[6:9, :20]  # the prefix must agree exactly
    table = lambda x: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample_id long, v array<double>")
    train_df, test_df = table(np.vstack([base, base[:1], base[:1]])), table(test)
    report = leakage.leakage_exact(train_df, test_df).first()
    same = [any((np.abs(t - b) <= 1e-9).all() and (t[:20] == b[:20]).all() for b in base) for t in test]
    assert report["leaked"] == sum(same) and not report["disjoint"]
    train = np.vstack([base, base[:1], base[:1]])
    want = sum(np.linalg.norm(t - b) < 0.01 for t in test for b in train)
    assert leakage.near_summary(leakage.near_pairs(train_df, test_df, 25)).first()["near_pairs"] == want


def test_duplicate_identity(spark):
    df = gauss(spark, 4, 30)
    g = vectorsets.class_centroids(df)
    close = df.filter("label = 2").select((F.col("sample_id") + 1000).alias("probe_id"), F.lit(1).alias("batch_id"), "v")
    mixed = df.filter("sample_id % 30 < 7").select((F.col("sample_id") + 2000).alias("probe_id"), F.lit(2).alias("batch_id"), "v")
    out = {r["batch_id"]: r for r in scoring.duplicate_identity(close.unionByName(mixed), g, margin=0.1).collect()}
    assert out[1]["duplicate"] and out[1]["top_class"] == 2 and out[1]["m"] == 25
    assert not out[2]["duplicate"]


def test_gates_report_the_first_reason(spark):
    cols = "id int, mean_x double, sd_x double, min_x double, max_x double, low_pct double, high_pct double"
    rows = [(1, 60.0, 30.0, 20.0, 200.0, 1.0, 0.0), (2, 10.0, 1.0, 0.0, 255.0, 99.0, 9.0), (3, 60.0, 1.0, 0.0, 255.0, 99.0, 9.0),
            (4, 60.0, 30.0, 1.0, 255.0, 99.0, 9.0), (5, 60.0, 30.0, 20.0, 250.0, 99.0, 9.0), (6, 60.0, 30.0, 20.0, 240.0, 99.0, 9.0), (7, 60.0, 30.0, 20.0, 240.0, 1.0, 9.0)]
    got = {r["id"]: r["reason"] for r in quality.quality_gate(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: None, 2: "mean_range", 3: "low_contrast", 4: "too_dark", 5: "too_bright", 6: "many_dark", 7: "many_bright"}


def test_enrolment_and_regression_gate(spark):
    one = lambda x: spark.createDataFrame([(x,)], "a double")
    verdict = lambda a, b: linear.regression_gate(one(a), b).first()["verdict"]
    assert verdict(90.0, one(91.9)) == "keep" and verdict(89.0, one(91.5)) == "reject"
    assert verdict(50.0, one(1.0).filter("a > 5")) == "keep"
