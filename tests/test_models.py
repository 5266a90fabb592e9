"""Fits on separable synthetic data and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from idmatch.operators import augment, hinge, linear, reduce, scoring, split, templates, vectorsets
from idmatch.plans import gallery
from tests.test_scores import gauss


def accuracy(df, model):
    return linear.evaluate(df, model).first()["accuracy"]


def test_pca_against_numpy(spark):
    df = gauss(spark, 4, 25)
    x = np.array([r["v"] for r in df.collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    model = reduce.pca_fit(df, 3).first()
    assert model["values"] == pytest.approx(values[::-1][:3].tolist())
    for got, want in zip(model["components"], vectors.T[::-1]):
        assert abs(np.dot(got, want)) == pytest.approx(1.0)
    assert len(reduce.pca_fit(df, 50).first()["components"]) == 6
    y = np.array([r["v"] for r in reduce.project_vectors(df, reduce.pca_fit(df, 3)).orderBy("sample_id").collect()])
    assert y == pytest.approx((x - x.mean(0)) @ np.array(model["components"]).T)


def test_lda_against_numpy(spark):
    df = gauss(spark, 4, 25, spread=1.0)
    rows = df.collect()
    x, y = np.array([r["v"] for r in rows]), np.array([r["label"] for r in rows])
    m, d = x.mean(0), x.shape[1]
    sw, sb = np.zeros((d, d)), np.zeros((d, d))
    for c in np.unique(y):
        k = x[y == c]
        sw += (k - k.mean(0)).T @ (k - k.mean(0))
        sb += len(k) * np.outer(k.mean(0) - m, k.mean(0) - m)
    sw += np.eye(d) * 0.001 * np.trace(sw) / d
    values, vectors = np.linalg.eig(np.linalg.solve(sw, sb))
    order = np.argsort(-values.real)
    model = reduce.lda_fit(df, 10).first()
    assert len(model["components"]) == 3  # bounded by classes - 1
    assert model["values"] == pytest.approx(values.real[order][:3].tolist(), rel=1e-6)
    for got, want in zip(model["components"], vectors.real.T[order]):
        assert abs(np.dot(got, want / np.linalg.norm(want))) == pytest.approx(1.0, abs=1e-6)


def test_svm_separates(spark):
    df = gauss(spark, 4, 20)
    parts = split.split_ratio(df, 0.25).persist()
    train, test = parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split")
    model = linear.ova_svm_fit(train, 0.001, 30)
    assert accuracy(test, model) > 95
    assert accuracy(test, linear.ova_svm_fit_weighted(train, 1.0, 30)) > 95
    assert {r["class"] for r in model.collect()} == {0, 1, 2, 3}

    joint = hinge.ova_hinge_fit(train.repartition(3), 0.001, 10)
    assert accuracy(test, joint) > 95 and {r["class"] for r in joint.collect()} == {0, 1, 2, 3}
    assert accuracy(test, hinge.ova_hinge_fit(train, 0.001, 10, {c: 3.0 for c in range(4)})) > 95

    base = linear.ova_svm_fit(train.filter("label <> 3"), 0.001, 30)
    grown = linear.add_class(base, train, 3, 0.001, 30, share=1.0)
    assert accuracy(test, grown) > 90
    with pytest.raises(ValueError):
        linear.add_class(base, train, 1)


def test_bias_rules(spark):
    model = spark.createDataFrame([(i, [1.0], b) for i, b in enumerate([-1.0, 0.0, 1.0])], "class long, w array<double>, b double")
    sd = np.std([-1.0, 0.0, 1.0])
    new = spark.createDataFrame([(9, [1.0], 10.0), (8, [1.0], 0.5), (7, [1.0], -10.0)], "class long, w array<double>, b double")
    got = {r["class"]: r["b"] for r in linear.bias_clamp(new, model).collect()}
    assert got == pytest.approx({9: (10 + 2.5 * sd) / 2, 8: 0.5, 7: (-10 - 2.5 * sd) / 2})
    rows = spark.createDataFrame([(0, 10.0, 0, 100), (1, 90.0, 16, 84), (2, 90.0, 1, 99)], "class long, f1 double, fp long, tn long")
    got = {r["class"]: r["b"] for r in linear.bias_penalty(model, rows).collect()}
    assert got == {0: -2.5, 1: -1.5, 2: 1.0}
    met = spark.createDataFrame([(0,)], "class long")
    assert {r["class"]: r["b"] for r in linear.bias_penalty(model, rows, met).collect()}[0] == -1.0


def spherical(x, k, iterations=10):
    """Plain form of the k-template rule for one class."""
    unit = lambda v: v / np.linalg.norm(v)
    norms = np.linalg.norm(x, axis=1)
    centres = [unit(x[0])]
    for _ in range(1, k):
        near = np.max(x @ np.array(centres).T / norms[:, None], axis=1)
        centres.append(unit(x[int(np.argmin(near))]))
    for _ in range(iterations):
        best = np.argmax(x @ np.array(centres).T / norms[:, None], axis=1)
        centres = [unit(x[best == c].mean(0)) if (best == c).any() else centres[c] for c in range(k)]
    return np.array(centres)


def test_k_templates_against_numpy(spark):
    df = gauss(spark, 3, 15, spread=1.0)
    rows = df.orderBy("sample_id").collect()
    got = templates.k_templates(df, 3).orderBy("class", "k").collect()
    for c in range(3):
        want = spherical(np.array([r["v"] for r in rows if r["label"] == c]), 3)
        assert np.array([r["t"] for r in got if r["class"] == c]) == pytest.approx(want)
    single = templates.k_templates(df.filter("sample_id = 0"), 2).collect()
    assert len(single) == 2 and single[0]["t"] == pytest.approx(single[1]["t"])


def test_augment(spark):
    df = gauss(spark, 2, 3, spread=0.1)
    out = augment.augment(df, 5)
    assert out.count() == 6 * 6
    again = {(r["sample_id"], r["variant"]): r["v"] for r in augment.augment(df.repartition(5), 5).collect()}
    assert again == {(r["sample_id"], r["variant"]): r["v"] for r in out.collect()}
    kinds = {r["variant"]: r["kind"] for r in out.collect()}
    assert kinds == {0: "original", 1: "noise", 2: "volume", 3: "noise_volume", 4: "speed", 5: "noise"}
    assert {r["n"] for r in out.filter("variant = 4").select(F.size("v").alias("n")).collect()} <= {5, 6, 7}
    with pytest.raises(ValueError):
        augment.augment(df, 11)


def test_fit_gallery(spark):
    df = gauss(spark, 5, 20, d=8)
    parts = split.split_ratio(df, 0.25).persist()
    fitted = gallery.fit_gallery(parts.filter("split = 'train'").drop("split"), parts.filter("split = 'test'").drop("split"), 6, 4, 200)
    p = fitted.transform(parts.filter("split = 'test'")).select(F.col("sample_id").alias("probe_id"), "label", "v")
    assert scoring.topk_accuracy(scoring.claimed_scores(p, fitted.templates), (1,)).first()["accuracy"] > 95
    assert fitted.threshold.first()["eer"] < 5


def test_vector_set_guards(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 5.0]), (1, 1, [1.0, 7.0])], "sample_id long, label long, v array<double>")
    fitted = vectorsets.zscore_fit(df).first()
    assert fitted["sd"] == [1.0, 1.0] and fitted["mean"] == [1.0, 6.0]
    assert vectorsets.zscore_fit(df.limit(1)).first()["sd"] == [1.0, 1.0]
    odd = df.unionByName(spark.createDataFrame([(2, 1, [1.0])], df.schema))
    assert vectorsets.dim_guard(odd, 2).count() == 2
    assert not vectorsets.compat_check(df, odd).first()["compatible"]
    wide = vectorsets.to_wide(vectorsets.to_long(odd, ["sample_id"]), ["sample_id"])
    assert {r["sample_id"]: r["v"] for r in wide.collect()} == {r["sample_id"]: r["v"] for r in odd.collect()}
