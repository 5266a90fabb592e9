"""Reductions of vectors too wide for a d x d matrix, against numpy and the d x d path."""

import numpy as np
import pytest

from idmatch.operators import reduce


def table(spark, x, labels=None):
    rows = [(int(0 if labels is None else labels[i]), r.tolist()) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "label long, v array<double>")


def model(df):
    row = df.first()
    return np.array(row["mean"]), np.array(row["components"]), np.array(row["values"])


def test_components_of_twenty_thousand_dimensions(spark):
    draw, n, d, k = np.random.default_rng(1), 40, 20_000, 4
    x = draw.normal(size=(n, 8)) * np.array([50, 30, 18, 10, 2, 1, 1, 1.0]) @ draw.normal(size=(8, d)) / np.sqrt(d) + 0.05
    mean, components, values = model(reduce.pca_fit(table(spark, x), k))
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert components.shape == (k, d) and mean == pytest.approx(x.mean(axis=0))
    assert values == pytest.approx(s[:k] ** 2 / (n - 1), rel=1e-8)
    assert np.abs((components * vt[:k]).sum(axis=1)) == pytest.approx(np.ones(k), abs=1e-8)


def test_narrow_and_wide_ways_agree(spark, monkeypatch):
    draw, d, classes = np.random.default_rng(3), 6, 3
    labels = draw.integers(0, classes, 100)
    x = draw.normal(size=(classes, d))[labels] * np.linspace(4, 0.5, d) + draw.normal(size=(100, d))
    df = table(spark, x, labels)
    df = df.unionByName(spark.createDataFrame([(0, None), (1, [1.0])], df.schema))  # no vector, another width
    dense = [model(reduce.pca_fit(df, 2)), model(reduce.lda_fit(df, 2))]
    monkeypatch.setattr(reduce, "MAX_DIMS", 5)
    for (_, a, u), (_, b, w) in zip(dense, [model(reduce.pca_fit(df, 2)), model(reduce.lda_fit(df, 2))]):
        assert u == pytest.approx(w, rel=1e-6)
        assert np.abs((a * b).sum(axis=1)) == pytest.approx(np.ones(2), abs=1e-6)


def test_discriminants_of_more_classes_than_directions(monkeypatch):
    draw, d, classes = np.random.default_rng(5), 30, 25
    monkeypatch.setattr(reduce.wide, "MORE", 3)
    labels = draw.integers(0, classes, 400)
    x = draw.normal(size=(classes, d))[labels] * np.linspace(4, 0.2, d) + draw.normal(size=(400, d))
    x -= x.mean(axis=0)
    centres = np.array([x[labels == c].mean(axis=0) * np.sqrt((labels == c).sum()) for c in range(classes)])
    total, between = x.T @ x, centres.T @ centres
    values, w = reduce.wide.discriminants(lambda b: total @ b, lambda b: between @ b, d, 0.01, 2)
    root = np.linalg.inv(np.linalg.cholesky(total - between + 0.01 * np.eye(d)))
    want = np.linalg.eigvalsh(root @ between @ root.T)[::-1][:2]
    assert values == pytest.approx(want, rel=1e-5)
    for value, one in zip(values, w):
        left = between @ one - value * ((total - between) @ one + 0.01 * one)
        assert np.linalg.norm(left) < 1e-2 * np.linalg.norm(between @ one)


def test_nothing_to_fit(spark):
    with pytest.raises(ValueError):
        reduce.pca_fit(table(spark, []), 2)
