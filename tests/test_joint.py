"""The joint one-vs-rest fit: one optimum, whatever the partitions, groups, steps and odd rows."""

import numpy as np
import pytest

from idmatch.operators import joint, linear

KIND = "label long, v array<double>, extra string"


def rows_of(n=160, classes=3, d=5):
    draw = np.random.default_rng(4)
    middle = draw.normal(size=(classes, d))
    return [(int(c), (middle[c] + draw.normal(size=d)).tolist(), "x") for c in np.minimum(draw.integers(0, 2 * classes, n), classes - 1)]  # half the rows in the last class


def matrix(model):
    return np.array([[c, *w, b] for c, w, b in model])


def slope(rows, model, reg, weights=None):
    x, y = np.array([[*v, 1.0] for _, v, _ in rows]), np.array([c for c, _, _ in rows])
    out = []
    for c, w, b in model:
        own, w = y == c, np.array([*w, b])
        cost, sign = np.where(own, (weights or {}).get(c, 1.0), 1.0), np.where(own, 1.0, -1.0)
        push = cost * np.clip((1 - sign * (x @ w)) / joint.WIDTH, 0, 1) * -sign
        out.append(x.T @ push / cost.sum() + reg * np.append(w[:-1], 0.0))
    return np.abs(out).max()


@pytest.mark.parametrize("weights", [None, {0: 4.0, 2: 0.5}])
def test_the_fit_is_the_optimum_for_any_partitions_and_steps(spark, weights):
    rows = rows_of()
    fits = [joint.joint_fit(spark.createDataFrame(rows, KIND).repartition(n), 0.01, weights) for n in (1, 2, 8)]
    fits.append(joint.joint_fit(spark.createDataFrame(rows, KIND), 0.01, weights, tolerance=1e-5, group_bytes=1))  # a class at a time, quasi-Newton
    assert slope(rows, fits[0], 0.01, weights) < 1e-6
    for other in fits[1:]:
        assert matrix(other) == pytest.approx(matrix(fits[0]), abs=2e-3)
    assert matrix(fits[1]) == pytest.approx(matrix(fits[0]), abs=1e-8) and matrix(fits[2]) == pytest.approx(matrix(fits[0]), abs=1e-8)


def test_odd_rows_take_no_part(spark):
    rows = rows_of(80, 3)
    odd = [(None, [1.0] * 5, "x"), (1, None, "x"), (1, [1.0], "x"), (2, [float("nan")] * 5, "x"), (2, [None] * 5, "x"), (1, [], "x")]
    plain = joint.joint_fit(spark.createDataFrame(rows, KIND), 0.1)
    assert matrix(joint.joint_fit(spark.createDataFrame(rows + odd, KIND), 0.1)) == pytest.approx(matrix(plain), abs=1e-9)
    assert joint.joint_fit(spark.createDataFrame([], KIND), 0.1) == []
    one = joint.joint_fit(spark.createDataFrame(rows, KIND), 0.1, only=[1])
    assert matrix(one) == pytest.approx(matrix(plain)[1:2], abs=1e-6)
    assert len(joint.joint_fit(spark.createDataFrame([(7, [1.0, 2.0], "x")] * 3, KIND), 0.1)) == 1


def test_wide_rows_use_a_diagonal_start(spark, monkeypatch):
    rows = rows_of(100, 2, 12)
    full = joint.joint_fit(spark.createDataFrame(rows, KIND), 0.1)
    monkeypatch.setattr(joint, "FULL", 4)
    wide = joint.joint_fit(spark.createDataFrame(rows, KIND), 0.1, tolerance=1e-5, group_bytes=1)
    assert matrix(wide) == pytest.approx(matrix(full), abs=2e-3)


def test_a_class_that_is_already_known_is_refused(spark):
    df = spark.createDataFrame(rows_of(60, 3), KIND)
    with pytest.raises(ValueError):
        linear.add_class(linear.ova_svm_fit(df, 0.1), df, 1, 0.1)
