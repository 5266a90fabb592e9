"""Rank, selection, quantile and neighbour primitives against brute force, with many small buckets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idmatch.functions.draws import shuffle_key
from idmatch.operators import exact


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(exact.equi_depth, "__defaults__", (7,))


def hot_rows(n=400, seed=3):
    """A third of the rows in one group, repeated order values."""
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.33 else rng.randrange(1, 6), i, float(rng.randrange(40))) for i in range(n)]


@pytest.mark.parametrize("heavy", [False, True])
def test_row_index(spark, heavy):
    rows = [(g, i, 7.0 if heavy and i % 2 else x) for g, i, x in hot_rows()]  # heavy: half of all rows at one value
    df = spark.createDataFrame(rows, "g long, id long, x double")
    got = {r["id"]: r["idx"] for r in exact.row_index(df, ["g"], "x", "id", rows_per_bucket=7).collect()}
    sizes = exact.equi_depth_pair(df, "x", "id", 7).groupBy(exact.BUCKET).count().agg(F.max("count")).first()[0]
    assert sizes <= 60  # no bucket holds the repeated value whole
    want = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1]))):
            want[r[1]] = i
    assert got == want


def test_quantiles(spark, small_buckets):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g long, id long, x double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    for r in exact.quantiles(df, ["g"], "x", shares).collect():
        want = np.quantile([x for g, _, x in rows if g == r["g"]], r["share"])
        assert r["value"] == pytest.approx(want)
    whole = {r["share"]: r["value"] for r in exact.quantiles(df, [], "x", shares).collect()}
    assert whole == pytest.approx({s: np.quantile([r[2] for r in rows], s) for s in shares})


@pytest.mark.parametrize("take", [0, 1, 5, 100, 1000])
def test_mark_first(spark, monkeypatch, take):
    monkeypatch.setattr("idmatch.functions.draws.BUCKET_DIGITS", 1)  # few, full buckets: the cut falls inside one
    rows = hot_rows()
    df = spark.createDataFrame(rows, "g long, id long, x double")
    marked = exact.mark_first(df, ["g"], "id", 42, F.lit(take)).withColumn("d", shuffle_key(F.col("id"), 42)).collect()
    assert len(marked) == len(rows)
    for g in {r[0] for r in rows}:
        members = sorted((r for r in marked if r["g"] == g), key=lambda r: (r["d"], r["id"]))
        assert [r["chosen"] for r in members] == [i < take for i in range(len(members))]


def test_dense_index_spans_label_runs(spark, monkeypatch):
    monkeypatch.setattr(exact, "LABEL_RUN", 10)
    labels = [3, 17, 17, 5, 250, 9, 10]
    df = spark.createDataFrame([(x,) for x in labels], "label long")
    got = {r["label"]: r["i"] for r in exact.dense_index(df, "label", "i").collect()}
    assert got == {x: i for i, x in enumerate(sorted(set(labels)))}


def test_neighbours_and_running_sum_cross_runs(spark):
    xs = [random.Random(i).randrange(100) for i in range(50)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "series_id string, idx long, x long")
    spread, w = exact.neighbourhood(df, "series_id", "idx", 2, 1, run=4)
    look = exact.own_rows(spread.withColumn("b", exact.neighbour(w, "idx", "x", -2)).withColumn("a", exact.neighbour(w, "idx", "x", 1)))
    got = {r["idx"]: (r["b"], r["a"]) for r in look.collect()}
    at = lambda i: xs[i] if 0 <= i < len(xs) else None
    assert got == {i: (at(i - 2), at(i + 1)) for i in range(50)}
    sums = {r["idx"]: r["t"] for r in exact.running_sum(df, "series_id", "idx", "x", "t", run=4).collect()}
    assert sums == {i: sum(xs[: i + 1]) for i in range(50)}


def test_neighbour_respects_gaps(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 2, 3.0), ("s", 3, 4.0)], "series_id string, idx long, x double")
    got = {r["idx"]: r["p"] for r in exact.with_previous(df, "series_id", "idx", "x", "p").collect()}
    assert got == {0: None, 2: None, 3: 3.0}
