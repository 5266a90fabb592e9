"""Series operators against plain loops, with a series that crosses position runs."""

import math
import random

import numpy as np
import pytest

from idmatch.operators import exact, series


def table(spark, **named):
    rows = [(n, i, float(x)) for n, xs in named.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "series_id string, idx long, x double")


def bursts(seed, n=400):
    """Silence with loud stretches, short holes and blips."""
    rng = random.Random(seed)
    xs, loud = [], False
    while len(xs) < n:
        loud = not loud
        for _ in range(rng.choice([2, 4, 8, 30])):
            xs.append(rng.gauss(0, 0.4) if loud else rng.gauss(0, 0.01))
    return xs[:n]


def plain_frames(xs, size, stride):
    out = []
    for f in range(1 + (len(xs) - size) // stride if len(xs) >= size else 0):
        w = xs[f * stride:f * stride + size]
        bins = [0.0] * 8
        for j, x in enumerate(w):
            bins[min(7, j // max(1, size // 8))] += x * x
        t = max(sum(bins), 1e-12)
        h = -sum(b / t * math.log2(b / t) for b in bins if b > 0) / 3
        z = sum((a >= 0) != (b >= 0) for a, b in zip(w, w[1:])) / (size - 1)
        out.append((math.sqrt(sum(x * x for x in w) / size), z, h))
    return out


def plain_segments(xs, cfg):
    """The segment rule as one loop over frames, for comparison only."""
    fr = plain_frames(xs, cfg.frame, cfg.stride)
    n = len(xs)
    if not fr:
        return [(0, n)]
    e, z, h = (np.array(c) for c in zip(*fr))
    te, tz, th = max(cfg.energy_floor, np.median(e) * 0.75, e.mean() * 0.6), max(0.02, z.mean() * 0.9), max(0.05, h.mean() * 0.95)
    v = ((e >= te) & ((z <= tz * 1.15) | (h <= th * 1.1))) | ((e >= te * 0.5) & (z <= tz * 0.9) & (h <= th))
    k = len(v)
    at = lambda a, i: bool(a[i]) if 0 <= i < k else False
    s = [at(v, i) or (at(v, i - 1) and at(v, i + 1)) for i in range(k)]
    a = list(s)
    for i in range(2, k - 2):
        if not s[i] and not s[i - 1] and s[i - 2] and s[i + 1]:
            a[i] = a[i - 1] = True
    edges = [i for i in range(k + 1) if at(a, i) != at(a, i - 1)]
    raw = [(max(0, f0 * cfg.stride - cfg.padding), min(n, f1 * cfg.stride + cfg.frame + cfg.padding)) for f0, f1 in zip(edges[::2], edges[1::2])]
    out = []
    for start, stop in (r for r in raw if r[1] - r[0] >= cfg.min_length):
        if out and start - out[-1][1] <= cfg.merge_gap:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out or [(0, n)]


CFG = series.Activity(frame=8, stride=4, padding=2, min_length=21, merge_gap=6)


def test_segments_against_a_loop(spark, monkeypatch):
    for name in ("neighbourhood", "running_sum"):  # short runs, so that series cross many borders
        f = getattr(exact, name)
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 8))
    named = {f"s{i}": bursts(i) for i in range(4)} | {"short": [0.1] * 5, "silent": [0.0] * 60}
    df = table(spark, **named)
    segments = series.activity_segments(df, CFG).collect()
    got = {n: sorted((r["start"], r["stop"]) for r in segments if r["series_id"] == n) for n in named}
    assert got == {n: plain_segments(xs, CFG) for n, xs in named.items()}
    kept = {r["series_id"]: r["kept"] for r in series.retention(series.activity_segments(df, CFG), df).collect()}
    assert kept == {n: sum(b - a for a, b in s) for n, s in got.items()}


def test_frames_against_a_loop(spark):
    xs = bursts(9, 100)
    rows = series.frames(table(spark, a=xs), 16, 5).orderBy("frame").collect()
    assert np.array([(r["energy"], r["zcr"], r["entropy"]) for r in rows]) == pytest.approx(np.array(plain_frames(xs, 16, 5)))


def test_rolling_gain(spark):
    xs, size = bursts(3, 60), 8
    num, den = np.zeros(60), np.zeros(60)
    for f in range(1 + (60 - size) // 4):
        w = np.array(xs[f * 4:f * 4 + size])
        rms = math.sqrt((w**2).mean())
        gain = min(0.1 / rms, 10.0) if rms > 1e-4 else 1.0
        hann = 0.5 * (1 - np.cos(2 * math.pi * np.arange(size) / (size - 1)))
        num[f * 4:f * 4 + size] += w * gain * hann
        den[f * 4:f * 4 + size] += hann
    want = np.clip(np.where(den > 1e-6, num / np.where(den > 1e-6, den, 1), xs), -1, 1)
    out = series.rolling_gain(table(spark, a=xs, b=[0.2, -0.2, 0.2]), size)
    assert [r["x"] for r in out.filter("series_id = 'a'").orderBy("idx").collect()] == pytest.approx(want.tolist())
    assert [r["x"] for r in out.filter("series_id = 'b'").orderBy("idx").collect()] == pytest.approx([0.1, -0.1, 0.1])


@pytest.mark.parametrize("factor", [0.85, 1.0, 1.15, 3.0])
def test_resample(spark, factor):
    xs = [math.sin(i) for i in range(20)]
    want = []
    for i in range(max(1, int(20 / factor))):
        k = int(i * factor)
        part = i * factor - k
        want.append(xs[k] * (1 - part) + xs[k + 1] * part if k + 1 < 20 else xs[k])
    got = series.resample_linear(table(spark, a=xs), factor).orderBy("idx").collect()
    assert [r["x"] for r in got] == pytest.approx(want)


def test_levels_and_gate(spark):
    df = table(spark, silent=[0.0] * 1200, ok=[0.1, -0.1] * 16000, clipped=[1.0] * 32000, few=[0.5] * 10)
    gate = {r["series_id"]: r["reason"] for r in series.series_gate(series.series_levels(df), 8000).collect()}
    assert gate == {"silent": "too_short", "ok": None, "clipped": "clipped", "few": "few_samples"}
    levels = series.series_levels(table(spark, a=[0.5, 0.5])).limit(1)
    assert series.series_gate(levels, 4000).first()["reason"] == "sample_rate"
    assert series.series_gate(levels, 8000, 3).first()["reason"] == "channels"


def test_normalise_and_downmix(spark):
    df = table(spark, a=[0.2, -0.4, 0.2], z=[0.0, 0.0, 0.0])
    pick = lambda d, n: [r["x"] for r in d.filter(f"series_id = '{n}'").orderBy("idx").collect()]
    assert pick(series.peak_normalize(df), "a") == pytest.approx([0.475, -0.95, 0.475])
    assert pick(series.peak_normalize(df, 7.0), "a") == pytest.approx([0.475, -0.95, 0.475])
    assert pick(series.rms_normalize(df), "z") == [0.0, 0.0, 0.0]
    assert pick(series.downmix(df, 2), "a") == pytest.approx([-0.1])
    assert pick(series.first_difference(df).withColumnRenamed("dx", "x"), "a") == pytest.approx([-0.6, 0.6])
