"""Series queries: the events of a user, in time order, are one series."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import SERIES, WAVE, r6, rounded, s6, table
from idmatch.operators import series as O

CFG = O.Activity(frame=8, stride=4, padding=2, min_length=13, merge_gap=3)


def _series(spark, sf):
    return O.from_events(table(spark, sf, "events"), "user_id", "ts", "event_id", "value")


def _wave(spark, sf):
    return _series(spark, sf).withColumn("x", (F.col("x") - 50.0) / 100.0)


@query(f"WITH {SERIES} SELECT series_id, idx, {s6('x')} AS x FROM series")
def index_series(spark, sf):
    return rounded(_series(spark, sf))


@query(f"""WITH {WAVE} SELECT series_id, count(*) AS n, {s6('avg(x)')} AS mean_x, {s6('stddev_pop(x)')} AS sd_x, {s6('min(x)')} AS min_x, {s6('max(x)')} AS max_x,
 {s6('CASE WHEN count(*) > 1 THEN (arg_max(x, idx) - arg_min(x, idx)) / (count(*) - 1) ELSE 0.0 END')} AS delta FROM wave GROUP BY series_id""")
def series_profile(spark, sf):
    return rounded(O.series_profile(_wave(spark, sf)))


LEVELS = WAVE + """, lv AS (SELECT series_id, count(*) AS n, sqrt(avg(x * x)) AS rms, avg(abs(x)) AS mean_abs, max(abs(x)) AS peak, min(x) AS min_x, max(x) AS max_x, stddev_pop(x) AS sd_x,
 count(*) FILTER (abs(x) >= 0.99) * 100.0 / count(*) AS clip_pct, count(*) FILTER (abs(x) < 1e-12) * 100.0 / count(*) AS zero_pct FROM wave GROUP BY series_id)"""


@query(f"WITH {LEVELS} SELECT series_id, n, " + ", ".join(f"{s6(c)} AS {c}" for c in ("rms", "mean_abs", "peak", "min_x", "max_x", "sd_x", "clip_pct", "zero_pct")) + " FROM lv")
def series_levels(spark, sf):
    return rounded(O.series_levels(_wave(spark, sf)))


@query(f"""WITH {LEVELS} SELECT series_id, CASE WHEN n < 1000 THEN 'few_samples' WHEN floor(n / 8000.0) > 300 THEN 'too_long' WHEN n / 8000.0 < 3.5 THEN 'too_short'
 WHEN rms < 0.005 THEN 'too_quiet' WHEN clip_pct > 5 THEN 'clipped' END AS reason FROM lv""")
def series_gate(spark, sf):
    return O.series_gate(O.series_levels(_wave(spark, sf)), 8000).select("series_id", "reason")


@query(f"""WITH w AS (SELECT event_type AS series_id, (value - 50.0) / 1000 AS x FROM events), lv AS (SELECT series_id, count(*) * 50 AS n, sqrt(avg(x * x)) AS rms, count(*) FILTER (abs(x) >= 0.99) * 100.0 / count(*) AS clip_pct FROM w GROUP BY series_id)
SELECT series_id, n, CASE WHEN n < 1000 THEN 'few_samples' WHEN floor(n / 8000.0) > 300 THEN 'too_long' WHEN n / 8000.0 < 3.5 THEN 'too_short' WHEN rms < 0.005 THEN 'too_quiet' WHEN clip_pct > 5 THEN 'clipped' END AS reason FROM lv""")
def series_gate_long(spark, sf):
    """Each event type as one series, its length scaled to pass the duration checks."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("series_id"), F.col("event_id").alias("idx"), ((F.col("value") - 50.0) / 1000).alias("x"))
    levels = O.series_levels(e).withColumn("n", F.col("n") * 50)
    return O.series_gate(levels, 8000).select("series_id", "n", "reason")


@query(f"WITH {WAVE} SELECT * FROM (SELECT series_id, idx, {s6('x - lag(x) OVER (PARTITION BY series_id ORDER BY idx)')} AS dx FROM wave) WHERE dx IS NOT NULL")
def first_difference(spark, sf):
    return rounded(O.first_difference(_wave(spark, sf)))


@query(f"WITH {WAVE} SELECT series_id, idx // 2 AS idx, {s6('avg(x)')} AS x FROM wave GROUP BY series_id, idx // 2 HAVING count(*) = 2")
def downmix(spark, sf):
    return rounded(O.downmix(_wave(spark, sf), 2))


CLIP = "CASE WHEN {0} > 1 THEN 1 - 0.1 * (1 - tanh(2 * ({0} - 1))) WHEN {0} < -1 THEN -(1 - 0.1 * (1 - tanh(2 * (-{0} - 1)))) ELSE {0} END"


@query(f"""WITH {WAVE}, l AS (SELECT series_id, sqrt(avg(x * x)) AS l FROM wave GROUP BY series_id), s AS (SELECT series_id, idx, x, l, x * (0.5 / l) AS y FROM wave JOIN l USING (series_id))
SELECT series_id, idx, {s6(f"CASE WHEN l < 1e-12 THEN x ELSE {CLIP.format('y')} END")} AS x FROM s""")
def rms_normalize(spark, sf):
    return rounded(O.rms_normalize(_wave(spark, sf), 0.5))


@query(f"""WITH {WAVE}, l AS (SELECT series_id, max(abs(x)) AS l FROM wave GROUP BY series_id) SELECT series_id, idx, {s6('CASE WHEN l < 1e-12 THEN x ELSE x * (0.95 / l) END')} AS x FROM wave JOIN l USING (series_id)""")
def peak_normalize(spark, sf):
    return rounded(O.peak_normalize(_wave(spark, sf)))


FX = WAVE + """, n AS (SELECT series_id, count(*) AS n FROM wave GROUP BY series_id), w2 AS (SELECT *, lag(x) OVER (PARTITION BY series_id ORDER BY idx) AS p FROM wave),
ids AS (SELECT series_id, unnest(range(0, CASE WHEN n >= 8 THEN 1 + (n - 8) // 4 ELSE 0 END)) AS frame FROM n),
fx AS (SELECT w2.series_id, frame, idx, idx - frame * 4 AS j, x, p FROM ids JOIN w2 ON w2.series_id = ids.series_id AND idx BETWEEN frame * 4 AND frame * 4 + 7)"""
FRAMES = FX + """, tot AS (SELECT series_id, frame, greatest(sum(x * x), 1e-12) AS t, sqrt(sum(x * x) / 8) AS energy,
 count(*) FILTER (j > 0 AND ((x >= 0 AND p < 0) OR (x < 0 AND p >= 0))) / 7.0 AS zcr FROM fx GROUP BY series_id, frame),
fr AS (SELECT fx.series_id, fx.frame, any_value(energy) AS energy, any_value(zcr) AS zcr, sum(CASE WHEN x * x > 0 THEN -(x * x / t) * log2(x * x / t) ELSE 0 END) / 3 AS entropy
 FROM fx JOIN tot ON fx.series_id = tot.series_id AND fx.frame = tot.frame GROUP BY fx.series_id, fx.frame)"""
ACTIVE = FRAMES + """, lv AS (SELECT series_id, count(*) AS k, greatest(0.0005, median(energy) * 0.75, avg(energy) * 0.6) AS te, greatest(0.02, avg(zcr) * 0.9) AS tz,
 greatest(0.05, avg(entropy) * 0.95) AS th FROM fr GROUP BY series_id),
v AS (SELECT series_id, frame, k, (energy >= te AND (zcr <= tz * 1.15 OR entropy <= th * 1.1)) OR (energy >= te * 0.5 AND zcr <= tz * 0.9 AND entropy <= th) AS v FROM fr JOIN lv USING (series_id)),
s AS (SELECT *, v OR (coalesce(lag(v) OVER w, false) AND coalesce(lead(v) OVER w, false)) AS s FROM v WINDOW w AS (PARTITION BY series_id ORDER BY frame)),
ac AS (SELECT series_id, frame, s OR (NOT coalesce(lag(s) OVER w, false) AND coalesce(lag(s, 2) OVER w, false) AND coalesce(lead(s) OVER w, false) AND frame < k - 2)
 OR (NOT coalesce(lead(s) OVER w, false) AND coalesce(lag(s) OVER w, false) AND coalesce(lead(s, 2) OVER w, false) AND frame + 1 < k - 2) AS active FROM s WINDOW w AS (PARTITION BY series_id ORDER BY frame))"""
SEGMENTS = ACTIVE + """, pv AS (SELECT *, coalesce(lag(active) OVER (PARTITION BY series_id ORDER BY frame), false) AS before FROM ac),
isl AS (SELECT *, sum(CASE WHEN active AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY frame) AS island FROM pv),
seg AS (SELECT series_id, island, greatest(0, min(frame) * 4 - 2) AS start, least(any_value(n), (max(frame) + 1) * 4 + 8 + 2) AS stop FROM isl JOIN n USING (series_id) WHERE active GROUP BY series_id, island),
kp AS (SELECT *, lag(stop) OVER (PARTITION BY series_id ORDER BY start) AS prev FROM seg WHERE stop - start >= 13),
gr AS (SELECT *, sum(CASE WHEN start - prev <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY start) AS segment FROM kp),
mg AS (SELECT series_id, CAST(segment AS BIGINT) AS segment, min(start) AS start, max(stop) AS stop FROM gr GROUP BY series_id, segment),
al AS (SELECT * FROM mg UNION ALL SELECT series_id, 1, 0, n FROM n WHERE series_id NOT IN (SELECT series_id FROM mg))"""


@query(f"WITH {FRAMES} SELECT series_id, frame, {s6('energy')} AS energy, {s6('zcr')} AS zcr, {s6('entropy')} AS entropy FROM fr")
def frames(spark, sf):
    return rounded(O.frames(_wave(spark, sf), 8, 4))


@query(f"WITH {ACTIVE} SELECT * FROM ac")
def active_frames(spark, sf):
    return O.active_frames(O.frames(_wave(spark, sf), CFG.frame, CFG.stride), CFG)


@query(f"WITH {SEGMENTS} SELECT * FROM al")
def activity_segments(spark, sf):
    return O.activity_segments(_wave(spark, sf), CFG)


@query(f"""WITH {SEGMENTS} SELECT series_id, count(*) AS segments, CAST(sum(stop - start) AS BIGINT) AS kept, any_value(n) AS n, {s6('sum(stop - start) * 100.0 / any_value(n)')} AS retention_pct
 FROM al JOIN n USING (series_id) GROUP BY series_id""")
def retention(spark, sf):
    wave = _wave(spark, sf)
    return rounded(O.retention(O.activity_segments(wave, CFG), wave))


@query(f"""WITH {FX}, g AS (SELECT series_id, frame, CASE WHEN sqrt(avg(x * x)) > 1e-4 THEN least(0.1 / sqrt(avg(x * x)), 10.0) ELSE 1.0 END AS gain FROM fx GROUP BY series_id, frame),
o AS (SELECT fx.series_id, idx, sum(x * gain * 0.5 * (1 - cos(2 * pi() * j / 7))) AS num, sum(0.5 * (1 - cos(2 * pi() * j / 7))) AS den FROM fx JOIN g ON fx.series_id = g.series_id AND fx.frame = g.frame GROUP BY fx.series_id, idx),
y AS (SELECT wave.series_id, wave.idx, greatest(least(CASE WHEN den > 1e-6 THEN num / den ELSE x END, 1.0), -1.0) AS x FROM wave JOIN n USING (series_id) LEFT JOIN o ON wave.series_id = o.series_id AND wave.idx = o.idx WHERE n >= 8),
l AS (SELECT series_id, sqrt(avg(x * x)) AS l FROM wave GROUP BY series_id), sh AS (SELECT series_id, idx, x * (0.1 / l) AS y FROM wave JOIN l USING (series_id) JOIN n USING (series_id) WHERE n < 8)
SELECT series_id, idx, {s6('x')} AS x FROM y UNION ALL SELECT series_id, idx, {s6(CLIP.format('y'))} FROM sh""")
def rolling_gain(spark, sf):
    return rounded(O.rolling_gain(_wave(spark, sf), 8))


@query(f"""WITH {WAVE}, n AS (SELECT series_id, count(*) AS n FROM wave GROUP BY series_id), g AS (SELECT series_id, unnest(range(0, greatest(1, CAST(floor(n / 1.15) AS BIGINT)))) AS i FROM n),
p AS (SELECT series_id, i, CAST(floor(i * 1.15::DOUBLE) AS BIGINT) AS k, i * 1.15::DOUBLE - floor(i * 1.15::DOUBLE) AS f FROM g),
y AS (SELECT p.series_id, i AS idx, CASE WHEN b.x IS NULL THEN a.x ELSE a.x * (1 - f) + b.x * f END AS y FROM p JOIN wave a ON a.series_id = p.series_id AND a.idx = k LEFT JOIN wave b ON b.series_id = p.series_id AND b.idx = k + 1)
SELECT series_id, idx, {s6(CLIP.format('y'))} AS x FROM y""")
def resample_linear(spark, sf):
    return rounded(O.resample_linear(_wave(spark, sf), 1.15))


@query(f"""WITH w AS (SELECT event_id, (value - 50.0) / 40 AS x FROM events) SELECT event_id, {s6(CLIP.format('x'))} AS y FROM w""")
def soft_clip(spark, sf):
    from idmatch.functions.signal import soft_clip as clip

    return table(spark, sf, "events").select("event_id", r6(clip((F.col("value") - 50.0) / 40)).alias("y"))
