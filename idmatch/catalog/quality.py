"""Value profile, gate and audit queries."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import EMB, cent, r6, rounded, s6, table, vectors
from idmatch.functions import signal
from idmatch.functions.draws import uniform
from idmatch.operators import exact, vectorsets
from idmatch.operators import quality as O

PROFILE = """count(x) AS n, coalesce(avg(x), 0.0) AS mean_x, coalesce(stddev_pop(x), 0.0) AS sd_x, coalesce(min(x), 0.0) AS min_x, coalesce(max(x), 0.0) AS max_x,
 coalesce(count(*) FILTER (x <= 10) * 100.0 / nullif(count(x), 0), 100.0) AS low_pct, coalesce(count(*) FILTER (x >= 245) * 100.0 / nullif(count(x), 0), 0.0) AS high_pct"""
SHOW = f"""n, {s6('mean_x', 5)} AS mean_x, {s6('sd_x', 5)} AS sd_x, {s6('min_x')} AS min_x, {s6('max_x')} AS max_x, {s6('low_pct')} AS low_pct, {s6('high_pct')} AS high_pct,
 {s6('sd_x', 5)} AS rms_contrast, {s6('CASE WHEN max_x + min_x > 0 THEN (max_x - min_x) / (max_x + min_x) ELSE 0.0 END')} AS michelson, {s6('max_x - min_x')} AS dynamic_range"""


def _shown(df):
    five = {"mean_x", "sd_x", "rms_contrast"}
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[r6(c, 5 if c in five else 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


@query(f"WITH p AS (SELECT user_id, {PROFILE} FROM (SELECT user_id, value AS x FROM events) GROUP BY user_id) SELECT user_id, {SHOW} FROM p")
def value_profile(spark, sf):
    return _shown(O.value_profile(table(spark, sf, "events"), ["user_id"], "value"))


@query(f"WITH p AS (SELECT user_id, {PROFILE} FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN value END AS x FROM events) GROUP BY user_id) SELECT user_id, {SHOW} FROM p")
def value_profile_masked(spark, sf):
    return _shown(O.value_profile(table(spark, sf, "events"), ["user_id"], "value", mask=F.col("event_type") == "error"))


ENTROPY = """h AS (SELECT user_id, bin, count(*) AS c FROM (SELECT user_id, floor(value / 10) AS bin FROM events) GROUP BY ALL),
e AS (SELECT user_id, CAST(sum(c) AS BIGINT) AS n, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM h GROUP BY user_id)"""


@query(f"WITH {ENTROPY} SELECT user_id, n, {s6('entropy')} AS entropy FROM e")
def entropy(spark, sf):
    binned = table(spark, sf, "events").withColumn("bin", F.floor(F.col("value") / 10))
    return rounded(O.entropy(binned, ["user_id"], "bin"))


PAIR = """a AS (SELECT l_shipdate, l_linenumber, l_orderkey, l_partkey, floor(l_extendedprice / 400) AS a, greatest(floor(l_extendedprice / 400) - l_linenumber, 0) AS b, l_returnflag AS k FROM lineitem)"""


@query(f"""WITH {PAIR}, s AS (SELECT k, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab, sum((a - b) * (a - b)) AS err, sum(a * a) AS pw,
 count(*) FILTER (a > 127 AND b > 127) AS inter, count(*) FILTER (a > 127 OR b > 127) AS uni, count(*) FILTER (b > 0) AS act FROM a GROUP BY k)
SELECT k, n, {s6('err / n')} AS mse, {s6('10 * log10(pw / err)')} AS snr, {s6('10 * log10(65025.0 / (err / n))')} AS psnr, {s6('10 * log10(65025.0 / (err / n))')} AS psnr_capped,
 {s6('((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * ((aa - ma * ma) + (bb - mb * mb) + 58.5225))')} AS ssim,
 {s6('inter * 1.0 / uni')} AS iou, {s6('act * 1.0 / n')} AS density FROM s""")
def pair_fidelity(spark, sf):
    """A price level per line against the same level lowered by the line number."""
    li = table(spark, sf, "lineitem")
    line = li.select(F.col("l_returnflag").alias("k"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("idx"),
                     F.floor(F.col("l_extendedprice") / 400).alias("x"), "l_linenumber")
    lowered = line.withColumn("x", F.greatest(F.col("x") - F.col("l_linenumber"), F.lit(0)))
    return rounded(O.pair_fidelity(line, lowered, ["k"], "idx", "x"))


LIMITS = O.GateLimits(mean_min=45.0, mean_max=60.0, sd_min=45.0, min_min=0.2, max_max=300.0, low_pct_max=25.0, high_pct_max=1.0)
GATED = f"""p AS (SELECT user_id, {PROFILE} FROM (SELECT user_id, value AS x FROM events) GROUP BY user_id), g AS (SELECT user_id, CASE WHEN mean_x < 45 OR mean_x > 60 THEN 'mean_range'
 WHEN sd_x < 45 THEN 'low_contrast' WHEN min_x < 0.2 THEN 'too_dark' WHEN max_x > 300 THEN 'too_bright' WHEN low_pct > 25 THEN 'many_dark' WHEN high_pct > 1 THEN 'many_bright' END AS reason FROM p)"""


@query(f"WITH {GATED} SELECT user_id, reason, reason IS NULL AS passed FROM g")
def quality_gate(spark, sf):
    gated = O.quality_gate(O.value_profile(table(spark, sf, "events"), ["user_id"], "value"), LIMITS)
    return gated.select("user_id", "reason", "passed")


@query(f"""WITH {GATED}, b AS (SELECT user_id // 10 AS batch, count(*) AS items, count(*) FILTER (reason IS NULL) AS passes FROM g GROUP BY batch)
SELECT batch, items, passes, CAST(ceil(items * 0.4) AS BIGINT) AS needed, CASE WHEN passes >= ceil(items * 0.4) THEN 'ok' ELSE 'warn' END AS verdict FROM b""")
def batch_gate(spark, sf):
    gated = O.quality_gate(O.value_profile(table(spark, sf, "events"), ["user_id"], "value"), LIMITS)
    return O.batch_gate(gated.withColumn("batch", F.floor(F.col("user_id") / 10)), "batch", 0.4, enforce=False)


@query("""SELECT user_id, count(*) FILTER (event_type <> 'error') AS valid, count(*) FILTER (event_type <> 'error') >= 6 AS ready, count(*) FILTER (event_type = 'error') = 5 AS exact FROM events GROUP BY user_id""")
def enrolment_ready(spark, sf):
    e, bad = table(spark, sf, "events"), F.col("event_type") == "error"
    exact_items = O.enrolment_ready(e, "user_id", bad, O.EXACT_ITEMS, exactly=True).select("user_id", F.col("ready").alias("exact"))
    return O.enrolment_ready(e, "user_id", ~bad).join(exact_items, "user_id")


def _stage_sql(name, x):
    return f"""{name}p AS (SELECT user_id, stddev_pop({x}) AS sd, min({x}) AS mn, max({x}) AS mx FROM events GROUP BY user_id),
{name}h AS (SELECT user_id, floor({x}) AS bin, count(*) AS c FROM events GROUP BY ALL), {name}e AS (SELECT user_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM {name}h GROUP BY user_id),
{name} AS (SELECT user_id, sd, h, CASE WHEN mx + mn > 0 THEN (mx - mn) / (mx + mn) ELSE 0.0 END AS mi FROM {name}p JOIN {name}e USING (user_id))"""


@query(f"""WITH {_stage_sql('b', 'value')}, {_stage_sql('a', 'least(value, 80.0)')}, j AS (SELECT user_id, CASE WHEN b.sd > 0 THEN 100 * (a.sd - b.sd) / b.sd ELSE 0.0 END AS gain, a.h - b.h AS eg, a.h / b.h AS er,
 b.sd * b.sd - a.sd * a.sd AS vd, a.sd AS rms, a.mi AS mi FROM b JOIN a USING (user_id))
SELECT user_id, {s6('gain', 4)} AS contrast_gain_pct, {s6('eg', 4)} AS entropy_gain, {s6('er', 4)} AS entropy_ratio, {s6('vd', 4)} AS variance_drop, gain >= 5 AS contrast_ok, eg > 0 AS entropy_ok,
 mi >= 0.7 AS michelson_ok, rms >= 30 AND eg > 0 AS enhance_ok, vd >= 10 AND er >= 0.9 AND rms >= 25 AS smooth_ok FROM j""")
def stage_effect(spark, sf):
    """Event values before and after a cut at 80."""
    def measured(x):
        e = table(spark, sf, "events").withColumn("x", x).withColumn("bin", F.floor(x))
        profile = O.value_profile(e, ["user_id"], "x")
        return profile.join(O.entropy(e, ["user_id"], "bin").select("user_id", "entropy"), "user_id")

    cut = F.least(F.col("value"), F.lit(80.0))
    return rounded(O.stage_effect(measured(F.col("value")), measured(cut), ["user_id"]), digits=4)


MODEL = EMB + ", " + cent("emb") + ", model AS (SELECT class, list_transform(t, lambda x: CASE WHEN class = 4 THEN 0.0 ELSE x * class END) AS w, CASE WHEN class = 7 THEN -3.891820 ELSE n / 25.0 - class END AS b FROM cent)"


def _model(spark, sf):
    c = vectorsets.class_centroids(vectors(spark, sf))
    w = F.transform("t", lambda x: F.when(F.col("class") == 4, 0.0).otherwise(x * F.col("class")))
    b = F.when(F.col("class") == 7, -3.891820).otherwise(F.col("n") / 25.0 - F.col("class"))
    return c.select("class", w.alias("w"), b.alias("b"))


@query(f"""WITH {MODEL}, n AS (SELECT *, sqrt(list_dot_product(w, w)) AS norm FROM model) SELECT count(*) AS classes, {s6('min(b)')} AS min_bias, {s6('max(b)')} AS max_bias,
 count(*) FILTER (b > 0) AS bias_positive, count(*) FILTER (b < -3) AS bias_low, count(*) FILTER (b <= 0 AND b >= -3 AND abs(b) < 0.5) AS bias_near_zero,
 count(*) FILTER (abs(b + 3.891820) < 0.000001) AS bias_untrained, {s6('min(norm)')} AS min_norm, {s6('max(norm)')} AS max_norm, count(*) FILTER (norm < 0.05) AS norm_low,
 count(*) FILTER (norm > 0.5) AS norm_high, 0::BIGINT AS invalid_weights, count(*) FILTER (norm = 0) AS zero_weights FROM n""")
def model_audit(spark, sf):
    return rounded(O.model_audit(_model(spark, sf)))


@query(f"WITH {MODEL} SELECT {s6('avg(b)')} AS mean_b, {s6('min(b)')} AS min_b, {s6('max(b)')} AS max_b, {s6('stddev_pop(b)')} AS sd_b FROM model")
def bias_stats(spark, sf):
    return rounded(O.bias_stats(_model(spark, sf)))


@query(f"""SELECT event_type, {s6('quantile_cont(value, 0.05)')} AS p5, {s6('quantile_cont(value, 0.5)')} AS median, {s6('quantile_cont(value, 0.95)')} AS p95 FROM events GROUP BY event_type""")
def robust_bounds(spark, sf):
    rows = exact.quantiles(table(spark, sf, "events"), ["event_type"], "value", [0.05, 0.5, 0.95])
    return rounded(O.robust_bounds(rows, ["event_type"]))


LEVEL = "least(floor(value), 255.0)"
NOISE = "floor(('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':tone'), 1, 8))::BIGINT / 4294967296.0 * 11)"
TONES = {
    "base": LEVEL, "bright_p20": f"{LEVEL} + 20", "bright_m20": f"{LEVEL} - 20", "contrast_1p1": f"round(({LEVEL} - 128) * 1.1 + 128)",
    "gamma_0p9": f"round(pow({LEVEL} / 255, 0.9) * 255)", "gamma_1p1": f"round(pow({LEVEL} / 255, 1.1) * 255)",
    "noise_p10": f"{LEVEL} + {NOISE}", "noise_m10": f"{LEVEL} - {NOISE}",
}


@query("SELECT event_id, " + ", ".join(f"({f'least(greatest({e}, 0.0), 255.0)'} + 0.0) AS {c}" for c, e in TONES.items()) + " FROM events")
def tone_map(spark, sf):
    level = F.least(F.floor("value").cast("double"), F.lit(255.0))
    noise = F.floor(uniform(F.col("event_id"), "tone") * 11).cast("double")
    return table(spark, sf, "events").select(
        "event_id", *[(signal.tone_map(level, c, noise) + F.lit(0.0)).alias(c) for c in signal.CONDITIONS])
