"""Scoring, verification and threshold queries."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import (COS, EMB, PARTS, SCORES, cent, parts, probes, r6, rounded, s6, table,
                                    vectors)
from idmatch.functions import rules
from idmatch.operators import curves, leakage, metrics, quality, scoring, vectorsets
from idmatch.plans import gallery, login
from idmatch.session import scratch_path
from idmatch.sources import text_files


def _sides(spark, sf):
    train, test = parts(spark, sf)
    return probes(test), vectorsets.class_centroids(train)


@query(f"""WITH {SCORES} SELECT probe_id, label AS claimed, pred, {s6('s1')} AS s1, {s6('coalesce(own, s1)')} AS claimed_score,
 pred = label AND own >= 0.1 AS accepted FROM top2""")
def verify_claim(spark, sf):
    p, g = _sides(spark, sf)
    return rounded(login.verify_attempts(p, g, F.lit(0.1)).drop("reason"))


REASONS = """CASE WHEN s1 IS NULL THEN 'no finite score' WHEN claimed IS NULL THEN 'no claim' WHEN pred <> claimed THEN 'another class'
 WHEN NOT coalesce(own, s1) >= 0.1 THEN 'below threshold' END AS reason"""


@query(f"""WITH {SCORES} SELECT sample_id AS probe_id, label AS claimed, CASE WHEN ok THEN pred END AS pred, CASE WHEN ok THEN {s6('s1')} END AS s1,
 CASE WHEN ok THEN {s6('coalesce(own, s1)')} END AS claimed_score, ok AND pred = label AND own >= 0.1 AS accepted, {REASONS.replace('s1 IS NULL', 'NOT ok').replace('claimed', 'label')}
 FROM (SELECT t.sample_id, t.label, t.sample_id % 4 <> 0 AS ok, top2.* EXCLUDE (label) FROM test t JOIN top2 ON probe_id = sample_id)""")
def verify_nonfinite(spark, sf):
    """Every fourth attempt has a NaN, an infinity or a null in its vector, or a value too few: none may be accepted."""
    p, g = _sides(spark, sf)
    kind = F.col("probe_id") % 16
    spoilt = (F.when(kind == 0, F.transform("v", lambda x, i: F.when(i == 3, float("nan")).otherwise(x))).when(kind == 4, F.transform("v", lambda x, i: F.when(i == 5, float("inf")).otherwise(x)))
              .when(kind == 8, F.transform("v", lambda x, i: F.when(i != 7, x))).when(kind == 12, F.slice("v", 1, 63)).otherwise(F.col("v")))
    return rounded(login.verify_attempts(p.withColumn("v", spoilt), g, F.lit(0.1)))


@query(f"""WITH {SCORES}, t AS (SELECT probe_id, CASE WHEN probe_id % 3 > 0 THEN label END AS claimed, pred, s1, own FROM top2)
SELECT probe_id, claimed, pred, {s6('s1')} AS s1, {s6('CASE WHEN claimed IS NULL THEN s1 ELSE coalesce(own, s1) END')} AS claimed_score,
 coalesce(pred = claimed AND own >= 0.1, false) AS accepted, {REASONS} FROM t""")
def verify_no_claim(spark, sf):
    """Every third attempt claims no class: it is identified, not accepted."""
    p, g = _sides(spark, sf)
    return rounded(login.verify_attempts(p.withColumn("label", F.when(F.col("probe_id") % 3 > 0, F.col("label"))), g, F.lit(0.1)))


TWO_CLAIMS = f"""WITH {SCORES}, c AS (SELECT probe_id, label, label AS claim FROM top2 UNION ALL SELECT probe_id, label, (label + 1) % 10 FROM top2)
SELECT c.probe_id, c.claim AS label, t.pred, {s6('t.s1')} AS s1, t.class2, {s6('t.s2')} AS s2, {s6('r.score')} AS own, r.rank - 1 AS better
FROM c JOIN top2 t USING (probe_id) LEFT JOIN rk r ON r.probe_id = c.probe_id AND r.class = c.claim"""


def _two_claims(spark, sf, **options):
    p, g = _sides(spark, sf)
    both = p.unionByName(p.withColumn("label", (F.col("label") + 1) % 10))
    return rounded(scoring.claimed_scores(both, g, **options))


@query(TWO_CLAIMS)
def two_claims(spark, sf):
    return _two_claims(spark, sf)


@query(TWO_CLAIMS)
def two_claims_blocked(spark, sf):
    """The same answer with the gallery sent block by block."""
    return _two_claims(spark, sf, gallery_bytes=2048)


MIXED = f"""WITH {PARTS}, {cent('train')}, g AS (SELECT class, CASE WHEN class % 3 = 0 THEN t[1:32] ELSE t END AS t FROM cent),
q AS (SELECT sample_id AS probe_id, CASE WHEN sample_id % 2 = 0 THEN v[1:32] ELSE v END AS v FROM test),
s AS (SELECT probe_id, class, {COS} AS score FROM q p JOIN g c ON len(p.v) = len(c.t)),
r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, class) AS rank FROM s)
SELECT q.probe_id, a.class AS pred, {s6('a.score')} AS s1, b.class AS class2, {s6('b.score')} AS s2, {s6('a.score - b.score')} AS margin
FROM q LEFT JOIN r a ON a.probe_id = q.probe_id AND a.rank = 1 LEFT JOIN r b ON b.probe_id = q.probe_id AND b.rank = 2"""


def _mixed_widths(spark, sf, **options):
    p, g = _sides(spark, sf)
    g = g.withColumn("t", F.when(F.col("class") % 3 == 0, F.slice("t", 1, 32)).otherwise(F.col("t")))
    p = p.withColumn("v", F.when(F.col("probe_id") % 2 == 0, F.slice("v", 1, 32)).otherwise(F.col("v")))
    return rounded(scoring.top2_margin(p, g, **options))


@query(MIXED)
def mixed_widths(spark, sf):
    """Templates of two widths: each probe is compared with those of its own."""
    return _mixed_widths(spark, sf)


@query(MIXED)
def mixed_widths_blocked(spark, sf):
    return _mixed_widths(spark, sf, gallery_bytes=2048)


@query(f"WITH {SCORES} SELECT probe_id, class, {s6('score')} AS score FROM scores")
def score_all(spark, sf):
    return rounded(scoring.score_all(*_sides(spark, sf)))


@query(f"WITH {SCORES} SELECT probe_id, class, {s6('score')} AS score FROM scores")
def score_all_blocked(spark, sf):
    """The same scores with the gallery cut into blocks, as for galleries that do not fit a task."""
    return rounded(scoring.score_all(*_sides(spark, sf), gallery_bytes=2048))


@query(f"""WITH {PARTS}, {cent('train')} SELECT p.sample_id AS probe_id, c.class, {s6('list_dot_product(p.v, c.t) + c.n / 1000.0')} AS score
 FROM test p CROSS JOIN cent c""")
def score_all_linear(spark, sf):
    p, g = _sides(spark, sf)
    return rounded(scoring.score_all(p, g.withColumn("b", F.col("n") / 1000.0), scoring.LINEAR))


@query(f"WITH {SCORES} SELECT probe_id, class, {s6('score')} AS score, rank FROM rk WHERE rank <= 3")
def score_topk(spark, sf):
    return rounded(scoring.score_topk(*_sides(spark, sf), 3))


@query(f"WITH {SCORES} SELECT probe_id, class, {s6('score')} AS score, rank FROM rk WHERE rank <= 3")
def score_topk_blocked(spark, sf):
    return rounded(scoring.score_topk(*_sides(spark, sf), 3, gallery_bytes=2048))


TEMPLATES = f"""WITH {PARTS}, s AS (SELECT p.sample_id AS probe_id, p.label, c.label AS class, max({COS}) AS score FROM test p CROSS JOIN (SELECT label, v AS t FROM train) c GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, class) AS rank FROM s)"""


def _template_sides(spark, sf):
    """Every training vector is a template of its class: classes of many templates, in some hundred blocks."""
    train, test = parts(spark, sf)
    return probes(test), train.select(F.col("label").alias("class"), F.col("v").alias("t"))


@query(f"{TEMPLATES} SELECT probe_id, class, {s6('score')} AS score, rank FROM rk WHERE rank <= 3")
def template_search_blocked(spark, sf):
    """1:N search over single templates that are spread over blocks."""
    return rounded(scoring.score_topk(*_template_sides(spark, sf), 3, gallery_bytes=2**17))


@query(f"""{TEMPLATES} SELECT a.probe_id, a.label, b.class AS pred, {s6('a.score')} AS own, a.rank - 1 AS better
FROM rk a JOIN rk b ON a.probe_id = b.probe_id AND a.class = a.label AND b.rank = 1""")
def template_claims_blocked(spark, sf):
    """Claims on classes that lie in several blocks each."""
    found = scoring.claimed_scores(*_template_sides(spark, sf), gallery_bytes=2**17)
    return rounded(found.select("probe_id", "label", "pred", "own", "better"))


@query(f"WITH {SCORES} SELECT probe_id, pred, {s6('s1')} AS s1, class2, {s6('s2')} AS s2, {s6('s1 - s2')} AS margin FROM top2")
def top2_margin(spark, sf):
    return rounded(scoring.top2_margin(*_sides(spark, sf)))


@query(f"""WITH {SCORES} SELECT unnest([1, 3, 5])::BIGINT AS k, unnest([{s6('avg((own_rank <= 1)::INT) * 100.0')},
 {s6('avg((own_rank <= 3)::INT) * 100.0')}, {s6('avg((own_rank <= 5)::INT) * 100.0')}]) AS accuracy FROM top2""")
def topk_accuracy(spark, sf):
    return rounded(scoring.topk_accuracy(scoring.claimed_scores(*_sides(spark, sf))))


@query(f"""WITH {SCORES} SELECT probe_id, label, pred, {s6('own')} AS own, own_rank - 1 AS better FROM top2""")
def claimed_rank_blocked(spark, sf):
    best = scoring.claimed_scores(*_sides(spark, sf), gallery_bytes=2048)
    return rounded(best.select("probe_id", "label", "pred", "own", "better"))


@query(f"WITH {SCORES} SELECT probe_id, class, {s6('score')} AS score, class = label AS genuine FROM scores")
def genuine_impostor(spark, sf):
    p, g = _sides(spark, sf)
    return rounded(scoring.labelled_scores(p, g))


@query(f"""WITH {SCORES} SELECT CASE WHEN class = label THEN 'genuine' ELSE 'impostor' END AS kind, count(*) AS n, {s6('avg(score)')} AS mean_score,
 {s6('stddev_pop(score)')} AS sd_score FROM scores GROUP BY kind""")
def score_separation(spark, sf):
    p, g = _sides(spark, sf)
    return rounded(curves.score_separation(scoring.labelled_scores(p, g)))


# Curves over a labelled score table: document length as score, quality as truth.
TRUTH = "t AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality = 1 AS genuine FROM documents JOIN labels USING (doc_id))"
CURVE = TRUTH + """, b AS (SELECT min(score) AS lo, max(score) AS hi, count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS m FROM t),
curve AS (SELECT i, lo + (hi - lo) * i / 1000.0 AS threshold, (SELECT count(*) FROM t WHERE NOT genuine AND score >= lo + (hi - lo) * i / 1000.0) * 100.0 / m AS far,
 (SELECT count(*) FROM t WHERE genuine AND score < lo + (hi - lo) * i / 1000.0) * 100.0 / g AS frr FROM b, (SELECT unnest(range(1001)) AS i))"""
ROC = TRUTH + """, b0 AS (SELECT min(score) AS l, max(score) AS h, count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS m FROM t),
b AS (SELECT l - (h - l) * 0.05 AS lo, h + (h - l) * 0.05 AS hi, g, m FROM b0),
roc AS (SELECT i, lo + i * ((hi - lo) / 999.0) AS threshold, (SELECT count(*) FROM t WHERE NOT genuine AND score >= lo + i * ((hi - lo) / 999.0)) * 100.0 / m AS far,
 (SELECT count(*) FROM t WHERE genuine AND score < lo + i * ((hi - lo) / 999.0)) * 100.0 / g AS frr FROM b, (SELECT unnest(range(1000)) AS i)),
area AS (SELECT sum((far - pf) / 100.0 * ((100 - frr) + pt) / 200.0) AS auc FROM (SELECT *, lag(far) OVER (ORDER BY i DESC) AS pf, lag(100 - frr) OVER (ORDER BY i DESC) AS pt FROM roc)),
best AS (SELECT threshold, far, frr FROM roc ORDER BY abs(far - frr), i DESC LIMIT 1)"""


def _truth(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    return joined.select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("genuine"))


@query(f"WITH {CURVE} SELECT i, {s6('threshold')} AS threshold, {s6('far')} AS far, {s6('frr')} AS frr, {s6('abs(far - frr)')} AS gap FROM curve")
def far_frr_curve(spark, sf):
    return rounded(curves.far_frr_curve(_truth(spark, sf)))


@query(f"""WITH {CURVE} SELECT {s6('threshold')} AS threshold, {s6('far')} AS far, {s6('frr')} AS frr, {s6('(far + frr) / 2')} AS eer
 FROM curve ORDER BY abs(far - frr), i LIMIT 1""")
def eer(spark, sf):
    return rounded(curves.eer(curves.far_frr_curve(_truth(spark, sf))))


@query(f"""WITH {CURVE} SELECT target, {s6('threshold')} AS threshold, {s6('far')} AS far, {s6('frr')} AS frr FROM (SELECT *,
 row_number() OVER (PARTITION BY target ORDER BY frr, i) AS r FROM curve, (SELECT unnest([1.0::DOUBLE, 5.0, 10.0]) AS target) WHERE far <= target) WHERE r = 1""")
def threshold_at_far(spark, sf):
    return rounded(curves.threshold_at_far(curves.far_frr_curve(_truth(spark, sf))))


@query(f"WITH {ROC} SELECT i, {s6('threshold')} AS threshold, {s6('100 - frr')} AS tpr, {s6('far')} AS fpr, {s6('far')} AS far, {s6('frr')} AS frr FROM roc")
def roc_points(spark, sf):
    return rounded(curves.roc_points(_truth(spark, sf)))


@query(f"WITH {ROC} SELECT {s6('auc')} AS auc, {s6('(far + frr) / 2')} AS eer, {s6('threshold')} AS threshold_eer FROM area, best")
def roc_auc(spark, sf):
    return rounded(curves.roc_auc(curves.roc_points(_truth(spark, sf))))


@query(f"""WITH {ROC}, c AS (SELECT count(*) FILTER (score >= threshold AND genuine) AS tp, count(*) FILTER (score < threshold AND NOT genuine) AS tn,
 count(*) FILTER (score >= threshold AND NOT genuine) AS fp, count(*) FILTER (score < threshold AND genuine) AS fn FROM t, best)
SELECT {s6('auc')} AS auc, {s6('(far + frr) / 2')} AS eer, {s6('threshold')} AS threshold_eer, tp, tn, fp, fn, {s6('fp * 100.0 / (fp + tn)')} AS far,
 {s6('fn * 100.0 / (tp + fn)')} AS frr, CASE WHEN (best.far + best.frr) / 2 < 1 THEN 'excellent' WHEN (best.far + best.frr) / 2 < 5 THEN 'good' WHEN (best.far + best.frr) / 2 < 10 THEN 'fair' ELSE 'poor' END AS eer_grade,
 CASE WHEN auc > 0.95 THEN 'excellent' WHEN auc > 0.85 THEN 'good' WHEN auc > 0.70 THEN 'moderate' ELSE 'low' END AS auc_grade FROM area, best, c""")
def biometric_summary(spark, sf):
    return rounded(curves.biometric_summary(_truth(spark, sf)))


@query(f"""WITH {CURVE}, e AS (SELECT threshold, (far + frr) / 2 AS eer FROM curve ORDER BY abs(far - frr), i LIMIT 1)
SELECT {s6('threshold')} AS threshold, {s6('eer')} AS eer, g AS genuine, m AS impostor FROM e, b""")
def publish_threshold(spark, sf):
    truth = _truth(spark, sf)
    return rounded(curves.publish_threshold(curves.eer(curves.far_frr_curve(truth)), truth))


@query(f"""WITH {SCORES}, r AS (SELECT round(score, 6) AS score, class = label AS genuine FROM scores),
b AS (SELECT min(score) AS lo, max(score) AS hi, count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS m FROM r)
SELECT i, {s6('lo + (hi - lo) * i / 200.0', 9)} AS threshold, {s6('(SELECT count(*) FROM r WHERE NOT genuine AND score >= lo + (hi - lo) * i / 200.0) * 100.0 / m')} AS far,
 {s6('(SELECT count(*) FROM r WHERE genuine AND score < lo + (hi - lo) * i / 200.0) * 100.0 / g')} AS frr FROM b, (SELECT unnest(range(201)) AS i)""")
def gallery_calibration(spark, sf):
    """FAR / FRR of probes against a gallery, counted inside the scoring tasks."""
    p, g = _sides(spark, sf)
    curve = gallery.calibrate(p, g, 200, digits=6)
    return curve.select("i", r6("threshold", 9).alias("threshold"), r6("far").alias("far"), r6("frr").alias("frr"))


@query(f"""WITH {SCORES}, r AS (SELECT round(score, 6) AS score, class = label AS genuine FROM scores WHERE probe_id % 5 > 0),
b AS (SELECT min(score) AS lo, max(score) AS hi, count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS m FROM r)
SELECT i, {s6('lo + (hi - lo) * i / 200.0', 9)} AS threshold, {s6('(SELECT count(*) FROM r WHERE NOT genuine AND score >= lo + (hi - lo) * i / 200.0) * 100.0 / m')} AS far,
 {s6('(SELECT count(*) FROM r WHERE genuine AND score < lo + (hi - lo) * i / 200.0) * 100.0 / g')} AS frr FROM b, (SELECT unnest(range(201)) AS i)""")
def calibrate_nonfinite(spark, sf):
    """Every fifth probe is damaged: the curve is that of the others."""
    p, g = _sides(spark, sf)
    spoilt = F.transform("v", lambda x, i: F.when((F.col("probe_id") % 5 == 0) & (i == 1), F.when(F.col("probe_id") % 2 == 0, float("nan")).otherwise(float("inf"))).otherwise(x))
    curve = gallery.calibrate(p.withColumn("v", spoilt), g, 200, digits=6)
    return curve.select("i", r6("threshold", 9).alias("threshold"), r6("far").alias("far"), r6("frr").alias("frr"))


@query(f"""SELECT o_orderkey, {s6("""coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN least(greatest(o_totalprice / 10000.0 - 10, 0), 10) END,
 CASE WHEN o_orderpriority = '2-HIGH' THEN 0.7 END, CASE WHEN o_orderstatus = 'F' THEN 0.3 END, 0.5)""")} AS threshold FROM orders""")
def resolve_threshold(spark, sf):
    o = table(spark, sf, "orders")
    asked = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") / 10000.0 - 10)
    env, stored = F.when(F.col("o_orderpriority") == "2-HIGH", 0.7), F.when(F.col("o_orderstatus") == "F", 0.3)
    return o.select("o_orderkey", r6(rules.resolve_threshold(asked, env, stored)).alias("threshold"))


ACCEPT = "(s1 >= 0.8 OR (s1 >= 0.1 AND (s1 - s2 >= 0.2 OR s2 < s1 * 0.75)))"


@query(f"WITH {SCORES} SELECT probe_id, pred, {ACCEPT} AS accepted FROM top2")
def accept_three_way(spark, sf):
    t = scoring.top2_margin(*_sides(spark, sf))
    return t.select("probe_id", "pred", rules.accept_three_way(F.col("s1"), F.col("s2")).alias("accepted"))


CONF = f"""CASE WHEN NOT {ACCEPT} THEN least(greatest(s1 / 0.1, 0.0), 0.4)
 ELSE CASE WHEN s1 - s2 > 2 THEN least(b * 1.05, 1.0) ELSE b END END"""


@query(f"""WITH {SCORES}, m AS (SELECT probe_id, s1 * 3 AS s1, s2 * 3 AS s2 FROM top2),
base AS (SELECT *, CASE WHEN s1 >= 0.8 THEN 0.95 + least(0.05, (s1 - 0.8) * 0.02) WHEN s1 >= 0.1 THEN 0.70 + 0.25 * (s1 - 0.1) / 0.7 ELSE 0.5 END AS b FROM m)
SELECT probe_id, {s6(CONF)} AS confidence, {s6('(s1 - s2) / (s1 + 1e-6)')} AS relative_margin FROM base""")
def confidence(spark, sf):
    t = scoring.top2_margin(*_sides(spark, sf)).select("probe_id", (F.col("s1") * 3).alias("s1"), (F.col("s2") * 3).alias("s2"))
    ok = rules.accept_three_way(F.col("s1"), F.col("s2"))
    return t.select("probe_id", r6(rules.confidence(F.col("s1"), F.col("s1") - F.col("s2"), ok)).alias("confidence"),
                    r6(rules.relative_margin(F.col("s1"), F.col("s2"))).alias("relative_margin"))


@query(f"""WITH {SCORES} SELECT probe_id, pred = label AND (s1 - s2) / (s1 + 1e-6) >= 0.6 AS accepted,
 CASE WHEN s1 < 0.3 THEN -1 ELSE pred END AS by_score, CASE WHEN s1 - s2 < 0.02 THEN -1 ELSE pred END AS by_margin FROM top2""")
def accept_relative(spark, sf):
    """Relative acceptance, and rejection by low score and by low margin."""
    p, g = _sides(spark, sf)
    t = scoring.top2_margin(p, g).join(p.select("probe_id", "label"), "probe_id")
    return t.select(
        "probe_id", rules.accept_relative(F.col("pred"), F.col("label"), F.col("s1"), F.col("s2")).alias("accepted"),
        rules.reject_low_score(F.col("pred"), F.col("s1"), 0.3).alias("by_score"),
        rules.reject_low_margin(F.col("pred"), F.col("margin"), 0.02).alias("by_margin"))


NORM = r"trim(regexp_replace(lower(regexp_replace({}, '[^A-Za-z0-9\s]', '', 'g')), '\s+', ' ', 'g'))"


@query(f"""WITH {SCORES}, words AS (SELECT conv_id, {NORM.format("any_value(text) FILTER (turn = 0)")} AS a, {NORM.format("any_value(text) FILTER (turn = 1)")} AS b FROM conversations GROUP BY conv_id),
ph AS (SELECT conv_id, CASE WHEN greatest(len(a), len(b)) > 0 THEN 1 - levenshtein(a, b) * 1.0 / greatest(len(a), len(b)) >= 0.2 END AS ok FROM words WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT probe_id, pred, {ACCEPT} AS score_ok, ok AS phrase_match, {ACCEPT} AND coalesce(ok, true) AND pred = label AS accepted FROM top2 LEFT JOIN ph ON probe_id = conv_id""")
def accept_final(spark, sf):
    """Score, phrase and identity rules together; the first two turns of a conversation stand in for the phrase."""
    from idmatch.functions import text

    p, g = _sides(spark, sf)
    turn = lambda i, c: table(spark, sf, "conversations").filter(F.col("turn") == i).select("conv_id", text.normalize_text(F.col("text")).alias(c))
    ok = turn(0, "a").join(turn(1, "b"), "conv_id").select(
        F.col("conv_id").alias("probe_id"), text.similar_at_least(F.col("a"), F.col("b"), 0.2).alias("phrase_match"))
    out = login.accept_final(scoring.top2_margin(p, g), p.select("probe_id", F.col("label").alias("claimed")), ok)
    return out.select("probe_id", "pred", "score_ok", "phrase_match", "accepted")


@query(f"""WITH {SCORES}, tr AS (SELECT label AS batch_id, sample_id AS probe_id, v, row_number() OVER (PARTITION BY label ORDER BY sample_id) AS r FROM test),
f AS (SELECT tr.batch_id, tr.probe_id, top2.pred, top2.s1 - top2.s2 >= 0.05 AS sure FROM tr JOIN top2 USING (probe_id) WHERE r <= 25),
c AS (SELECT batch_id, pred, count(*) AS m, count(*) FILTER (sure) AS votes FROM f GROUP BY batch_id, pred),
best AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY votes DESC, pred) AS r FROM c),
s AS (SELECT batch_id, CAST(sum(m) AS BIGINT) AS m, CAST(sum(votes) AS BIGINT) AS confident_votes, max(CASE WHEN r = 1 THEN pred END) AS p, max(CASE WHEN r = 1 THEN votes END) AS v FROM best GROUP BY batch_id)
SELECT batch_id, m, confident_votes, CASE WHEN v > 0 THEN p ELSE -1 END AS top_class, v AS top_votes,
 v > 0 AND v >= ceil(m * 0.2) AND confident_votes >= ceil(m * 0.3) AS duplicate FROM s""")
def duplicate_identity(spark, sf):
    p, g = _sides(spark, sf)
    return scoring.duplicate_identity(p.withColumnRenamed("label", "batch_id"), g, margin=0.05, consistency=0.2, confident=0.3)


@query(f"""WITH {PARTS}, l AS (SELECT count(*) AS leaked FROM test t WHERE EXISTS (SELECT 1 FROM both_sides b WHERE b.v = t.v)),
both_sides AS (SELECT v FROM train UNION ALL SELECT v FROM test WHERE sample_id < 100)
SELECT (SELECT count(*) FROM both_sides) AS train_n, (SELECT count(*) FROM test) AS test_n, leaked, {s6('leaked * 100.0 / (SELECT count(*) FROM test)')} AS pct,
 leaked * 100.0 / (SELECT count(*) FROM test) < 1.0 AS disjoint FROM l""".replace("l AS (SELECT count(*) AS leaked FROM test t WHERE EXISTS (SELECT 1 FROM both_sides b WHERE b.v = t.v)),\nboth_sides AS (SELECT v FROM train UNION ALL SELECT v FROM test WHERE sample_id < 100)",
 "both_sides AS (SELECT v FROM train UNION ALL SELECT v FROM test WHERE label < 3),\nl AS (SELECT count(*) AS leaked FROM test t WHERE EXISTS (SELECT 1 FROM both_sides b WHERE b.v = t.v))"))
def leakage_exact(spark, sf):
    """The train side also receives the test rows of three classes, so there is something to find."""
    train, test = parts(spark, sf)
    leaky = train.unionByName(test.filter("label < 3"))
    return rounded(leakage.leakage_exact(leaky, test))


@query(f"""WITH {PARTS} SELECT (SELECT count(*) FROM train) + count(*) FILTER (label < 6) AS train_n, count(*) AS test_n, count(*) FILTER (label < 3) AS leaked,
 {s6('count(*) FILTER (label < 3) * 100.0 / count(*)')} AS pct, count(*) FILTER (label < 3) * 100.0 / count(*) < 1.0 AS disjoint FROM test""")
def leakage_within_tolerance(spark, sf):
    """Copies that differ by less than the tolerance, from the first value on, are found; those that differ by more are not."""
    train, test = parts(spark, sf)
    moved = lambda by: F.transform("v", lambda x, i: x + by * (i % 2 * 2 - 1))
    leaky = train.unionByName(test.filter("label < 3").withColumn("v", moved(9e-10))).unionByName(test.filter("label BETWEEN 3 AND 5").withColumn("v", moved(1e-6)))
    return rounded(leakage.leakage_exact(leaky, test))


DIST = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"""WITH {PARTS}, noisy AS (SELECT v FROM train UNION ALL SELECT list_transform(v, lambda x: x + 0.0005) FROM test WHERE label >= 5),
d AS (SELECT {DIST} AS d FROM test a CROSS JOIN noisy b)
SELECT count(*) FILTER (d < 0.01) AS near_pairs, {s6('min(d) FILTER (d < 0.01)')} AS min_near_distance, coalesce(min(d) < 0.001, false) AS extreme FROM d""")
def near_pairs(spark, sf):
    """Exact near pairs over whole tables; shifted copies of some test rows are planted in the train side."""
    train, test = parts(spark, sf)
    shifted = test.filter("label >= 5").withColumn("v", F.transform("v", lambda x: x + 0.0005))
    return rounded(leakage.near_summary(leakage.near_pairs(train.unionByName(shifted), test, 64)))


@query(f"""WITH {PARTS}, a AS (SELECT v, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id) AS i FROM test),
b AS (SELECT v, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR) || ':43'), sample_id) AS i FROM train),
d AS (SELECT {DIST} AS d FROM a JOIN b USING (i) WHERE i <= 100)
SELECT count(*) AS pairs, {s6('min(d)')} AS min_distance, {s6('avg(d)')} AS mean_distance, count(*) FILTER (d < 0.01) AS near FROM d""")
def leakage_near(spark, sf):
    train, test = parts(spark, sf)
    return rounded(leakage.leakage_near(train, test))


@query(f"""WITH {SCORES} SELECT label AS real, pred, count(*) AS n FROM top2 GROUP BY label, pred""")
def confusion_of_scores(spark, sf):
    best = scoring.claimed_scores(*_sides(spark, sf))
    return metrics.confusion(best, "label", "pred")


@query(f"""WITH {EMB}, {cent('emb')}, s AS (SELECT p.sample_id AS probe_id, c.class, {COS} AS score FROM emb p CROSS JOIN cent c)
SELECT probe_id, '{{' || string_agg('"' || class || '":' || CAST(CAST(floor(score * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY class) || '}}' AS scores FROM s GROUP BY probe_id""")
def scores_json(spark, sf):
    from idmatch.operators import relations

    df = vectors(spark, sf)
    s = scoring.score_all(probes(df), vectorsets.class_centroids(df)).withColumn("score", F.floor(F.col("score") * 1000))
    return relations.scores_json(s)


CHANGED = f"""WITH {PARTS}, {cent('train')}, q AS (SELECT sample_id, label, 'base' AS condition, v FROM test UNION ALL SELECT sample_id, label, 'bright', list_transform(v, lambda x: x + 0.05) FROM test),
s AS (SELECT p.sample_id, p.condition, c.class, {COS} AS score FROM q p CROSS JOIN cent c), rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, condition ORDER BY score DESC, class) AS rank FROM s),
x AS (SELECT sample_id, condition, avg(x) AS m, stddev_pop(x) AS sd, count(*) FILTER (x <= -0.1) * 100.0 / count(*) AS dark, count(*) FILTER (x >= 0.2) * 100.0 / count(*) AS bright, min(x) AS lo, max(x) AS hi
 FROM (SELECT sample_id, condition, unnest(v) AS x FROM q) GROUP BY ALL)"""


@query(f"""{CHANGED} SELECT label AS user_real, label AS y_true, 'v' || sample_id || '.csv' AS filename, condition, {s6('m')} AS qc_mean, {s6('sd')} AS qc_std, {s6('dark')} AS qc_pct_dark, {s6('bright')} AS qc_pct_bright,
 {s6('lo')} AS qc_min, {s6('hi')} AS qc_max, a.class AS pred, {s6('a.score')} AS score1, {s6('b.score')} AS score2, {s6('a.score - b.score')} AS margin, (a.class = label)::INTEGER AS ok, 0::BIGINT AS time_ms
FROM q JOIN x USING (sample_id, condition) JOIN rk a USING (sample_id, condition) JOIN rk b USING (sample_id, condition) WHERE a.rank = 1 AND b.rank = 2""")
def quality_batch_report(spark, sf):
    """Every test vector as it is and brighter, its quality and its recognition, written as a report and read back."""
    p, g = _sides(spark, sf)
    both = p.withColumn("condition", F.lit("base")).unionByName(p.withColumn("v", F.transform("v", lambda x: x + 0.05)).withColumn("condition", F.lit("bright")))
    both = both.withColumn("name", F.col("probe_id")).withColumn("probe_id", F.col("name") * 2 + (F.col("condition") == "bright").cast("int"))
    values = both.select("probe_id", F.explode("v").alias("x"))
    rows = both.join(quality.value_profile(values, ["probe_id"], "x", -0.1, 0.2), "probe_id").join(scoring.top2_margin(both, g), "probe_id")
    path = scratch_path(spark, "batch")
    text_files.write_report(text_files.quality_batch_report(rows.select(
        "*", F.col("label").alias("user_real"), F.col("label").alias("y_true"), F.concat(F.lit("v"), "name", F.lit(".csv")).alias("filename"), F.lit(0).cast("long").alias("time_ms"))), path, ",")
    kinds = ("user_real long, y_true long, filename string, condition string, qc_mean double, qc_std double, qc_pct_dark double, qc_pct_bright double, qc_min double, qc_max double, "
             "pred long, score1 double, score2 double, margin double, ok int, time_ms long")
    back = spark.read.schema(kinds).csv(path, header=True)
    return rounded(back).withColumn("ok", F.col("ok").cast("int"))


@query(f"""WITH {SCORES}, listed AS (SELECT unnest(range(12)) AS real) SELECT 'Real_' || real AS "Real", {', '.join(f'count(*) FILTER (pred = {c}) AS "Pred_{c}"' for c in range(12))}
FROM listed LEFT JOIN top2 ON label = real GROUP BY real""")
def confusion_report(spark, sf):
    """The confusion matrix of the test part as a report, with two classes that never occur, read back."""
    best = scoring.top2_margin(*_sides(spark, sf)).select("probe_id", "pred").join(_sides(spark, sf)[0].select("probe_id", F.col("label").alias("real")), "probe_id")
    path = scratch_path(spark, "confusion")
    text_files.write_report(text_files.confusion_report(metrics.confusion(best), list(range(12))), path)
    return spark.read.schema("Real string, " + ", ".join(f"Pred_{c} long" for c in range(12))).csv(path, header=True, sep=text_files.DELIMITER)
