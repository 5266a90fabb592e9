"""Classification metric queries."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import SCORES, parts, probes, r6, rounded, s6, table
from idmatch.operators import metrics as O
from idmatch.operators import quality, scoring, vectorsets

PAIRS = "pairs AS (SELECT CAST(c_nationkey % 5 AS BIGINT) AS real, CAST(CASE WHEN o_totalprice > 300000 THEN c_nationkey % 5 ELSE o_orderkey % 5 END AS BIGINT) AS pred FROM orders JOIN customer ON o_custkey = c_custkey)"
COUNTS = PAIRS + ", cm AS (SELECT real, pred, count(*) AS n FROM pairs GROUP BY real, pred)"
MARG = COUNTS + """, m AS (SELECT class, sum(tp) AS tp, sum(r) AS row_n, sum(c) AS col_n FROM (SELECT real AS class, CASE WHEN real = pred THEN n ELSE 0 END AS tp, n AS r, 0 AS c FROM cm
 UNION ALL SELECT pred, 0, 0, n FROM cm) GROUP BY class),
pr AS (SELECT *, CASE WHEN col_n > 0 THEN tp * 100.0::DOUBLE / col_n ELSE 0.0 END AS p, CASE WHEN row_n > 0 THEN tp * 100.0::DOUBLE / row_n ELSE 0.0 END AS r FROM m),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM pr)"""
BINARY = MARG + """, t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM cm),
q AS (SELECT class, CAST(tp AS BIGINT) AS tp, CAST(total - row_n - col_n + tp AS BIGINT) AS tn, CAST(col_n - tp AS BIGINT) AS fp, CAST(row_n - tp AS BIGINT) AS fn, p, r, f1 FROM f, t),
bm AS (SELECT class, tp, tn, fp, fn, (tp + tn) * 100.0 / (tp + tn + fp + fn) AS accuracy, p AS "precision", r AS recall, CASE WHEN tn + fp > 0 THEN tn * 100.0 / (tn + fp) ELSE 0.0 END AS specificity, f1,
 coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0.0) AS mcc,
 CASE WHEN tn + fp > 0 THEN fp * 100.0 / (tn + fp) ELSE 0.0 END AS fpr, CASE WHEN tp + fn > 0 THEN fn * 100.0 / (tp + fn) ELSE 0.0 END AS fnr FROM q)"""


def _pairs(spark, sf):
    """Truth and prediction derived from orders: nation group against itself for large orders, else a key group."""
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    real = F.col("c_nationkey") % 5
    pred = F.when(F.col("o_totalprice") > 300000, real).otherwise(F.col("o_orderkey") % 5)
    return joined.select(real.cast("long").alias("real"), pred.cast("long").alias("pred"))


def _counts(spark, sf):
    return O.confusion(_pairs(spark, sf))


@query(f"WITH {COUNTS} SELECT * FROM cm")
def confusion(spark, sf):
    return _counts(spark, sf)


@query(f"WITH {PAIRS}, r AS (SELECT real, CASE WHEN real = 0 THEN -1 ELSE pred END AS pred FROM pairs) SELECT real, pred, count(*) AS n FROM r WHERE pred IN (SELECT real FROM r) GROUP BY ALL")
def closed_confusion(spark, sf):
    """Predictions of one class count as rejected (-1) and fall out of the K x K form."""
    rejected = _pairs(spark, sf).withColumn("pred", F.when(F.col("real") == 0, -1).otherwise(F.col("pred")))
    return O.closed_confusion(O.confusion(rejected))


@query(f"""WITH {COUNTS} SELECT real, {', '.join(f'CAST(coalesce(sum(n) FILTER (pred = {k}), 0) AS BIGINT) AS "{k}"' for k in range(5))} FROM cm GROUP BY real""")
def confusion_matrix(spark, sf):
    return O.confusion_matrix(_counts(spark, sf), list(range(5)))


@query(f"""WITH {MARG} SELECT class, {s6('p')} AS "precision", {s6('r')} AS recall, {s6('f1')} AS f1, CAST(row_n AS BIGINT) AS support FROM f""")
def per_class_metrics(spark, sf):
    return rounded(O.per_class_metrics(_counts(spark, sf)))


@query(f"""WITH {MARG}, w AS (SELECT sum(tp) * 100.0::DOUBLE / sum(row_n) AS acc, avg(p) AS p, avg(r) AS r, avg(f1) AS f, sum(p * row_n) / sum(row_n) AS pw, sum(r * row_n) / sum(row_n) AS rw,
 sum(f1 * row_n) / sum(row_n) AS fw, sum(tp) * 100.0::DOUBLE / sum(col_n) AS pm FROM f)
SELECT {s6('acc')} AS accuracy, {s6('r')} AS balanced_accuracy, {s6('p')} AS precision_macro, {s6('r')} AS recall_macro, {s6('f')} AS f1_macro, {s6('pw')} AS precision_weighted,
 {s6('rw')} AS recall_weighted, {s6('fw')} AS f1_weighted, {s6('pm')} AS precision_micro, {s6('acc')} AS recall_micro, {s6('2 * pm * acc / (pm + acc)')} AS f1_micro FROM w""")
def summary_metrics(spark, sf):
    return rounded(O.summary_metrics(_counts(spark, sf)))


@query(f"""WITH {MARG}, s AS (SELECT sum(tp)::DOUBLE AS tr, sum(row_n)::DOUBLE AS n, sum(row_n::DOUBLE * col_n) AS rc, sum(row_n::DOUBLE * row_n) AS rr, sum(col_n::DOUBLE * col_n) AS cc FROM m)
SELECT {s6('(tr * n - rc) * 100.0 / sqrt((n * n - cc) * (n * n - rr))')} AS mcc FROM s""")
def mcc_multiclass(spark, sf):
    return rounded(O.mcc_multiclass(_counts(spark, sf)))


METRICS = ", ".join(f'{s6(chr(34) + c + chr(34))} AS "{c}"' for c in ("accuracy", "precision", "recall", "specificity", "f1", "mcc", "fpr", "fnr"))


@query(f"WITH {BINARY} SELECT class, tp, tn, fp, fn, {METRICS} FROM bm")
def binary_metrics(spark, sf):
    return rounded(O.binary_metrics(_counts(spark, sf)))


@query(f"""WITH {BINARY} SELECT {', '.join(f'{s6(f"avg({chr(34)}{c}{chr(34)})")} AS {c}_avg' for c in ('accuracy', 'precision', 'recall', 'f1', 'specificity', 'mcc'))},
 CAST(sum(tp) AS BIGINT) AS correct, CAST(sum(fn) AS BIGINT) AS wrong, CAST(sum(tp + fn) AS BIGINT) AS total FROM bm""")
def macro_stats(spark, sf):
    return rounded(O.macro_stats(_counts(spark, sf)))


@query(f"WITH {BINARY} SELECT class, {s6('recall')} AS recall, {s6('specificity')} AS specificity, recall >= 98 AND specificity < 30 AS collapsed FROM bm")
def collapse_flag(spark, sf):
    flagged = quality.collapsed_classes(O.binary_metrics(_counts(spark, sf)))
    return rounded(flagged.select("class", "recall", "specificity", "collapsed"))


@query(f"WITH {COUNTS} SELECT * FROM cm WHERE real <> pred")
def error_pairs(spark, sf):
    return O.error_pairs(_counts(spark, sf))


@query(f"""WITH {COUNTS}, e AS (SELECT real AS class, CAST(sum(CASE WHEN real <> pred THEN n ELSE 0 END) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS total FROM cm GROUP BY real)
SELECT class, errors, total, {s6('errors * 100.0 / total')} AS error_rate, {s6('100 - errors * 100.0 / total')} AS accuracy FROM e""")
def class_error_rate(spark, sf):
    return rounded(O.class_error_rate(_counts(spark, sf)))


@query(f"""WITH b AS (SELECT count(*) FILTER (n_chars >= 500 AND quality = 1) AS tp, count(*) FILTER (n_chars < 500 AND quality = 0) AS tn, count(*) FILTER (n_chars >= 500 AND quality = 0) AS fp,
 count(*) FILTER (n_chars < 500 AND quality = 1) AS fn FROM documents JOIN labels USING (doc_id))
SELECT tp, tn, fp, fn, {s6('(tp + tn) * 100.0 / (tp + tn + fp + fn)')} AS accuracy, {s6('tp * 100.0 / (tp + fp)')} AS "precision", {s6('tp * 100.0 / (tp + fn)')} AS recall, {s6('tn * 100.0 / (tn + fp)')} AS specificity FROM b""")
def binary_counts(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    counts = O.binary_counts(joined, F.col("quality") == 1, F.col("n_chars") >= 500)
    return rounded(O.binary_columns(counts).select("tp", "tn", "fp", "fn", "accuracy", "precision", "recall", "specificity"))


@query(f"""WITH e AS (SELECT row_number() OVER (ORDER BY s DESC) - 1 AS comp, s AS value FROM (SELECT o_orderpriority, sum(o_totalprice) AS s FROM orders GROUP BY o_orderpriority))
SELECT {s6('sum(value) FILTER (comp < 2) / sum(value)')} AS explained FROM e""")
def explained_variance(spark, sf):
    from pyspark.sql import Window as W

    sums = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("value"))
    comp = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("value"))) - 1
    return rounded(O.explained_variance(sums.withColumn("comp", comp), 2))


@query(f"""WITH r AS (SELECT event_type AS fase, TRY_CAST(value AS DOUBLE) AS t, TRY_CAST(value AS DOUBLE) / 2 AS c, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS ram FROM events)
SELECT fase, {s6('max(t)')} AS tiempo_s, {s6('sum(c)', 4)} AS cpu_s, {s6('100.0 * sum(c) / max(t)', 2)} AS cpu_pct, max(ram) AS ram_max_kb FROM r WHERE ram IS NOT NULL GROUP BY fase""")
def consolidate_phases(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(F.lit("job").alias("nombre"), F.col("event_type").alias("fase"), F.col("value").cast("string").alias("tiempo_s"),
                   (F.col("value") / 2).cast("string").alias("cpu_s"), F.lit("").alias("cpu_pct"),
                   F.get_json_object("props", "$.k").alias("ram_max_kb"))
    out = O.consolidate_phases(log)
    return out.select("fase", r6("tiempo_s").alias("tiempo_s"), r6("cpu_s", 4).alias("cpu_s"), r6("cpu_pct", 2).alias("cpu_pct"), "ram_max_kb")


@query(f"SELECT event_type, count(*) AS n, {s6('avg(value)')} AS mean_ms, {s6('max(value)')} AS max_ms, {s6('sum(value)', 3)} AS total_ms FROM events GROUP BY event_type")
def latency_stats(spark, sf):
    out = O.latency_stats(table(spark, sf, "events"), ["event_type"], "value")
    return out.select("event_type", "n", r6("mean_ms").alias("mean_ms"), r6("max_ms").alias("max_ms"), r6("total_ms", 3).alias("total_ms"))


@query(f"SELECT event_type, {', '.join(s6(f'quantile_cont(value, {q / 100})') + f' AS p{q}_ms' for q in (50, 90, 95, 99))} FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    return rounded(O.latency_percentiles(table(spark, sf, "events"), ["event_type"], "value"))


@query(f"""WITH r AS (SELECT CAST(l_linenumber AS BIGINT) AS classes, l_quantity AS accuracy, l_discount * 100 AS f1, l_tax * 100 AS balanced, l_extendedprice / 1000 AS mcc FROM lineitem)
SELECT classes, count(*) AS runs, {', '.join(f"{s6(f'avg({c})')} AS {c}_mean, {s6(f'stddev_samp({c})')} AS {c}_sd" for c in ('accuracy', 'f1', 'balanced', 'mcc'))} FROM r GROUP BY classes""")
def learning_curve_summary(spark, sf):
    runs = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("long").alias("classes"), F.col("l_quantity").alias("accuracy"), (F.col("l_discount") * 100).alias("f1"),
        (F.col("l_tax") * 100).alias("balanced"), (F.col("l_extendedprice") / 1000).alias("mcc"))
    return rounded(O.learning_curve_summary(runs))


@query(f"""WITH {SCORES} SELECT CASE WHEN probe_id % 2 = 0 THEN 'even' ELSE 'odd' END AS condition, count(*) AS n, {s6('avg((pred = label)::INT) * 100')} AS accuracy,
 {s6('avg(s1 - s2)')} AS mean_margin, {s6('avg((s1 >= 0.3)::INT) * 100')} AS qc_pass_pct FROM top2 GROUP BY condition""")
def robustness_report(spark, sf):
    train, test = parts(spark, sf)
    best = scoring.claimed_scores(probes(test), vectorsets.class_centroids(train))
    rows = best.select(F.when(F.col("probe_id") % 2 == 0, "even").otherwise("odd").alias("condition"), (F.col("pred") == F.col("label")).alias("ok"),
                       (F.col("s1") - F.col("s2")).alias("margin"), (F.col("s1") >= 0.3).alias("qc_pass"))
    return rounded(O.robustness_report(rows))
