"""Model fitting queries. Iterative fits have no SQL form; their tests compare with brute force."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.classification import MARG, PAIRS
from idmatch.catalog.common import DIMS, EMB, LONG, PARTS, parts, r6, rounded, s6, vectors
from idmatch.catalog.quality import MODEL, _model
from idmatch.functions import vectors as V
from idmatch.operators import augment as A
from idmatch.operators import hinge, linear, metrics, reduce, scoring, split, templates
from idmatch.plans import gallery, release
from idmatch.session import scratch_path
from idmatch.sources import versions


@query()
def pca_fit(spark, sf):
    return rounded(reduce.component_table(reduce.pca_fit(vectors(spark, sf), 8)).drop("c"))


@query()
def pca_project(spark, sf):
    df = vectors(spark, sf)
    out = reduce.project_vectors(df.select("sample_id", "v"), reduce.pca_fit(df, 8))
    return out.select("sample_id", r6(V.l2_norm(F.col("v"))).alias("norm"))


@query(f"WITH {EMB}, {LONG.split(EMB + ', ')[1]}, m AS (SELECT dim, avg(x) AS m FROM long GROUP BY dim) SELECT sample_id, {s6('sqrt(sum((x - m) * (x - m)))')} AS norm FROM long JOIN m USING (dim) GROUP BY sample_id")
def pca_project_full(spark, sf):
    """On all components a vector keeps its distance from the mean."""
    df = vectors(spark, sf)
    out = reduce.project_vectors(df.select("sample_id", "v"), reduce.pca_fit(df, 64))
    return out.select("sample_id", r6(V.l2_norm(F.col("v"))).alias("norm"))


@query()
def lda_fit(spark, sf):
    return rounded(reduce.component_table(reduce.lda_fit(vectors(spark, sf), 9)).drop("c"))


def fit_sql(name: str, train: str, reg: str, cost: str = "1.0", classes: str = "TRUE", rounds: int = 160) -> str:
    """CTE ``name(class, w)``, bias last: the same objective by accelerated gradient descent over all rows."""
    zeros, push = f"list_transform(range({DIMS + 1}), lambda x: 0.0::DOUBLE)", "least(greatest(short / 0.5, 0.0), 1.0) * sgn * own"
    return f"""{name}_x AS MATERIALIZED (SELECT label, list_append(v, 1.0::DOUBLE) AS u FROM {train}),
{name}_c AS MATERIALIZED (SELECT label AS class, {cost} AS cost, n + ({cost} - 1) * k AS total, {reg} AS reg FROM (SELECT label, count(*)::DOUBLE AS k, (SELECT count(*) FROM {train})::DOUBLE AS n FROM {train} GROUP BY label) WHERE {classes}),
{name}_gd AS (SELECT 0 AS it, class, {zeros} AS w, {zeros} AS y FROM {name}_c UNION ALL
 SELECT any_value(it) + 1, class, list(w2 ORDER BY dim), list(w2 + 0.75 * (w2 - w1) ORDER BY dim) FROM (
  SELECT it, class, dim, w1, y1 - (-g / total + CASE WHEN dim <= {DIMS} THEN reg * y1 ELSE 0 END) / (4.1 + reg) AS w2 FROM (
   SELECT any_value(it) AS it, class, dim, any_value(total) AS total, any_value(reg) AS reg, any_value(w[dim]) AS w1, any_value(y[dim]) AS y1, sum({push} * u[dim]) AS g FROM (
    SELECT *, 1 - sgn * list_dot_product(u, y) AS short FROM (
     SELECT m.it, m.class, m.w, m.y, c.total, c.reg, x.u, CASE WHEN x.label = m.class THEN c.cost ELSE 1.0 END AS own, CASE WHEN x.label = m.class THEN 1.0 ELSE -1.0 END AS sgn
     FROM {name}_gd m JOIN {name}_c c USING (class) CROSS JOIN {name}_x x WHERE m.it < {rounds})), (SELECT unnest(range(1, {DIMS + 2})) AS dim) GROUP BY class, dim)) GROUP BY class),
{name} AS (SELECT class, w FROM {name}_gd WHERE it = {rounds})"""


def evaluate_sql(model: str, rows: str) -> str:
    """CTEs up to ``all_metrics``: the metrics of a model on labelled rows, one row."""
    marginals = MARG[len(PAIRS) + 2:]
    return f"""pairs AS (SELECT label AS real, arg_max(class, (score, -class)) AS pred FROM (SELECT sample_id, label, class, list_dot_product(list_append(v, 1.0::DOUBLE), w) AS score FROM {rows} CROSS JOIN {model}) GROUP BY sample_id, label),
{marginals}, w1 AS (SELECT sum(tp) * 100.0::DOUBLE / sum(row_n) AS acc, avg(p) AS p, avg(r) AS r, avg(f1) AS f, sum(p * row_n) / sum(row_n) AS pw, sum(r * row_n) / sum(row_n) AS rw,
 sum(f1 * row_n) / sum(row_n) AS fw, sum(tp) * 100.0::DOUBLE / sum(col_n) AS pm FROM f),
w2 AS (SELECT sum(tp)::DOUBLE AS tr, sum(row_n)::DOUBLE AS n, sum(row_n::DOUBLE * col_n) AS rc, sum(row_n::DOUBLE * row_n) AS rr, sum(col_n::DOUBLE * col_n) AS cc FROM m),
all_metrics AS (SELECT acc AS accuracy, r AS balanced_accuracy, p AS precision_macro, r AS recall_macro, f AS f1_macro, pw AS precision_weighted, rw AS recall_weighted, fw AS f1_weighted, pm AS precision_micro,
 acc AS recall_micro, CASE WHEN pm + acc > 0 THEN 2 * pm * acc / (pm + acc) ELSE 0 END AS f1_micro, coalesce((tr * n - rc) * 100.0 / nullif(sqrt((n * n - cc) * (n * n - rr)), 0), 0) AS mcc FROM w1, w2)"""


EVALUATED = ("accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted", "precision_micro", "recall_micro", "f1_micro", "mcc")
RECURSIVE = f"WITH RECURSIVE {PARTS}"


@query(f"{RECURSIVE}, {fit_sql('fitted', 'train', '0.1')}, {evaluate_sql('fitted', 'test')} SELECT {', '.join(f'{s6(c)} AS {c}' for c in EVALUATED)} FROM all_metrics")
def ova_svm_fit(spark, sf):
    train, test = parts(spark, sf)
    return rounded(linear.evaluate(test, linear.ova_svm_fit(train, 0.1)))


def _weights(model):
    """Bias, length and direction of each class's weights."""
    ramp = F.transform("w", lambda x, i: (i + 1).cast("double"))
    return model.select("class", F.size("w").cast("long").alias("dims"), r6("b", 4).alias("b"), r6(V.l2_norm(F.col("w")), 4).alias("norm"), r6(V.dot(F.col("w"), ramp), 3).alias("ramp"))


WEIGHTS = f"""SELECT class, {DIMS}::BIGINT AS dims, {s6(f'w[{DIMS + 1}]', 4)} AS b, {s6(f'sqrt(list_dot_product(w[1:{DIMS}], w[1:{DIMS}]))', 4)} AS norm,
 {s6(f'list_dot_product(w[1:{DIMS}], list_transform(range(1, {DIMS + 1}), lambda x: x::DOUBLE))', 3)} AS ramp FROM """


@query(f"{RECURSIVE}, {fit_sql('fitted', 'train', '0.1')} {WEIGHTS} fitted")
def ova_svm_weights(spark, sf):
    """The fitted weights themselves, against gradient descent run to its end."""
    return _weights(linear.ova_svm_fit(parts(spark, sf)[0], 0.1))


IMBALANCE = f"least(greatest(sqrt((n - k) / greatest(k, 1)) * {V.WEIGHT_FACTOR}, {V.WEIGHT_MIN}), {V.WEIGHT_MAX})"


@query(f"{RECURSIVE}, {fit_sql('fitted', 'train', '1 / (0.02 * n)', IMBALANCE)} {WEIGHTS} fitted")
def ova_svm_fit_weighted(spark, sf):
    return _weights(linear.ova_svm_fit_weighted(parts(spark, sf)[0], 0.02))


@query(f"{RECURSIVE}, {fit_sql('fitted', 'train', '0.1', '(1.0 + class % 3)'.replace('class', 'label'))}, {evaluate_sql('fitted', 'test')} SELECT {s6('accuracy', 2)} AS accuracy, {s6('f1_macro', 2)} AS f1_macro, {s6('mcc', 2)} AS mcc FROM all_metrics")
def ova_hinge_fit(spark, sf):
    """All classes in each pass, with a weight of its own for each."""
    train, test = parts(spark, sf)
    model = hinge.ova_hinge_fit(train, 0.1, weights={k: 1.0 + k % 3 for k in range(10)})
    return rounded(linear.evaluate(test, model).select("accuracy", "f1_macro", "mcc"), digits=2)


@query(f"""{RECURSIVE}, known AS (SELECT * FROM train WHERE label <> 9), {fit_sql('base', 'known', '0.1')},
k AS (SELECT label, row_number() OVER (ORDER BY md5(CAST(label AS VARCHAR) || ':42'), label) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM known)),
sampled AS (SELECT * FROM train WHERE label = 9 OR label IN (SELECT label FROM k WHERE r <= least(greatest(ceil(n * 0.75), 1), n))), {fit_sql('added', 'sampled', '0.1', classes='label = 9')},
s AS (SELECT avg(w[{DIMS + 1}]) AS m, stddev_pop(w[{DIMS + 1}]) AS s FROM base),
one AS (SELECT class, w[1:{DIMS}] AS v, w[{DIMS + 1}] AS b, m, s FROM added, s),
done AS (SELECT class, list_append(v, CASE WHEN b > m + 3 * s THEN (b + m + 2.5 * s) / 2 WHEN b < m - 3 * s THEN (b + m - 2.5 * s) / 2 ELSE b END) AS w FROM one UNION ALL SELECT class, w FROM base)
{WEIGHTS} done""")
def add_class(spark, sf):
    train, _ = parts(spark, sf)
    base = linear.ova_svm_fit(train.filter("label <> 9"), 0.1)
    return _weights(linear.add_class(base, train, 9, 0.1))


@query(f"""WITH {EMB}, c AS (SELECT label, row_number() OVER (ORDER BY md5(CAST(label AS VARCHAR) || ':42'), label) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM emb WHERE label <> 4))
SELECT sample_id, label FROM emb WHERE label = 4 OR label IN (SELECT label FROM c WHERE r <= ceil(n * 0.75))""")
def negative_class_sample(spark, sf):
    return linear.negative_class_sample(vectors(spark, sf), 4).select("sample_id", "label")


@query(f"""WITH {MODEL}, s AS (SELECT avg(b) AS m, stddev_pop(b) AS s FROM model), x AS (SELECT class, b * 4 AS b FROM model)
SELECT class, {s6('CASE WHEN b > m + 3 * s THEN (b + m + 2.5 * s) / 2 WHEN b < m - 3 * s THEN (b + m - 2.5 * s) / 2 ELSE b END')} AS b FROM x, s""")
def bias_clamp(spark, sf):
    model = _model(spark, sf)
    return rounded(linear.bias_clamp(model.withColumn("b", F.col("b") * 4), model).select("class", "b"))


@query(f"""WITH {MODEL}, sc AS (SELECT class, label, list_dot_product(v, w) + b * 0.01 >= 0 AS hit FROM emb CROSS JOIN model),
c AS (SELECT class, count(*) FILTER (hit AND label = class) AS tp, count(*) FILTER (NOT hit AND label <> class) AS tn, count(*) FILTER (hit AND label <> class) AS fp, count(*) FILTER (NOT hit AND label = class) AS fn FROM sc GROUP BY class),
f AS (SELECT class, fp, tn, CASE WHEN tp > 0 THEN 100.0 * 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
SELECT class, {s6('CASE WHEN f1 < 15 OR fp > floor((tn + fp) * 0.15) THEN b * 0.01 - 1.5 ELSE b * 0.01 END')} AS b FROM model JOIN f USING (class)""")
def bias_penalty(spark, sf):
    df = vectors(spark, sf)
    model = _model(spark, sf).withColumn("b", F.col("b") * 0.01)
    return rounded(linear.bias_penalty(model, linear.one_vs_rest_counts(df, model)).select("class", "b"))


@query()
def k_templates(spark, sf):
    t = templates.k_templates(vectors(spark, sf), 3)
    return t.select("class", F.col("k").cast("long"), r6(V.l2_norm(F.col("t"))).alias("norm"))


@query()
def k_template_scores(spark, sf):
    """Best-of-K class scores of the test part."""
    train, test = parts(spark, sf)
    p = test.select(F.col("sample_id").alias("probe_id"), "label", "v")
    return rounded(scoring.top2_margin(p, templates.k_templates(train, 2)))


@query()
def sweep_components(spark, sf):
    train, test = parts(spark, sf)
    return rounded(linear.sweep(train, test, regs=(0.01, 0.1), pca=(35, 55), reg=0.01))


def _run_sql(k: int, run: int) -> str:
    """One run of the learning curve: its classes, its split, its fit, its metrics."""
    parts_sql = PARTS.replace(":42", f":{42 + run}").replace("FROM emb)", "FROM emb WHERE label IN (SELECT label FROM chosen))")
    chosen = f"""chosen AS (SELECT label FROM (SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY ALL) WHERE n >= 20 ORDER BY md5(CAST(label AS VARCHAR) || ':{42 + run}'), label LIMIT {k})"""
    return f"""(WITH RECURSIVE {chosen}, {parts_sql}, {fit_sql('fitted', 'train', '0.1')}, {evaluate_sql('fitted', 'test')}
SELECT {k}::BIGINT AS classes, accuracy, f1_macro AS f1, balanced_accuracy AS balanced, mcc FROM all_metrics)"""


@query(f"""SELECT classes, count(*) AS runs, {', '.join(f"{s6(f'avg({c})')} AS {c}_mean, {s6(f'stddev_samp({c})')} AS {c}_sd" for c in ('accuracy', 'f1', 'balanced', 'mcc'))}
FROM ({' UNION ALL '.join(f'SELECT * FROM {_run_sql(k, r)}' for k in (2, 4) for r in (0, 1))}) GROUP BY classes""")
def learning_curve(spark, sf):
    runs = linear.learning_curve(vectors(spark, sf), (2, 4), repeats=2, min_rows=20, reg=0.1)
    return rounded(metrics.learning_curve_summary(runs))


@query()
def fit_gallery(spark, sf):
    train, test = parts(spark, sf)
    return rounded(gallery.fit_gallery(train, test, pca_k=32, lda_k=9, steps=200).threshold)


@query(f"""WITH h AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) <= greatest(1, CAST(round(count(*) OVER () * 0.2) AS BIGINT)) AS held FROM embeddings),
a AS (SELECT (avg((label = 3)::INT) * 100) AS accuracy FROM h WHERE held), b AS (SELECT (avg((label = 3)::INT) * 100) AS baseline FROM h)
SELECT {s6('accuracy')} AS accuracy, {s6('baseline')} AS baseline, {s6('accuracy - baseline')} AS change, CASE WHEN accuracy - baseline < -2 THEN 'reject' ELSE 'keep' END AS verdict FROM a, b""")
def regression_gate(spark, sf):
    """Accuracy of a constant guess on the holdout against the same on all rows."""
    df = vectors(spark, sf)
    held = split.fixed_holdout(df).filter("holdout")
    share = lambda x: x.agg((F.avg((F.col("label") == 3).cast("double")) * 100.0).alias("accuracy"))
    return rounded(linear.regression_gate(share(held), share(df)))


@query(f"""WITH {EMB}, f AS (SELECT 0 AS step, avg((label = 3)::INT) * 100 AS accuracy FROM emb UNION ALL SELECT 1, avg((label = 3 AND sample_id % 2 = 1)::INT) * 100 FROM emb
 UNION ALL SELECT 2, avg((label = 3 OR sample_id % 50 = 0)::INT) * 100 FROM emb), b AS (SELECT accuracy AS baseline FROM f WHERE step = 0)
SELECT step::INTEGER AS step, {s6('accuracy')} AS accuracy, CASE WHEN step > 0 THEN {s6('baseline')} END AS baseline, CASE WHEN step > 0 THEN {s6('accuracy - baseline')} END AS change,
 CASE WHEN step > 0 AND accuracy - baseline < -2 THEN 'reject' ELSE 'keep' END AS verdict,
 (SELECT count(*) FROM emb WHERE label = 3 OR (step = 2 AND sample_id % 50 = 0)) AS threes FROM f, b""")
def release_gate(spark, sf):
    """Three releases of a table: the first sets the baseline, the second loses accuracy and is taken back, the third stays.

    The accuracy is that of a constant guess; ``threes`` counts its hits in the table after each release.
    """
    root, baseline = scratch_path(spark, "vectors"), scratch_path(spark, "baseline")
    df = vectors(spark, sf).select("sample_id", "label")
    versions.create(df, root, ["sample_id"], file_rows=max(1, df.count() // 8))
    share = lambda rows: rows.agg((F.avg((F.col("label") == 3).cast("double")) * 100.0).alias("accuracy"))
    relabelled = lambda which, label: df.filter(which).select("sample_id", F.lit(label).cast("long").alias("label"))
    changes = (None, relabelled((F.col("label") == 3) & (F.col("sample_id") % 2 == 0), 4), relabelled(F.col("sample_id") % 50 == 0, 3))
    out = None
    for step, change in enumerate(changes):
        done = release.release(spark, root, change, "label", share, baseline)
        threes = versions.read(spark, root).filter("label = 3").count()
        row = done.select(F.lit(step).alias("step"), "accuracy", "baseline", "change", "verdict", F.lit(threes).cast("long").alias("threes"))
        out = row if out is None else out.unionByName(row)
    return rounded(out, "accuracy", "baseline", "change").withColumn("step", F.col("step").cast("int"))


U = "(('0x' || substr(md5({} || ':{}'), 1, 8))::BIGINT / 4294967296.0)"
KEY = "sample_id || ':' || variant"
EKEY = "sample_id || ':' || variant || ':' || (i - 1)"
CLIP = "CASE WHEN {0} > 1 THEN 1 - 0.1 * (1 - tanh(2 * ({0} - 1))) WHEN {0} < -1 THEN -(1 - 0.1 * (1 - tanh(2 * (-{0} - 1)))) ELSE {0} END"
GAUSS = f"(sqrt(-2 * ln(1 - {U.format(EKEY, '42:n:r')})) * cos({U.format(EKEY, '42:n:a')} * 2 * pi()))"
NOISY = "list_transform(v, lambda x, i: {})".format(CLIP.format(f"(x * 8 + {GAUSS} * {{sd}})"))
VOL = f"(0.7 + 0.6 * {U.format(KEY, '42:f')})"
SPD = f"(0.85 + 0.3 * {U.format(KEY, '42:f')})"


@query(f"""WITH {EMB}, r AS (SELECT sample_id, v, unnest(range(6)) AS variant FROM emb), k AS (SELECT *, {VOL} AS vol, {SPD} AS spd FROM r),
n AS (SELECT *, {NOISY.format(sd=0.05)} AS noisy, {NOISY.format(sd=0.035)} AS soft FROM k WHERE variant <> 4),
w AS (SELECT sample_id, variant, CASE WHEN variant = 0 THEN 'original' WHEN variant IN (1, 5) THEN 'noise' WHEN variant = 2 THEN 'volume' ELSE 'noise_volume' END AS kind,
 CASE WHEN variant = 0 THEN list_transform(v, lambda x: x * 8) WHEN variant IN (1, 5) THEN noisy WHEN variant = 2 THEN list_transform(v, lambda x: {CLIP.format('(x * 8 * vol)')}) ELSE list_transform(soft, lambda x: {CLIP.format('(x * vol)')}) END AS w FROM n
 UNION ALL SELECT sample_id, variant, 'speed', list_transform(range(CAST(floor(64 / spd) AS BIGINT)), lambda i: {CLIP.format('(8 * (CASE WHEN floor(i * spd) + 2 > 64 THEN v[CAST(floor(i * spd) AS BIGINT) + 1] ELSE v[CAST(floor(i * spd) AS BIGINT) + 1] * (1 - (i * spd - floor(i * spd))) + v[CAST(floor(i * spd) AS BIGINT) + 2] * (i * spd - floor(i * spd)) END))')}) FROM k WHERE variant = 4)
SELECT sample_id, variant, kind, CAST(len(w) AS BIGINT) AS d, {s6('list_sum(list_transform(w, lambda x, i: x * i))', 4)} AS weighted, {s6('list_dot_product(w, w)', 4)} AS squares FROM w""")
def augment(spark, sf):
    """Five variants of every vector, scaled by 8 so that the soft clip has work to do."""
    loud = vectors(spark, sf).withColumn("v", F.transform("v", lambda x: x * 8))
    out = A.augment(loud, 5)
    ramp = F.transform("v", lambda x, i: (i + 1).cast("double"))
    return out.select("sample_id", F.col("variant").cast("long"), "kind", F.size("v").cast("long").alias("d"),
                      r6(V.dot(F.col("v"), ramp), 4).alias("weighted"), r6(V.sum_squares(F.col("v")), 4).alias("squares"))
