"""Vector set queries."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import DIMS, EMB, LONG, PARTS, cent, parts, r6, rounded, s6, table, vectors
from idmatch.functions import vectors as V
from idmatch.operators import vectorsets as O
from idmatch.operators.rows import beside


@query(f"WITH {LONG} SELECT sample_id, dim, {s6('x')} AS x FROM long")
def to_long(spark, sf):
    return O.to_long(vectors(spark, sf), ["sample_id"]).select("sample_id", F.col("dim").cast("long"), r6("x").alias("x"))


@query(f"WITH {LONG} SELECT sample_id, CAST(count(*) AS BIGINT) AS d, {s6('sum(x * (dim + 1))', 5)} AS weighted FROM long GROUP BY sample_id")
def to_wide(spark, sf):
    wide = O.to_wide(O.to_long(vectors(spark, sf), ["sample_id"]), ["sample_id"])
    ramp = F.transform("v", lambda x, i: (i + 1).cast("double"))
    return wide.select("sample_id", F.size("v").cast("long").alias("d"), r6(V.dot(F.col("v"), ramp), 5).alias("weighted"))


CUT = "(CASE WHEN label % 3 = 0 THEN v[1:60] ELSE v END)"


@query(f"WITH {EMB} SELECT count(*) FILTER (len({CUT}) = 64) AS kept, count(*) FILTER (len({CUT}) <> 64) AS dropped FROM emb")
def dim_guard(spark, sf):
    cut = F.when(F.col("label") % 3 == 0, F.slice("v", 1, 60)).otherwise(F.col("v"))
    return O.dim_report(vectors(spark, sf).withColumn("v", cut), DIMS)


@query(f"WITH {EMB} SELECT sample_id, label FROM emb WHERE label IN (1, 3, 5)")
def filter_classes(spark, sf):
    return O.filter_classes(vectors(spark, sf), [1, 3, 5]).select("sample_id", "label")


@query(f"WITH {EMB} SELECT sample_id, label FROM emb ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id LIMIT 77")
def subset_n(spark, sf):
    return O.subset_n(vectors(spark, sf), 77, "sample_id").select("sample_id", "label")


@query(f"WITH {PARTS} SELECT label, count(*) AS n FROM (SELECT label FROM train UNION ALL SELECT label FROM test) GROUP BY label")
def union_sets(spark, sf):
    train, test = parts(spark, sf)
    return O.union_sets(train, test).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {PARTS} SELECT CAST(min(len(v)) FILTER (split = 'train') AS BIGINT) AS train_min_dim, CAST(max(len(v)) FILTER (split = 'train') AS BIGINT) AS train_max_dim,
 CAST(min(len(v)) FILTER (split = 'test') AS BIGINT) AS test_min_dim, CAST(max(len(v)) FILTER (split = 'test') AS BIGINT) AS test_max_dim,
 (SELECT count(DISTINCT label) FROM test WHERE label NOT IN (SELECT label FROM train)) AS unseen_classes,
 min(len(v)) = max(len(v)) AND (SELECT count(DISTINCT label) FROM test WHERE label NOT IN (SELECT label FROM train)) = 0 AS compatible FROM parts""")
def compat_check(spark, sf):
    train, test = parts(spark, sf)
    return rounded(O.compat_check(train, test))


@query(f"""WITH {LONG} SELECT dim, {s6('avg(x)')} AS mean, {s6('CASE WHEN stddev_pop(x) < 1e-10 THEN 1.0 ELSE stddev_pop(x) END')} AS sd FROM long GROUP BY dim""")
def zscore_fit(spark, sf):
    fitted = O.zscore_fit(vectors(spark, sf)).select(F.posexplode(F.arrays_zip("mean", "sd")).alias("dim", "p"))
    return fitted.select(F.col("dim").cast("long"), r6("p.mean").alias("mean"), r6("p.sd").alias("sd"))


@query(f"""WITH {LONG}, f AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY dim)
SELECT sample_id, dim, {s6('(x - m) / CASE WHEN s < 1e-10 THEN 1.0 ELSE s END')} AS x FROM long JOIN f USING (dim)""")
def zscore_apply(spark, sf):
    df = vectors(spark, sf)
    z = O.zscore_transform(df, O.zscore_fit(df))
    return O.to_long(z, ["sample_id"]).select("sample_id", F.col("dim").cast("long"), r6("x").alias("x"))


@query(f"""WITH {EMB}, {cent('emb')} SELECT class, n, CAST(unnest(range(len(t))) AS BIGINT) AS dim, unnest(list_transform(t, lambda x: {s6('x')})) AS x,
 {s6('sqrt(greatest(list_dot_product(t, t), 1e-12))')} AS norm FROM cent""")
def class_centroids(spark, sf):
    c = O.class_centroids(vectors(spark, sf))
    return c.select("class", "n", r6("norm").alias("norm"), F.posexplode("t").alias("dim", "x")).select(
        "class", "n", "norm", F.col("dim").cast("long"), r6("x").alias("x"))


@query(f"""WITH {EMB}, c AS (SELECT label AS class, count(*) AS n FROM emb GROUP BY label)
SELECT class, n, {s6('n * 100.0 / (SELECT sum(n) FROM c)')} AS pct, n < 10 AS under_10, n < 20 AS under_20 FROM c""")
def class_balance(spark, sf):
    return rounded(O.class_balance(vectors(spark, sf)))


@query(f"""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT count(*) AS classes, min(n) AS min_n, max(n) AS max_n, count(*) FILTER (n < 10) AS classes_under_10, count(*) FILTER (n < 20) AS classes_under_20,
 {s6('max(n) * 1.0 / min(n)')} AS ratio, CASE WHEN max(n) * 1.0 / min(n) > 10 THEN 'severe' WHEN max(n) * 1.0 / min(n) > 5 THEN 'high'
 WHEN max(n) * 1.0 / min(n) > 2 THEN 'moderate' ELSE 'balanced' END AS band FROM c""")
def balance_summary(spark, sf):
    return rounded(O.balance_summary(table(spark, sf, "events"), "user_id"))


DAMAGED = "list_transform(v, lambda x, i: CASE WHEN i % 16 = label % 16 THEN 0.0 WHEN sample_id % 50 = 7 AND i = 3 THEN CAST('nan' AS DOUBLE) WHEN sample_id % 70 = 9 AND i = 5 THEN CAST('inf' AS DOUBLE) ELSE x END)"


def _damaged(df):
    """Vectors with some zero, NaN and infinite values, set from row keys."""
    i1 = lambda i: i + 1
    def spoil(x, i):
        return (F.when(i1(i) % 16 == F.col("label") % 16, 0.0)
                .when((F.col("sample_id") % 50 == 7) & (i1(i) == 3), float("nan"))
                .when((F.col("sample_id") % 70 == 9) & (i1(i) == 5), float("inf")).otherwise(x))
    return df.withColumn("v", F.transform("v", spoil))


@query(f"""WITH {EMB}, d AS (SELECT {DAMAGED} AS v FROM emb), p AS (SELECT len(v) AS d, len(list_filter(v, lambda x: isnan(x))) AS nans,
 len(list_filter(v, lambda x: isinf(x))) AS infs, len(list_filter(v, lambda x: x = 0.0)) AS zeros FROM d)
SELECT count(*) AS n_rows, CAST(sum(d) AS BIGINT) AS total, CAST(sum(nans) AS BIGINT) AS nans, CAST(sum(infs) AS BIGINT) AS infs, CAST(sum(zeros) AS BIGINT) AS zeros,
 count(*) FILTER (nans + infs > 0) AS invalid_rows, {s6('sum(zeros) * 100.0 / sum(d)')} AS zero_pct,
 CASE WHEN sum(zeros) * 100.0 / sum(d) > 80 THEN 'severe' WHEN sum(zeros) * 100.0 / sum(d) > 50 THEN 'high' ELSE 'normal' END AS zero_band FROM p""")
def value_audit(spark, sf):
    return rounded(O.value_audit(_damaged(vectors(spark, sf))))


@query(f"""WITH {EMB}, d AS (SELECT sample_id, {DAMAGED} AS v FROM emb)
SELECT sample_id, len(list_filter(v, lambda x: NOT isfinite(x))) > 0 AS invalid, {s6('list_sum(list_transform(v, lambda x: CASE WHEN isfinite(x) THEN x ELSE 0.0 END))')} AS total FROM d""")
def sanitize(spark, sf):
    clean = V.sanitize(F.col("v"))
    return _damaged(vectors(spark, sf)).select(
        "sample_id", V.has_invalid(F.col("v")).alias("invalid"), r6(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"WITH {LONG} SELECT dim, {s6('min(x)')} AS min_x, {s6('max(x)')} AS max_x, {s6('max(x) - min(x)')} AS range_x FROM long GROUP BY dim")
def dim_ranges(spark, sf):
    return rounded(O.dim_ranges(vectors(spark, sf)))


@query(f"""WITH {LONG}, r AS (SELECT dim, max(x) - min(x) AS g FROM long GROUP BY dim)
SELECT {s6('min(g)')} AS min_range, {s6('max(g)')} AS max_range, max(g) / (min(g) + 1e-10) > 100.0 AS wide_spread FROM r""")
def range_summary(spark, sf):
    return rounded(O.range_summary(O.dim_ranges(vectors(spark, sf))))


@query(f"WITH {EMB} SELECT {s6('min(v[8])')} AS min_x, {s6('max(v[8])')} AS max_x, {s6('avg(v[8])')} AS mean_x, {s6('stddev_pop(v[8])')} AS sd_x FROM emb")
def column_stats(spark, sf):
    return rounded(O.column_stats(vectors(spark, sf), 7))


@query("""SELECT c_custkey AS sample_id, CAST(s.region AS BIGINT) AS label FROM customer
 JOIN (SELECT s_nationkey AS ext_id, any_value(n_regionkey) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey) s ON c_nationkey = s.ext_id""")
def relabel(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ext_id"), F.col("n_regionkey").cast("long").alias("class_idx"))
    used = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("ext_id"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("label"))
    return O.relabel(customers, nation.join(used, "ext_id", "left_semi"))


@query(f"WITH {EMB} SELECT DISTINCT label FROM emb WHERE label NOT IN (SELECT r_regionkey FROM region)")
def new_classes(spark, sf):
    model = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("class"))
    return O.new_classes(vectors(spark, sf), model)


@query(f"""WITH {EMB}, m AS (SELECT DISTINCT label AS class FROM emb), s AS (SELECT CAST(r_regionkey AS BIGINT) * 3 AS class FROM region)
SELECT coalesce(m.class, s.class) AS class, CASE WHEN s.class IS NULL THEN 'missing' WHEN m.class IS NULL THEN 'orphan' ELSE 'both' END AS state FROM m FULL JOIN s ON m.class = s.class""")
def reconcile_catalog(spark, sf):
    listed = vectors(spark, sf).select(F.col("label").alias("class"))
    found = table(spark, sf, "region").select((F.col("r_regionkey").cast("long") * 3).alias("class"))
    return O.reconcile_catalog(listed, found)


@query(f"WITH {PARTS} SELECT label, count(*) AS n FROM (SELECT label FROM train UNION ALL SELECT 999 FROM test) GROUP BY label")
def append_vectors(spark, sf):
    train, test = parts(spark, sf)
    return O.append_vectors(train, test, 999).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {EMB}, p AS (SELECT a.sample_id, a.v AS a, b.v AS b FROM emb a JOIN emb b ON b.sample_id = a.sample_id + 1)
SELECT sample_id, {s6('list_dot_product(a, b)')} AS dot, {s6('sqrt(greatest(list_dot_product(a, a), 1e-12))')} AS norm,
 {s6('list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))')} AS cosine,
 {s6('sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))')} AS distance FROM p""")
def pair_functions(spark, sf):
    df = vectors(spark, sf)
    after = df.select((F.col("sample_id") - 1).alias("sample_id"), F.col("v").alias("b"))
    a, b = F.col("v"), F.col("b")
    return df.join(after, "sample_id").select(
        "sample_id", r6(V.dot(a, b)).alias("dot"), r6(V.l2_norm(a)).alias("norm"), r6(V.cosine(a, b)).alias("cosine"),
        r6(V.euclidean(a, b)).alias("distance"))


def _measured(column):
    """Weighted sum and square sum of a vector: a short stand-in for its values."""
    ramp = F.transform(column, lambda x, i: (i + 1).cast("double"))
    return r6(V.dot(column, ramp), 5).alias("weighted"), r6(V.sum_squares(column), 5).alias("squares")


def _measured_sql(expr, source="emb", extra="sample_id"):
    return (f"SELECT {extra}, {s6('list_sum(list_transform(w, lambda x, i: x * i))', 5)} AS weighted, {s6('list_dot_product(w, w)', 5)} AS squares "
            f"FROM (SELECT {extra}, {expr} AS w FROM {source})")


@query(f"WITH {EMB} " + _measured_sql("(CASE WHEN sqrt(list_dot_product(v, v)) * 3 > 1e-8 THEN list_transform(v, lambda x: x * 3 / (sqrt(list_dot_product(v, v)) * 3)) ELSE v END)"))
def l2_normalize(spark, sf):
    tripled = F.transform("v", lambda x: x * 3)
    return vectors(spark, sf).select("sample_id", *_measured(V.l2_normalize(tripled)))


@query(f"WITH {EMB} " + _measured_sql("(CASE WHEN list_sum(list_transform(v, lambda x: abs(x))) > 1e-10 THEN list_transform(v, lambda x: abs(x) / list_sum(list_transform(v, lambda y: abs(y)))) ELSE list_transform(v, lambda x: 0.0) END)"))
def sum_normalize(spark, sf):
    return vectors(spark, sf).select("sample_id", *_measured(V.sum_normalize(F.transform("v", F.abs))))


_BLOCK = "list_transform(v[b * 16 + 1 : b * 16 + 16], lambda x: sqrt(abs(x) + 1e-8))"


@query(f"""WITH {EMB}, blocks AS (SELECT sample_id, b, {_BLOCK} AS r FROM emb, range(4) t(b)),
unit AS (SELECT sample_id, b, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS u FROM blocks),
whole AS (SELECT sample_id, flatten(list(u ORDER BY b)) AS v FROM unit GROUP BY sample_id) """ + _measured_sql("v", "whole"))
def root_l2_blocks(spark, sf):
    return vectors(spark, sf).select("sample_id", *_measured(V.root_l2_blocks(F.transform("v", F.abs), 16)))


@query(f"WITH {EMB} " + _measured_sql("list_concat(v, list_transform(v, lambda x: x * x))"))
def poly_expand(spark, sf):
    return vectors(spark, sf).select("sample_id", *_measured(V.poly_expand(F.col("v"))))


@query(f"""WITH {LONG}, c AS (SELECT label, dim, avg(x) AS w FROM long GROUP BY label, dim), m AS (SELECT dim, avg(x) AS m FROM long GROUP BY dim)
SELECT long.sample_id, c.label AS comp, {s6('sum((x - m) * w)')} AS y FROM long JOIN m USING (dim) JOIN c USING (dim) GROUP BY long.sample_id, c.label""")
def project(spark, sf):
    """Class means serve as components here."""
    from idmatch.operators import reduce

    df = vectors(spark, sf)
    comps = O.class_centroids(df).agg(F.array_sort(F.collect_list(F.struct("class", "t"))).alias("p"))
    z = O.zscore_fit(df).select("mean")
    model = beside(z, comps).select(
        "mean", F.transform("p", lambda p: p["t"]).alias("components"))
    out = reduce.project_vectors(df.select("sample_id", "v"), model)
    return out.select("sample_id", F.posexplode("v").alias("comp", "y")).select("sample_id", F.col("comp").cast("long"), r6("y").alias("y"))


@query(f"""WITH c AS (SELECT label, count(*) AS pos, (SELECT count(*) FROM embeddings) - count(*) AS neg FROM embeddings GROUP BY label)
SELECT CAST(label AS BIGINT) AS label, {s6('least(greatest(sqrt(neg * 1.0 / pos) * 1.5, 1.0), 15.0)')} AS weight,
 {s6('least(greatest(ln(1 + neg * 1.0 / pos) * 1.5, 1.0), 15.0)')} AS log_weight FROM c""")
def class_weight(spark, sf):
    counts = vectors(spark, sf).groupBy("label").agg(F.count("*").alias("pos"))
    neg = counts.agg(F.sum("pos")).scalar() - F.col("pos")
    return counts.select("label", r6(V.class_weight(neg, F.col("pos"))).alias("weight"),
                         r6(V.class_weight(neg, F.col("pos"), logarithmic=True)).alias("log_weight"))
