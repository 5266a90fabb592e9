"""Source and sink queries: tables written in each stored format and read back whole."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import EMB, LONG, cent, r6, rounded, s6, table, vectors
from idmatch.functions import vectors as V
from idmatch.operators import curves, metrics, reduce, split, vectorsets
from idmatch.operators.rows import beside
from idmatch.session import scratch_path
from idmatch.sources import folders, records, tables, text_files, versions

SUMS = f"""SELECT label, count(*) AS n, CAST(min(len(v)) AS BIGINT) AS d, {s6('sum(list_sum(list_transform(v, lambda x, i: x * i)))', 4)} AS weighted FROM emb GROUP BY label"""


def _sums(df):
    ramp = F.transform("v", lambda x, i: (i + 1).cast("double"))
    return df.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("n"), F.min(F.size("v")).cast("long").alias("d"), r6(F.sum(V.dot(F.col("v"), ramp)), 4).alias("weighted"))


@query(f"WITH {EMB} {SUMS}")
def labeled_csv(spark, sf):
    path = scratch_path(spark, "labeled-csv")
    text_files.write_labeled_csv(vectors(spark, sf), path)
    return _sums(text_files.read_labeled_csv(spark, path))


def _damaged_lines(spark, sf):
    """Labelled lines as text: every tenth has a word among its numbers, every fifteenth a label that is none."""
    path = scratch_path(spark, "damaged-csv")
    rows = vectors(spark, sf)
    value = F.transform("v", lambda x, i: F.when((F.col("sample_id") % 10 == 0) & (i == 2), F.lit("bad")).otherwise(x.cast("string")))
    label = F.when(F.col("sample_id") % 15 == 0, F.lit("oops")).otherwise(F.col("label").cast("string"))
    rows.select(F.concat_ws(";", value, label).alias("value")).write.text(path)
    return path


@query("SELECT CAST((vec_id % 10 = 0)::INT + (vec_id % 15 = 0)::INT AS BIGINT) AS bad_tokens, count(*) AS n FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 15 = 0 GROUP BY bad_tokens")
def labeled_csv_rejects(spark, sf):
    return text_files.labeled_csv_rejects(spark, _damaged_lines(spark, sf)).groupBy("bad_tokens").agg(F.count("*").alias("n"))


@query(f"WITH {EMB} {SUMS}".replace("FROM emb GROUP", "FROM emb WHERE sample_id % 10 > 0 AND sample_id % 15 > 0 GROUP"))
def labeled_csv_lenient(spark, sf):
    return _sums(text_files.read_labeled_csv(spark, _damaged_lines(spark, sf), strict=False))


@query(f"WITH {EMB} SELECT CAST(len(v) AS BIGINT) + 1 AS d, count(*) AS n FROM emb GROUP BY d")
def vector_csv(spark, sf):
    path = scratch_path(spark, "vector-csv")
    text_files.write_labeled_csv(vectors(spark, sf), path)
    return text_files.read_vector_csv(spark, path).groupBy(F.size("v").cast("long").alias("d")).agg(F.count("*").alias("n"))


@query(f"WITH {EMB}, {cent('emb')} SELECT class, CAST(len(t) AS BIGINT) AS d, {s6('list_sum(t)')} AS total FROM cent")
def templates_csv(spark, sf):
    path = scratch_path(spark, "templates")
    text_files.write_templates(vectorsets.class_centroids(vectors(spark, sf)), path)
    total = F.aggregate("t", F.lit(0.0), lambda a, x: a + x)
    return text_files.read_templates(spark, path).select("class", F.size("t").cast("long").alias("d"), r6(total).alias("total"))


@query(f"WITH {EMB} {SUMS}")
def vector_records(spark, sf):
    path = scratch_path(spark, "records")
    df = vectors(spark, sf)
    records.write_vector_records(df.filter("label < 5"), path)
    records.write_vector_records(df.filter("label >= 5"), path)  # appended
    return _sums(records.read_vector_records(spark, path))


@query(f"WITH {EMB} SELECT sample_id, CAST(len(v) AS BIGINT) AS d, {s6('list_sum(v)')} AS total FROM emb")
def hex_vectors(spark, sf):
    text = vectors(spark, sf).select("sample_id", tables.encode_vector(F.col("v")).alias("t"))
    back = text.select("sample_id", tables.decode_vector(F.col("t")).alias("v"))
    return back.select("sample_id", F.size("v").cast("long").alias("d"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN lpad((doc_id % 40)::VARCHAR, 3, '0') || '_' || doc_id || '.jpg' ELSE 'x' || doc_id || '.jpg' END AS name FROM documents),
q AS (SELECT doc_id, CAST(left(name, 3) AS BIGINT) AS ext_id FROM p WHERE regexp_matches(name, '^\\d{3}_'))
SELECT doc_id, ext_id, dense_rank() OVER (ORDER BY ext_id) - 1 AS class_idx FROM q""")
def scan_labeled_files(spark, sf):
    """File names derived from the documents; the listing itself is covered by tests."""
    name = F.when(F.col("lang") == "en", F.concat(F.lpad((F.col("doc_id") % 40).cast("string"), 3, "0"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".jpg"))
                  ).otherwise(F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(".jpg")))
    paths = table(spark, sf, "documents").select(F.concat(F.lit("/data/"), name).alias("path"))
    found = folders.labeled_files(paths)
    return found.select(F.regexp_extract("path", r"_(\d+)\.jpg$", 1).cast("long").alias("doc_id"), "ext_id", "class_idx")


@query("""WITH f AS (SELECT event_id, user_id AS class FROM events WHERE event_type IN ('view', 'click')), c AS (SELECT class FROM f GROUP BY class HAVING count(*) >= 7)
SELECT event_id, class FROM f WHERE class IN (SELECT class FROM c)""")
def scan_class_folders(spark, sf):
    ext = F.when(F.col("event_type") == "view", "WAV").when(F.col("event_type") == "click", "mp3").otherwise("txt")
    paths = table(spark, sf, "events").select(F.concat_ws("/", F.lit("/data"), F.col("user_id").cast("string"), F.concat_ws(".", F.col("event_id").cast("string"), ext)).alias("path"))
    return folders.class_folders(paths).select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("event_id"), "class")


@query("""WITH f AS (SELECT event_id, user_id AS class FROM events WHERE event_type IN ('view', 'click') AND user_id % 3 <> 0), c AS (SELECT class FROM f GROUP BY class HAVING count(*) >= 2)
SELECT event_id, class FROM f WHERE class IN (SELECT class FROM c)""")
def scan_class_folders_digits(spark, sf):
    """Folders such as ``speaker 12``; every third user has a folder without digits."""
    ext = F.when(F.col("event_type") == "view", "wav").when(F.col("event_type") == "click", "flac").otherwise("txt")
    folder = F.when(F.col("user_id") % 3 == 0, "unnamed").otherwise(F.concat(F.lit("speaker "), F.col("user_id").cast("string")))
    paths = table(spark, sf, "events").select(F.concat_ws("/", F.lit("/data"), folder, F.concat_ws(".", F.col("event_id").cast("string"), ext)).alias("path"))
    out = folders.class_folders(paths, min_files=2, first_digits=True)
    return out.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("event_id"), "class")


@query(f"WITH {EMB}, {cent('emb')} SELECT class, CAST(len(t) AS BIGINT) AS d, {s6('list_sum(t)')} AS total, {s6('n / 100.0')} AS b FROM cent")
def model_round_trip(spark, sf):
    path = scratch_path(spark, "model")
    model = vectorsets.class_centroids(vectors(spark, sf)).select("class", F.col("t").alias("w"), (F.col("n") / 100.0).alias("b"))
    tables.save_model(model, path)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    return tables.load_model(spark, path).select("class", F.size("w").cast("long").alias("d"), r6(total).alias("total"), r6("b").alias("b"))


@query(f"WITH {LONG} SELECT dim, {s6('avg(x)')} AS mean, {s6('stddev_pop(x)')} AS sd FROM long GROUP BY dim")
def params_round_trip(spark, sf):
    path = scratch_path(spark, "params")
    tables.save_params(vectorsets.zscore_fit(vectors(spark, sf)), path)
    back = tables.load_params(spark, path).select(F.posexplode(F.arrays_zip("mean", "sd")).alias("dim", "p"))
    return back.select(F.col("dim").cast("long"), r6("p.mean").alias("mean"), r6("p.sd").alias("sd"))


@query("SELECT ext_id, dense_rank() OVER (ORDER BY ext_id) - 1 AS class_idx FROM (SELECT DISTINCT CAST(label AS BIGINT) AS ext_id FROM embeddings)")
def label_map(spark, sf):
    path = scratch_path(spark, "label-map")
    text_files.write_label_map(split.dense_labels(vectors(spark, sf)), path)
    return text_files.read_label_map(spark, path)


@query("SELECT c_custkey AS id_usuario, c_name AS nombres FROM customer")
def identity_tables(spark, sf):
    """Users stored and read back under the declared schema."""
    path = scratch_path(spark, "tables")
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id_usuario"), F.col("c_name").alias("nombres"), F.lit("activo").alias("estado"))
    users.write.parquet(f"{path}/usuarios")
    return tables.read_tables(spark, path, ["usuarios"])["usuarios"].select("id_usuario", "nombres")


@query(f"SELECT event_type AS fase, CAST(count(*) AS BIGINT) AS n, {s6('max(value)')} AS t FROM events GROUP BY event_type")
def phase_log(spark, sf):
    path = scratch_path(spark, "phases")
    e = table(spark, sf, "events").select(F.lit("job").alias("nombre"), F.col("event_type").alias("fase"), F.col("value").alias("tiempo_s"),
                                          F.col("value").alias("cpu_s"), F.lit(1.0).alias("cpu_pct"), F.col("event_id").alias("ram_max_kb"))
    e.write.csv(path, header=True)
    log = text_files.read_phase_log(spark, path)
    parsed = log.withColumn("t", F.col("tiempo_s").try_cast("double")).filter("t IS NOT NULL")
    return parsed.groupBy("fase").agg(F.count("*").alias("n"), r6(F.max("t")).alias("t"))


@query(f"""WITH t AS (SELECT CAST(n_chars AS DOUBLE) AS score, quality = 1 AS genuine FROM documents JOIN labels USING (doc_id)),
b AS (SELECT min(score) AS lo, max(score) AS hi, count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS m FROM t)
SELECT {s6('lo + (hi - lo) * i / 200.0')} AS umbral, {s6('(SELECT count(*) FROM t WHERE NOT genuine AND score >= lo + (hi - lo) * i / 200.0) * 100.0 / m')} AS far,
 {s6('(SELECT count(*) FROM t WHERE genuine AND score < lo + (hi - lo) * i / 200.0) * 100.0 / g')} AS frr FROM b, (SELECT unnest(range(201)) AS i)""")
def curve_report(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    truth = joined.select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("genuine"))
    path = scratch_path(spark, "curve")
    text_files.write_report(text_files.far_frr_report(curves.far_frr_curve(truth, 200)), path, ",")
    back = spark.read.schema("umbral double, FAR double, FRR double").csv(path, header=True)
    return rounded(back.select("umbral", F.col("FAR").alias("far"), F.col("FRR").alias("frr")))


@query(f"""WITH m AS (SELECT l_returnflag AS real, l_linestatus AS pred, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT DISTINCT real AS class FROM m UNION SELECT pred FROM m),
k AS (SELECT class, coalesce((SELECT sum(n) FROM m WHERE real = class AND pred = class), 0) AS tp, coalesce((SELECT sum(n) FROM m WHERE real = class), 0) AS support,
 coalesce((SELECT sum(n) FROM m WHERE pred = class), 0) AS said FROM c),
f AS (SELECT *, CASE WHEN said > 0 THEN tp * 100.0 / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp * 100.0 / support ELSE 0 END AS r FROM k)
SELECT class AS "Clase", {s6('p')} AS "Precision", {s6('r')} AS "Recall", {s6('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS "F1", CAST(support AS BIGINT) AS "Soporte" FROM f""")
def per_class_report(spark, sf):
    path = scratch_path(spark, "per-class")
    counts = metrics.confusion(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")
    text_files.write_report(text_files.per_class_report(metrics.per_class_metrics(counts)), path)
    return rounded(spark.read.schema("Clase string, Precision double, Recall double, F1 double, Soporte long").csv(path, header=True, sep=";"))


@query(f"WITH {EMB} {SUMS}")
def snapshot_rollback(spark, sf):
    """A version is taken, the current table is damaged, the version is restored."""
    root, current = scratch_path(spark, "versions"), scratch_path(spark, "current")
    df = vectors(spark, sf).select("label", "v")
    df.write.parquet(current)
    version = tables.snapshot(spark.read.parquet(current), root)
    df.filter("label > 7").write.mode("overwrite").parquet(current)
    return _sums(tables.rollback(spark, root, version, current))


def _customers(spark, sf):
    """A versioned table of customers, then one with the last event of each user in their place: (root, numbers of both)."""
    root = scratch_path(spark, "customers")
    old = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.lit(-1).cast("long").alias("event_id"))
    first = versions.create(old, root, ["k"], file_rows=max(1, old.count() // 16))
    return root, first, versions.upsert(root, table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id"), "event_id")


@query("""SELECT user_id AS k, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id
 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def versioned_upsert(spark, sf):
    root, _, last = _customers(spark, sf)
    return versions.read(spark, root, last)


@query("SELECT c_custkey AS k, -1::BIGINT AS event_id FROM customer")
def versioned_rollback(spark, sf):
    """The first version again, by one published manifest."""
    root, first, _ = _customers(spark, sf)
    return versions.read(spark, root, versions.rollback(spark, root, first))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN 1 ELSE -1 END::BIGINT AS event_id, true AS one_file FROM customer")
def versioned_touch(spark, sf):
    """A change of one key: the table after it, and whether exactly one file gave way to one other."""
    root, first, _ = _customers(spark, sf)
    versions.rollback(spark, root, first)
    one = table(spark, sf, "customer").agg(F.min("c_custkey").alias("k")).withColumn("event_id", F.lit(1))
    last = versions.upsert(root, one, "event_id")
    before, after = (versions.version(spark, root, n).files.select("file") for n in (first, last))
    gone, come = before.exceptAll(after).count(), after.exceptAll(before).count()
    return versions.read(spark, root).withColumn("one_file", F.lit(gone == 1 and come == 1))


@query("SELECT item_id AS id_texto, text AS frase, 'activo' AS estado_texto FROM benchmark")
def seed_phrases(spark, sf):
    """Benchmark texts as the phrase list; the list of stored phrases is covered by tests."""
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id_texto"), F.col("text").alias("frase"))
    return tables.phrase_rows(rows).select("id_texto", "frase", "estado_texto")


@query(f"WITH {EMB} SELECT sample_id, {', '.join(f'{s6(f"v[{i + 1}]")} AS f{i}' for i in range(64))} FROM emb")
def feature_csv(spark, sf):
    path = scratch_path(spark, "features")
    text_files.write_report(text_files.feature_csv(vectors(spark, sf), 64, ids=("sample_id",)), path, ",")
    return rounded(spark.read.schema("sample_id long, " + ", ".join(f"f{i} double" for i in range(64))).csv(path, header=True))


COVARIANCE = f"""{LONG}, m AS (SELECT dim, avg(x) AS m FROM long GROUP BY dim), z AS (SELECT sample_id, dim, x - m AS x FROM long JOIN m USING (dim)),
cov AS (SELECT a.dim AS i, b.dim AS j, sum(a.x * b.x) / ((SELECT count(*) FROM emb) - 1) AS c FROM z a JOIN z b USING (sample_id) GROUP BY a.dim, b.dim)"""


@query(f"""WITH {COVARIANCE} SELECT 64::BIGINT AS components, 64::BIGINT AS d, {s6('sum(c) FILTER (i = j)')} AS total, {s6('sum(c * c)')} AS squares,
 (SELECT {s6('sum(m)')} FROM m) AS mean_total FROM cov""")
def reduction_params(spark, sf):
    """A full reduction stored and read back: its eigenvalues add up to the trace of the covariance, their squares to its norm."""
    path = scratch_path(spark, "pca")
    tables.save_params(reduce.pca_fit(vectors(spark, sf), 64), path)
    model = tables.load_params(spark, path)
    total = F.aggregate("mean", F.lit(0.0), lambda a, x: a + x)
    back = reduce.component_table(model).agg(F.count("*").alias("components"), F.max(F.size("c")).cast("long").alias("d"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    return rounded(beside(back, model.select(total.alias("mean_total"))))
