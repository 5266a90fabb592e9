"""Relational queries: customers stand in for users, orders for credentials and attempts."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from idmatch.catalog import query
from idmatch.catalog.common import rounded, s6, table
from idmatch.operators import relations as O
from idmatch.session import scratch_path


def _users(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id_usuario"), F.col("c_name").alias("nombres"), F.col("c_name").alias("identificador_unico"),
        F.when(F.col("c_acctbal") < 0, "inactivo").otherwise("activo").alias("estado"))


def _credentials(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id_credencial"), F.col("o_custkey").alias("id_usuario"),
        F.when(F.col("o_orderpriority") < "3", "oreja").otherwise("voz").alias("tipo_biometria"),
        F.when(F.col("o_orderstatus") == "F", "inactivo").otherwise("activo").alias("estado"), F.col("o_orderdate").alias("updated_at"))


USERS = """u AS (SELECT c_custkey AS id_usuario, c_name AS nombres, c_name AS identificador_unico, CASE WHEN c_acctbal < 0 THEN 'inactivo' ELSE 'activo' END AS estado FROM customer)"""
CREDS = """cr AS (SELECT o_orderkey AS id_credencial, o_custkey AS id_usuario, CASE WHEN o_orderpriority < '3' THEN 'oreja' ELSE 'voz' END AS tipo_biometria,
 CASE WHEN o_orderstatus = 'F' THEN 'inactivo' ELSE 'activo' END AS estado, o_orderdate AS updated_at FROM orders)"""
PHRASES = """ph AS (SELECT item_id AS id_texto, text AS frase, CASE WHEN item_id % 7 = 0 THEN 'desactivado' ELSE 'activo' END AS estado_texto, CAST(CASE WHEN item_id % 5 = 0 THEN NULL ELSE item_id * 10 END AS BIGINT) AS contador_usos,
 CAST(CASE WHEN item_id % 3 = 0 THEN NULL ELSE 200 END AS BIGINT) AS limite_usos FROM benchmark)"""


def _phrases(spark, sf):
    i = F.col("item_id")
    return table(spark, sf, "benchmark").select(
        i.alias("id_texto"), F.col("text").alias("frase"), F.when(i % 7 == 0, "desactivado").otherwise("activo").alias("estado_texto"),
        F.when(i % 5 != 0, i * 10).alias("contador_usos"), F.when(i % 3 != 0, F.lit(200)).cast("long").alias("limite_usos"))


@query(f"WITH {USERS} SELECT * FROM u WHERE identificador_unico = 'Customer#000000042'")
def lookup_user(spark, sf):
    return O.lookup_user(_users(spark, sf), "identificador_unico", "Customer#000000042")


@query(f"WITH {CREDS} SELECT * FROM cr WHERE tipo_biometria = 'voz' AND estado = 'activo'")
def active_credentials(spark, sf):
    return O.active_credentials(_credentials(spark, sf), "voz")


@query(f"WITH {CREDS} SELECT count(*) AS n, max(updated_at) AS high_water FROM cr WHERE updated_at > TIMESTAMP '1999-06-30'")
def changes_since(spark, sf):
    since = F.lit("1999-06-30").cast("timestamp_ntz")
    return O.high_water(O.changes_since(_credentials(spark, sf), since))


@query(f"WITH {PHRASES} SELECT id_texto, coalesce(contador_usos, 0) AS contador_usos, coalesce(limite_usos, 150) AS limite_usos, '' AS origen, NULL::VARCHAR AS uuid FROM ph")
def project_with_defaults(spark, sf):
    out = O.project_with_defaults(_phrases(spark, sf), {"id_texto": None, "contador_usos": 0, "limite_usos": 150, "origen": "", "uuid": None})
    return out.withColumn("uuid", F.col("uuid").cast("string"))


@query(f"WITH {PHRASES} SELECT id_texto FROM ph WHERE estado_texto = 'activo' AND coalesce(contador_usos, 0) < coalesce(limite_usos, 150)")
def eligible_phrases(spark, sf):
    return O.eligible_phrases(_phrases(spark, sf)).select("id_texto")


@query("""SELECT count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL AND event_type <> 'error') AS processed, count(*) AS total FROM events""")
def validate_feed(spark, sf):
    raw = table(spark, sf, "events").withColumn("payload", F.when(F.col("event_type") == "error", F.lit("{broken")).otherwise(F.col("props")))
    parsed = O.parse_feed(raw, "payload", T.StructType([T.StructField("k", T.LongType())]))
    return O.feed_counts(O.validate_feed(parsed, ["k"]))


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '  ' ELSE c_name END AS a, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS b FROM customer) WHERE trim(a) <> '' AND trim(b) <> ''")
def require_nonblank(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "  ").otherwise(F.col("c_name")).alias("a"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("b"))
    return O.require_nonblank(c, ["a", "b"]).select("c_custkey")


def _outbox(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id_sync"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("sincronizado"),
                    F.col("o_orderdate").alias("fecha_creacion"))


@query("SELECT o_orderkey AS id_sync, o_orderdate AS fecha_creacion FROM orders WHERE o_orderstatus = 'O'")
def pending_outbox(spark, sf):
    return O.pending_outbox(_outbox(spark, sf)).select("id_sync", "fecha_creacion")


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '","note":null}' AS json FROM region""")
def rows_to_json(spark, sf):
    return O.rows_to_json(table(spark, sf, "region").withColumn("note", F.lit(None).cast("string")))


@query(f"WITH {USERS}, {CREDS} SELECT id_usuario, nombres, id_credencial FROM u JOIN cr USING (id_usuario) WHERE u.estado = 'activo' AND cr.estado = 'activo' AND tipo_biometria = 'oreja'")
def user_credentials(spark, sf):
    users = _users(spark, sf).filter("estado = 'activo'").drop("estado")
    return O.user_credentials(users, O.active_credentials(_credentials(spark, sf), "oreja")).select("id_usuario", "nombres", "id_credencial")


@query("SELECT s_nationkey AS k, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000)")
def already_registered(spark, sf):
    new = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_name")
    known = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return O.already_registered(new, known, ["k"])


@query("SELECT doc_id AS id_texto, length(d.text) AS said, length(b.text) AS phrase FROM documents d JOIN benchmark b ON doc_id = item_id")
def attach_phrase(spark, sf):
    said = table(spark, sf, "documents").select(F.col("doc_id").alias("id_texto"), F.length("text").cast("long").alias("said"))
    phrase = table(spark, sf, "benchmark").select(F.col("item_id").alias("id_texto"), F.length("text").cast("long").alias("phrase"))
    return O.attach_phrase(said, phrase)


@query("SELECT o_orderkey, o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def orphan_audit(spark, sf):
    child = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return O.orphan_audit(child, table(spark, sf, "customer").filter("c_acctbal >= 0"), "k", "c_custkey")


def _deleted(spark, sf):
    return table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf):
    child = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return O.cascade_delete(child, _deleted(spark, sf), "k").select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE o_custkey END AS k FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def null_deleted(spark, sf):
    child = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return O.null_deleted(child, _deleted(spark, sf), "k")


@query("""WITH new AS (SELECT s_suppkey * 3 AS k, s_name AS name FROM supplier), old AS (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_mktsegment <> 'FURNITURE')
SELECT k, name FROM old UNION ALL SELECT k, name FROM new WHERE k NOT IN (SELECT k FROM old)""")
def insert_unique(spark, sf):
    old = table(spark, sf, "customer").filter("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("name"))
    return O.insert_unique(old, new, ["k"])[0]


@query("""SELECT k, name FROM (SELECT s_suppkey * 3 AS k, s_name AS name FROM supplier) n WHERE k IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE')""")
def insert_conflicts(spark, sf):
    old = table(spark, sf, "customer").filter("c_mktsegment <> 'FURNITURE'").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    new = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_name").alias("name"))
    return O.insert_unique(old, new, ["k"])[1]


@query("""SELECT user_id AS k, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id
 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""")
def upsert(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("event_id"))
    new = table(spark, sf, "events").select(F.col("user_id").alias("k"), "event_id")
    return O.upsert(old, new, ["k"], "event_id")


@query(f"""WITH {CREDS}, hit AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), m AS (SELECT *, id_usuario IN (SELECT c_custkey FROM hit) AND estado <> 'inactivo' AS ch FROM cr)
SELECT id_credencial, CASE WHEN ch THEN 'inactivo' ELSE estado END AS estado, CASE WHEN ch THEN TIMESTAMP '2024-02-01' ELSE updated_at END AS updated_at FROM m""")
def set_state(spark, sf):
    keys = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id_usuario"))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    out = O.set_state(_credentials(spark, sf), keys, "id_usuario", "inactivo", now, allowed=O.CREDENTIAL_STATES)
    return out.select("id_credencial", "estado", "updated_at")


@query(f"""WITH {PHRASES}, u AS (SELECT user_id AS id_texto, count(*) AS used FROM events GROUP BY user_id)
SELECT id_texto, coalesce(contador_usos, 0) + coalesce(used, 0) AS contador_usos, CASE WHEN used IS NOT NULL AND coalesce(contador_usos, 0) + used >= coalesce(limite_usos, 150) THEN 'desactivado' ELSE estado_texto END AS estado_texto
 FROM ph LEFT JOIN u USING (id_texto)""")
def consume_phrase(spark, sf):
    used = table(spark, sf, "events").select(F.col("user_id").alias("id_texto"))
    return O.consume_phrase(_phrases(spark, sf), used).select("id_texto", "contador_usos", "estado_texto")


@query("SELECT item_id FROM benchmark WHERE item_id NOT IN (SELECT r_regionkey FROM region)")
def delete_rows(spark, sf):
    gone = table(spark, sf, "region").select(F.col("r_regionkey").alias("item_id"))
    return O.delete_rows(table(spark, sf, "benchmark").select("item_id"), gone, "item_id")


@query("WITH m AS (SELECT DISTINCT label FROM embeddings WHERE label NOT IN (2, 5)) SELECT count(*) AS num_classes, 64::BIGINT AS dimension FROM m")
def drop_class(spark, sf):
    from idmatch.catalog.common import vectors
    from idmatch.operators.vectorsets import class_centroids

    model = class_centroids(vectors(spark, sf)).withColumnRenamed("t", "w")
    return rounded(O.model_metadata(O.drop_class(model, [2, 5])))


@query("""SELECT CAST(s_suppkey AS BIGINT) AS id_sync, 'supplier' AS tabla, 'UPDATE' AS accion, '{"s_suppkey":' || s_suppkey || ',"s_nationkey":' || s_nationkey || '}' AS datos_json, 0::BIGINT AS sincronizado FROM supplier""")
def enqueue_change(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    out = O.enqueue_change(rows, "supplier", "UPDATE", F.lit("2024-01-01").cast("timestamp_ntz"), "s_suppkey")
    return out.select("id_sync", "tabla", "accion", "datos_json", F.col("sincronizado").cast("long"))


@query("SELECT o_orderkey AS id_sync, CASE WHEN o_orderstatus <> 'O' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END::BIGINT AS sincronizado FROM orders")
def ack_changes(spark, sf):
    ok = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id_sync"))
    return O.ack_changes(_outbox(spark, sf), ok).select("id_sync", F.col("sincronizado").cast("long"))


@query(f"""SELECT user_id AS id_usuario, event_type AS resultado, {s6('value')} AS confianza, NULL::VARCHAR AS tipo_biometria FROM events
UNION ALL SELECT c_custkey, 'exito', {s6('c_acctbal')}, 'voz' FROM customer""")
def append_audit(spark, sf):
    """Events as decisions after the rows that the audit holds already."""
    decisions = table(spark, sf, "events").select(
        F.col("user_id").alias("id_usuario"), F.col("event_type").alias("resultado"), F.col("value").alias("confianza"))
    held = table(spark, sf, "customer").select(F.col("c_custkey").alias("id_usuario"), F.lit("exito").alias("resultado"),
                                               F.col("c_acctbal").cast("double").alias("confianza"), F.lit("voz").alias("tipo_biometria"))
    out = O.append_audit(O.audit_rows(held), decisions)
    return rounded(out.select("id_usuario", "resultado", "confianza", F.col("tipo_biometria").cast("string")))


@query("SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'usuarios', 0 UNION ALL SELECT 'textos_dinamicos_audio', 0")
def reset_tables(spark, sf):
    tables = {"usuarios": _users(spark, sf), "textos_dinamicos_audio": _phrases(spark, sf), "customer": table(spark, sf, "customer")}
    out = O.reset_tables(tables, confirm=True)
    return O.system_stats({n: df.agg(F.count("*")) for n, df in out.items()}).select(F.col("stat").alias("t"), F.col("value").alias("n"))


@query(f"""WITH {USERS}, {PHRASES} SELECT 'users' AS stat, count(*) AS value FROM u UNION ALL SELECT 'active_phrases', count(*) FROM ph WHERE estado_texto = 'activo'
 UNION ALL SELECT 'pending', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'classes', count(DISTINCT label) FROM embeddings UNION ALL SELECT 'dims', max(len(embedding)) FROM embeddings""")
def system_stats(spark, sf):
    e = table(spark, sf, "embeddings")
    return O.system_stats({
        "users": _users(spark, sf).agg(F.count("*")), "active_phrases": _phrases(spark, sf).filter("estado_texto = 'activo'").agg(F.count("*")),
        "pending": O.pending_outbox(_outbox(spark, sf)).agg(F.count("*")), "classes": e.agg(F.count_distinct("label")),
        "dims": e.agg(F.max(F.size("embedding")))})


@query("SELECT o_orderkey AS id_credencial, o_orderdate AS updated_at FROM orders")
def delta_pull(spark, sf):
    """Two pulls of one feed: everything up to a stored mark, then the rest; together every row once."""
    from idmatch.streaming import jobs

    feed = _credentials(spark, sf).select("id_credencial", "updated_at")
    mark = scratch_path(spark, "mark")
    early, advance = jobs.delta_pull(feed.filter(F.col("updated_at") <= F.lit("1999-06-30").cast("timestamp_ntz")), mark)
    advance()
    late, _ = jobs.delta_pull(feed, mark)
    return early.unionByName(late)
