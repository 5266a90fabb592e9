"""Streaming queries over the event table, run to the end of the available input."""

from pyspark.sql import functions as F

from idmatch.catalog import query
from idmatch.catalog.common import SCORES, parts, probes, r6, rounded, s6, table
from idmatch.operators import vectorsets
from idmatch.session import scratch_path
from idmatch.sources.tables import decode_bytes
from idmatch.streaming import jobs


def _stream(spark, sf, name):
    """The files of a table as a stream, whether the table is one file or a folder of files."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}[.]parquet")  # a plain path must be a folder


def _run(spark, writer):
    jobs.run_available(writer, scratch_path(spark, "checkpoint"))


def _pushes(df):
    """Events of a user as device pushes: one item each, incomplete for errors, every purchase sent twice."""
    item = F.struct(
        F.col("event_id").alias("id_item"), F.when(F.col("event_type") != "error", F.col("user_id")).cast("int").alias("id_usuario"),
        F.col("event_id").cast("int").alias("id_credencial"), F.array("value", F.col("value") * 2).alias("vector_features"), F.lit(2).alias("dimension"))
    twice = F.when(F.col("event_type") == "purchase", F.array(item, item)).otherwise(F.array(item))
    return df.select(F.concat(F.lit("device-"), F.col("user_id").cast("string")).alias("uuid_dispositivo"),
                     F.col("ts").cast("timestamp").alias("enviado"), twice.alias("caracteristicas"))


@query(f"SELECT event_id AS id_credencial, user_id AS id_usuario, 2::BIGINT AS dimension, {s6('value + value * 2')} AS total FROM events WHERE event_type <> 'error'")
def ingest_vectors(spark, sf):
    out, bad = scratch_path(spark, "vectors"), scratch_path(spark, "rejects")
    _run(spark, jobs.ingest_vectors(_pushes(_stream(spark, sf, "events")), out, bad))
    v = decode_bytes(F.col("vector_features"))
    stored = spark.read.parquet(out).select("id_credencial", "id_usuario", F.col("dimension").cast("long"), v.alias("v"))
    return stored.select("id_credencial", "id_usuario", "dimension", r6(F.col("v")[0] + F.col("v")[1]).alias("total"))


@query("SELECT count(*) AS rejected FROM events WHERE event_type = 'error'")
def ingest_rejects(spark, sf):
    out, bad = scratch_path(spark, "vectors"), scratch_path(spark, "rejects")
    _run(spark, jobs.ingest_vectors(_pushes(_stream(spark, sf, "events")), out, bad))
    return spark.read.parquet(bad).agg(F.count("*").alias("rejected"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def delta_stream(spark, sf):
    out = scratch_path(spark, "delta")
    _run(spark, jobs.delta_stream(_stream(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), out))
    return spark.read.parquet(out).select("o_orderkey", "o_orderstatus")


@query(f"""WITH {SCORES} SELECT probe_id AS id_credencial, label AS id_usuario, CASE WHEN pred = label AND own >= 0.1 THEN 'exito' ELSE 'fallo' END AS resultado, {s6('coalesce(own, s1)')} AS confianza FROM top2""")
def score_stream(spark, sf):
    train, test = parts(spark, sf)
    gallery, source, audit = vectorsets.class_centroids(train), scratch_path(spark, "attempts"), scratch_path(spark, "audit")
    probes(test).write.parquet(source)
    attempts = spark.readStream.schema("probe_id long, label long, v array<double>").parquet(source)
    _run(spark, jobs.score_stream(attempts, gallery, 0.1, audit))
    return rounded(spark.read.parquet(audit).select("id_credencial", "id_usuario", "resultado", "confianza"))


def _samples(df):
    return df.select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))


@query(f"""WITH s AS (SELECT event_type AS series_id, ts, value AS x FROM events), w AS (SELECT series_id, x, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 6 HOUR AS start FROM s, (SELECT unnest(range(2)) AS k))
SELECT series_id, start AS frame_start, count(*) AS n, {s6('sqrt(avg(x * x))')} AS energy FROM w GROUP BY series_id, start
 HAVING start + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def window_frames_stream(spark, sf):
    """Sliding frames; the stream emits a frame once the watermark has passed its end."""
    out = scratch_path(spark, "frames")
    frames = jobs.window_frames(_samples(_stream(spark, sf, "events")), "12 hours", "6 hours", "1 hour")
    _run(spark, frames.writeStream.outputMode("append").foreachBatch(lambda b, i: jobs.write_batch(b, out, i)))
    back = spark.read.parquet(out)
    return back.select("series_id", F.col("window.start").cast("timestamp_ntz").alias("frame_start"), "n", r6("energy").alias("energy"))


@query(f"""WITH s AS (SELECT event_type AS series_id, ts, value AS x FROM events WHERE abs(value) >= 60.0), p AS (SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS b FROM s),
g AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ts) AS k FROM p)
SELECT series_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n, {s6('max(abs(x))')} AS peak FROM g GROUP BY series_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM s) - INTERVAL 1 HOUR""")
def segment_stream(spark, sf):
    out = scratch_path(spark, "sessions")
    sessions = jobs.activity_sessions(_samples(_stream(spark, sf, "events")), 60.0, "30 minutes", "1 hour")
    _run(spark, sessions.writeStream.outputMode("append").foreachBatch(lambda b, i: jobs.write_batch(b, out, i)))
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rounded(spark.read.parquet(out).select("series_id", ntz("start"), ntz("stop"), "n", "peak"))


@query("""WITH u AS (SELECT user_id, count(*) AS used FROM events GROUP BY user_id)
SELECT item_id AS id_texto, used AS contador_usos, CASE WHEN used >= 60 THEN 'desactivado' ELSE 'activo' END AS estado_texto FROM benchmark JOIN u ON item_id = user_id""")
def phrase_usage_stream(spark, sf):
    phrases = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id_texto"), F.lit("activo").alias("estado_texto"), F.lit(0).alias("contador_usos"), F.lit(60).alias("limite_usos"))
    out = scratch_path(spark, "usage")
    events = _stream(spark, sf, "events").select(F.col("user_id").alias("id_texto"))
    _run(spark, jobs.phrase_usage_stream(events, phrases, out))
    return jobs.latest_states(spark.read.parquet(out)).select("id_texto", "contador_usos", "estado_texto")
