"""Feeds as Structured Streaming jobs whose results equal the batch operators.

Sinks write one folder per micro-batch (``batch=<id>``, overwritten), so a batch replayed after a lost
executor or driver replaces its own rows and nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from idmatch.operators import exact, relations, scoring
from idmatch.plans import login
from idmatch.sources.tables import encode_bytes

PUSH_SCHEMA = T.StructType([
    T.StructField("uuid_dispositivo", T.StringType()), T.StructField("enviado", T.TimestampType()),
    T.StructField("caracteristicas", T.ArrayType(T.StructType([
        T.StructField("id_item", T.LongType()), *relations.PUSH_ITEM.fields,
    ]))),
])
IDS_PER_BATCH = 2**40


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def push_items(pushes: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per pushed item, repeats of (device, item) removed; ``valid`` marks complete items.

    Only the keys of the watermark's span are kept as state.
    """
    items = pushes.withWatermark("enviado", delay).select(
        "uuid_dispositivo", "enviado", F.explode("caracteristicas").alias("item")
    )
    flagged = relations.validate_feed(items).select("uuid_dispositivo", "enviado", "item.*", "valid")
    return flagged.dropDuplicatesWithinWatermark(["uuid_dispositivo", "id_item"]) if pushes.isStreaming else (
        flagged.dropDuplicates(["uuid_dispositivo", "id_item"])
    )


def stored_vectors(items: DataFrame, batch_id: int) -> DataFrame:
    """Valid items in table layout with ids unique across batches and stable under replay."""
    keyed = items.filter("valid").withColumn("__k", F.concat_ws(":", "uuid_dispositivo", "id_item"))
    numbered = exact.shuffled_index(keyed, "__k", 0, "__i")
    return numbered.select(
        (F.col("__i") + batch_id * IDS_PER_BATCH).alias("id_caracteristica"), F.col("id_usuario").cast("long"),
        F.col("id_credencial").cast("long"), encode_bytes(F.col("vector_features")).alias("vector_features"),
        "dimension", F.lit("mobile").alias("origen"), "uuid_dispositivo", F.col("enviado").alias("fecha_captura"),
    )


def ingest_vectors(pushes: DataFrame, table: str, rejects: str) -> DataStreamWriter:
    """Validate, remove repeats, encode and append device pushes; incomplete items go to ``rejects``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        write_batch(stored_vectors(batch, batch_id), table, batch_id)
        write_batch(batch.filter("NOT valid"), rejects, batch_id)
        batch.unpersist()

    return push_items(pushes).writeStream.foreachBatch(store)


def delta_pull(table: DataFrame, mark_path: str, column: str = "updated_at", key: str = "feed") -> tuple[DataFrame, Callable[[], None]]:
    """Rows changed since the stored mark, and a function that advances the mark.

    Call the function only after the rows were delivered; until then a repeated pull returns them again.
    """
    spark = table.sparkSession
    mark = read_mark(spark, mark_path)
    rows = relations.changes_since(table, mark, column)
    top = relations.high_water(rows, column).first()["high_water"]

    def advance() -> None:
        if top is not None:
            spark.createDataFrame([(key, top)], T.StructType([
                T.StructField("feed", T.StringType()), T.StructField("mark", table.schema[column].dataType),
            ])).write.mode("append").parquet(mark_path)

    bounded = rows if top is None else rows.filter(F.col(column) <= F.lit(top))
    return bounded, advance


def read_mark(spark: SparkSession, path: str):
    """Latest stored mark, or None before the first pull."""
    try:
        return spark.read.parquet(path).agg(F.max("mark")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def delta_stream(changes: DataFrame, out: str) -> DataStreamWriter:
    """New files of a change feed, delivered once each; the checkpoint is the mark."""
    return changes.writeStream.foreachBatch(lambda batch, i: write_batch(batch, out, i))


def score_stream(attempts: DataFrame, gallery: DataFrame | scoring.Enrolled, threshold: float, audit: str) -> DataStreamWriter:
    """Attempts (probe_id, label, v, and id_credencial or ts where there are any) against a fixed gallery.

    The gallery is enrolled once, before the stream starts. Decisions are written in audit layout, with the attempt's
    time or else that of its micro-batch; attempts without a usable vector or claim are written as failures.
    """
    enrolled = scoring.enrol(gallery)

    def decide(batch: DataFrame, batch_id: int) -> None:
        decisions = login.verify_attempts(batch, enrolled, F.lit(threshold))
        extra = [c for c in ("id_credencial", "ts") if c in batch.columns]
        if extra:
            decisions = decisions.join(batch.select("probe_id", F.col("label").alias("claimed"), *extra).dropDuplicates(["probe_id", "claimed"]),
                                       ["probe_id", "claimed"], "left")
        write_batch(audit_of(decisions), audit, batch_id)

    return attempts.writeStream.foreachBatch(decide)


def audit_of(decisions: DataFrame, modality: str = "oreja") -> DataFrame:
    credential = F.col("id_credencial") if "id_credencial" in decisions.columns else F.col("probe_id")
    at = F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()) if "ts" in decisions.columns else F.current_timestamp()
    named = decisions.select(
        credential.alias("id_credencial"), F.col("claimed").alias("id_usuario"),
        F.lit(modality).alias("tipo_biometria"), F.when(F.col("accepted"), "exito").otherwise("fallo").alias("resultado"),
        F.col("claimed_score").alias("confianza"), at.alias("timestamp"),
    )
    return relations.audit_rows(named)


def window_frames(samples: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """Sliding event-time frames (series_id, window, n, energy) of (series_id, ts, x)."""
    timed = samples.withWatermark("ts", delay) if samples.isStreaming else samples
    return timed.groupBy("series_id", F.window("ts", size, slide).alias("window")).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy")
    )


def activity_sessions(samples: DataFrame, level: float, gap: str, delay: str) -> DataFrame:
    """Sessions of samples at or above a fixed level, closed after ``gap`` without one.

    Adaptive levels need whole-series statistics, so the stream form takes a fixed one.
    """
    loud = samples.filter(F.abs("x") >= level)
    timed = loud.withWatermark("ts", delay) if samples.isStreaming else loud
    session = F.session_window("ts", gap).alias("session")
    return timed.groupBy("series_id", session).agg(
        F.count("*").alias("n"), F.max(F.abs("x")).alias("peak")
    ).select("series_id", F.col("session.start").alias("start"), F.col("session.end").alias("stop"), "n", "peak")


def phrase_usage(events: DataFrame, key: str = "id_texto") -> DataFrame:
    """Running use count per phrase (update mode)."""
    return events.groupBy(key).agg(F.count("*").alias("used"))


def phrase_states(phrases: DataFrame, used: DataFrame, key: str = "id_texto") -> DataFrame:
    """Phrase table after the counted uses: total, and switched off at the limit."""
    return _after_uses(phrases.join(used, key, "left"), key)


def _after_uses(met: DataFrame, key: str) -> DataFrame:
    total = F.coalesce(F.col("contador_usos"), F.lit(0)) + F.coalesce(F.col("used"), F.lit(0))
    off = F.col("used").isNotNull() & (total >= F.coalesce(F.col("limite_usos"), F.lit(relations.USE_LIMIT)))
    state: Column = F.when(off, relations.INACTIVE).otherwise(F.col("estado_texto"))
    return met.select(key, total.cast("long").alias("contador_usos"), state.alias("estado_texto"), "limite_usos")


def phrase_usage_stream(events: DataFrame, phrases: DataFrame, out: str, key: str = "id_texto") -> DataStreamWriter:
    """Writes the changed phrases of each micro-batch; the latest batch of a phrase is its state.

    A batch is read once: each reading runs its state update again, and two at a time commit one version of the state.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        write_batch(_after_uses(phrases.join(batch, key), key), out, batch_id)

    return phrase_usage(events, key).writeStream.outputMode("update").foreachBatch(publish)


def latest_states(written: DataFrame, key: str = "id_texto") -> DataFrame:
    """Last written row per key over all batch folders."""
    names = [c for c in written.columns if c != "batch"]
    best = F.max_by(F.struct(*names), F.col("batch").cast("long"))
    return written.groupBy(F.col(key).alias("__k")).agg(best.alias("r")).select("r.*")
