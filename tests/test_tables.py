"""Table changes, file formats and streams."""

import json
import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from idmatch.catalog import streams
from idmatch.operators import relations
from idmatch.session import durable, scratch_path, shared_dir
from idmatch.sources import folders, records, tables, text_files
from idmatch.sources.phrases import PHRASES
from idmatch.streaming import jobs
from tests.test_scores import gauss


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_insert_and_state_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, n string")
    new = spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "id long, n string")
    table, conflicts = relations.insert_unique(old, new, ["id"])
    assert rows(table, "id", "n") == [(1, "a"), (2, "b"), (3, "c")] and rows(conflicts, "id") == [(2,)]
    again, _ = relations.insert_unique(table, new, ["id"])
    assert rows(again, "id", "n") == rows(table, "id", "n")

    t0, t1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    users = spark.createDataFrame([(1, "activo", t0), (2, "inactivo", t0)], "id long, estado string, updated_at timestamp_ntz")
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    off = relations.set_state(users, users, "id", "inactivo", now)
    assert rows(off, "id", "estado", "updated_at") == [(1, "inactivo", t1), (2, "inactivo", t0)]
    later = F.lit("2025-01-01").cast("timestamp_ntz")
    assert rows(relations.set_state(off, users, "id", "inactivo", later), "id", "updated_at") == [(1, t1), (2, t0)]
    with pytest.raises(ValueError):
        relations.set_state(users, users, "id", "gone", now, allowed=relations.CREDENTIAL_STATES)


def test_upsert_and_cascade(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id long, ver long, n string")
    new = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 4, "w"), (3, 1, "z")], "id long, ver long, n string")
    assert rows(relations.upsert(old, new, ["id"], "ver"), "id", "n") == [(1, "y"), (2, "w"), (3, "z")]
    gone = spark.createDataFrame([(1,)], "id long")
    assert rows(relations.cascade_delete(old, gone, "id"), "id") == [(2,)]
    assert {r["n"]: r["id"] for r in relations.null_deleted(old, gone, "id").collect()} == {"a": None, "b": 2}


def test_outbox(spark):
    t = datetime(2024, 1, 1)
    schema = tables.OUTBOX_SCHEMA
    box = spark.createDataFrame([(2, "u", "A", "{}", t, 0), (1, "u", "A", "{}", t, 0), (3, "u", "A", "{}", t, 1)], schema)
    assert [r["id_sync"] for r in relations.pending_outbox(box).collect()] == [1, 2]
    acked = relations.ack_changes(box, spark.createDataFrame([(1,)], "id_sync long"))
    assert [r["id_sync"] for r in relations.pending_outbox(acked).collect()] == [2]
    queued = relations.enqueue_change(spark.createDataFrame([(7, "x")], "id long, n string"), "u", "INSERT", F.lit(t), "id").first()
    assert json.loads(queued["datos_json"]) == {"id": 7, "n": "x"} and queued["sincronizado"] == 0
    with pytest.raises(ValueError):
        relations.reset_tables({})


def test_phrases(spark):
    seeded = tables.seed_phrases(spark)
    assert seeded.count() == len(PHRASES) == 50 and relations.eligible_phrases(seeded).count() == 50
    used = spark.createDataFrame([(1,)] * 150 + [(2,)] * 149, "id_texto long")
    after = {r["id_texto"]: (r["contador_usos"], r["estado_texto"]) for r in relations.consume_phrase(seeded, used).collect()}
    assert after[1] == (150, "desactivado") and after[2] == (149, "activo") and after[3] == (0, "activo")
    assert rows(jobs.phrase_states(seeded, jobs.phrase_usage(used)), "id_texto", "contador_usos") == sorted((k, v[0]) for k, v in after.items())


def test_text_formats(spark, tmp_path):
    (tmp_path / "v.csv").write_text("1;2;3.9\n;;5\n\n7;8;\n1.5;;2;-4\n")
    got = rows(text_files.read_labeled_csv(spark, str(tmp_path / "v.csv")), "label", "v")
    assert got == [(-4, [1.5, 2.0]), (3, [1.0, 2.0]), (8, [7.0])]
    (tmp_path / "t.csv").write_text("3;1;x;2\nbad;1\n4\n5;;1\n")
    assert rows(text_files.read_templates(spark, str(tmp_path / "t.csv")), "class", "t") == [(3, [1.0, 0.0, 2.0]), (5, [0.0, 1.0])]
    (tmp_path / "m.txt").write_text("Etiqueta real 12 ? clase interna 3\nspeaker_id,index\n7,1\n8=2\n")
    assert rows(text_files.read_label_map(spark, str(tmp_path / "m.txt")), "ext_id", "class_idx") == [(7, 1), (8, 2), (12, 3)]
    with pytest.raises(ValueError):
        text_files.write_labeled_csv(gauss(spark).filter("label > 99"), str(tmp_path / "no"))
    (tmp_path / "z.txt").write_text("2\n1;2\n0.0;3\n")
    z = tables.read_zscore_file(spark, str(tmp_path / "z.txt")).first()
    assert z["mean"] == [1.0, 2.0] and z["sd"] == [1.0, 3.0]
    (tmp_path / "p.txt").write_text("1,2,\n3,4,\n5,6,\n")
    assert tables.read_reduction_file(spark, str(tmp_path / "p.txt")).first()["components"] == [[3.0, 4.0], [5.0, 6.0]]
    (tmp_path / "l.txt").write_text("4;1;2\n1;2\n3;4\n")
    assert tables.read_reduction_file(spark, str(tmp_path / "l.txt")).first()["mean"] == [1.0, 2.0]


def record(v, label):
    return struct.pack(f"<i{len(v)}di", len(v), *v, label)


def test_vector_records(spark, tmp_path, monkeypatch):
    path = tmp_path / "r.bin"
    path.write_bytes(b"".join(record([i, i + 0.5], i) for i in range(10)) + record([9.0, 9.0], 9)[:-3])
    monkeypatch.setattr(records, "SPLIT_BYTES", 60)
    got = rows(records.read_vector_records(spark, str(path)), "label", "v")
    assert got == [(i, [float(i), i + 0.5]) for i in range(10)]
    mixed = tmp_path / "mixed.bin"
    mixed.write_bytes(record([1.0], 1) + record([1.0, 2.0], 2) + record([3.0], 3)[:-1])
    assert rows(records.read_vector_records(spark, str(mixed), uniform=False), "label", "v") == [(1, [1.0]), (2, [1.0, 2.0])]
    bad = tmp_path / "bad.bin"
    bad.write_bytes(struct.pack("<i", 20_000) + b"x" * 100)
    with pytest.raises(Exception, match="20000"):
        records.read_vector_records(spark, str(bad)).collect()
    uneven = spark.createDataFrame([([1.0], 1), ([1.0, 2.0], 2)], "v array<double>, label int")
    with pytest.raises(Exception, match="dimensions"):
        records.write_vector_records(uneven, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*.bin")] if (tmp_path / "out").exists() else True
    even = spark.createDataFrame([([1.0, 2.0], 1)], "v array<double>, label int")
    for mode in ("append", "append", "overwrite"):
        records.write_vector_records(even, str(tmp_path / "ok"), mode)
    assert records.read_vector_records(spark, str(tmp_path / "ok")).count() == 1


def test_hex_vectors(spark):
    df = spark.createDataFrame([("\\x000000000000f03f",), ("000000000000f03f",), ("\\x00",), ("\\xzz",), ("\\x",)], "t string")
    got = [r["v"] for r in df.select(tables.decode_vector(F.col("t")).alias("v")).collect()]
    assert got == [[1.0], None, None, None, []]
    back = spark.createDataFrame([([1.0, -2.5],)], "v array<double>").select(tables.encode_vector(F.col("v")).alias("t")).first()["t"]
    assert back == "\\x" + struct.pack("<2d", 1.0, -2.5).hex()


def test_folder_scans(spark, tmp_path):
    for name in ("007_a.jpg", "003_b.jpg", "x_c.jpg", "003_d.png"):
        (tmp_path / name).write_text("x")
    got = folders.scan_labeled_files(spark, str(tmp_path))
    assert rows(got, "ext_id", "class_idx") == [(3, 0), (7, 1)]
    for folder, n in (("12", 7), ("ana", 8), ("bob", 3)):
        (tmp_path / "d" / folder).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "d" / folder / f"{i}.wav").write_text("x")
    got = folders.scan_class_folders(spark, str(tmp_path / "d")).groupBy("folder", "class").count()
    assert rows(got, "folder", "class", "count") == [("12", 12, 7), ("ana", 13, 8)]


def test_models_on_disk(spark, tmp_path):
    model = spark.createDataFrame([(1, [1.0, 2.0], 0.5), (4, [3.0, 4.0], -0.5)], "class long, w array<double>, b double")
    tables.save_model(model, str(tmp_path / "m"))
    assert rows(tables.load_model(spark, str(tmp_path / "m")), "class", "b") == [(1, 0.5), (4, -0.5)]
    model.limit(1).write.mode("overwrite").parquet(str(tmp_path / "m" / "classes"))
    with pytest.raises(ValueError):
        tables.load_model(spark, str(tmp_path / "m"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "class_4.bin").write_bytes(struct.pack("<i6d", 2, 3.0, 4.0, -0.5, 0.1, 0.2, 0.3))
    assert rows(tables.load_class_files(spark, str(tmp_path / "c")), "class", "w", "b", "thr") == [(4, [3.0, 4.0], -0.5, 0.3)]
    body = struct.pack("<Qi", 2, 2) + struct.pack("<i3d", 1, 1.0, 2.0, 0.5) + struct.pack("<i3d", 4, 3.0, 4.0, -0.5)
    (tmp_path / "one.bin").write_bytes(body)
    assert rows(tables.load_monolithic_model(spark, str(tmp_path / "one.bin")), "class", "w", "b") == [(1, [1.0, 2.0], 0.5), (4, [3.0, 4.0], -0.5)]
    (tmp_path / "cut.bin").write_bytes(body[:-1])
    with pytest.raises(Exception, match="truncated"):
        tables.load_monolithic_model(spark, str(tmp_path / "cut.bin")).collect()


def test_holdout_is_made_once(spark, tmp_path):
    from idmatch.operators import split

    df = gauss(spark)
    first = rows(split.ensure_holdout(df, str(tmp_path / "h")), "sample_id")
    assert len(first) == 20
    assert rows(split.ensure_holdout(df.filter("label = 0"), str(tmp_path / "h")), "sample_id") == first


def test_checkpoint_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "x").startswith(shared_dir(spark).rstrip("/"))
    df = durable(spark.range(5))
    assert df.count() == 5


PUSHES = [
    ("d1", [(1, 10, 5, [1.0, 2.0], 2), (2, None, 5, [1.0], 1)]),
    ("d1", [(1, 10, 5, [1.0, 2.0], 2), (3, 11, 6, [3.0], 1)]),
    ("d2", [(1, 12, 7, [4.0], 1)]),
]


def test_ingest_stream_in_two_steps(spark, tmp_path):
    """Two drops into the folder, a repeat across them, then the same result as the batch form."""
    src, out, bad, mark = (str(tmp_path / n) for n in ("src", "out", "bad", "mark"))
    schema = jobs.PUSH_SCHEMA
    when = datetime(2024, 1, 1)
    make = lambda ps: spark.createDataFrame([(d, when, items) for d, items in ps], schema)
    for drop in (PUSHES[:1], PUSHES[1:]):
        make(drop).write.mode("append").json(src)
        jobs.run_available(jobs.ingest_vectors(spark.readStream.schema(schema).json(src), out, bad), mark)
    stored = spark.read.parquet(out)
    assert rows(stored, "uuid_dispositivo", "id_credencial") == [("d1", 5), ("d1", 6), ("d2", 7)]
    assert stored.select("id_caracteristica").distinct().count() == 3
    assert spark.read.parquet(bad).count() == 1
    batch = jobs.push_items(make(PUSHES)).filter("valid")
    assert rows(batch, "uuid_dispositivo", "id_credencial") == rows(stored, "uuid_dispositivo", "id_credencial")


def test_delta_pull_repeats_until_the_mark_moves(spark, tmp_path):
    feed = lambda *days: spark.createDataFrame([(d, datetime(2024, 1, d)) for d in days], "id long, updated_at timestamp_ntz")
    mark = str(tmp_path / "mark")
    got, advance = jobs.delta_pull(feed(1, 2), mark)
    assert rows(got, "id") == [(1,), (2,)]
    assert rows(jobs.delta_pull(feed(1, 2), mark)[0], "id") == [(1,), (2,)]
    advance()
    got, advance = jobs.delta_pull(feed(1, 2, 3), mark)
    assert rows(got, "id") == [(3,)]
    advance()
    assert jobs.delta_pull(feed(1, 2, 3), mark)[0].count() == 0


def test_windows_and_sessions_equal_batch(spark):
    samples = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, s), x) for s, x in ((0, 1.0), (1, 0.0), (2, 1.0), (20, 2.0))],
                                    "series_id string, ts timestamp, x double")
    got = jobs.activity_sessions(samples, 0.5, "5 seconds", "1 second").collect()
    assert sorted((r["n"], r["peak"]) for r in got) == [(1, 2.0), (2, 1.0)]
    frames = jobs.window_frames(samples, "4 seconds", "2 seconds", "1 second")
    assert frames.agg(F.sum("n")).first()[0] == 8


def test_phrase_usage_reads_a_folder_and_updates_its_state_once(spark, tmp_path):
    uses = spark.range(90).select(F.col("id").alias("event_id"), (F.col("id") % 30).alias("user_id"))
    uses.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(20, 40).select(F.col("id").alias("item_id")).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = streams.phrase_usage_stream(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == [(i, 3, "activo") for i in range(20, 30)]

    events = spark.readStream.schema(uses.schema).parquet(f"{tmp_path}/events.parquet").select(F.col("user_id").alias("id_texto"))
    phrases = spark.range(40).select(F.col("id").alias("id_texto"), F.lit("activo").alias("estado_texto"), F.lit(0).alias("contador_usos"), F.lit(2).alias("limite_usos"))
    writer = jobs.phrase_usage_stream(events, phrases, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    assert sum(s["numRowsUpdated"] for p in run.recentProgress for s in p["stateOperators"]) == 30
    assert sorted(map(tuple, jobs.latest_states(spark.read.parquet(f"{tmp_path}/out")).select("id_texto", "contador_usos", "estado_texto").collect())) == [(i, 3, relations.INACTIVE) for i in range(30)]
