"""Versioned tables: what an upsert rewrites, and what crashes, conflicts and rollbacks leave."""

import random

import pytest
from pyspark.sql import functions as F

from idmatch.sources import versions

KIND = "k string, n long, at long"


def rows_of(df):
    return sorted((r["k"] or "", r["n"], r["at"]) for r in df.collect())


def files_of(spark, root, number=None):
    return {r["file"] for r in versions.version(spark, root, number).files.collect()}


def test_an_upsert_rewrites_only_files_with_its_keys(spark, tmp_path):
    root, draw = f"{tmp_path}/t", random.Random(1)
    rows = {f"key{i}": (f"key{i}", i, 0) for i in range(400)}
    assert versions.create(spark.createDataFrame(list(rows.values()), KIND), root, ["k"], file_rows=25) == 1
    before = files_of(spark, root)
    assert 12 <= len(before) <= 16
    new = [("key7", 70, 1), ("key7", 71, 2), ("key7", 72, 1), ("fresh", 1, 1)]
    assert versions.upsert(root, spark.createDataFrame(new, KIND), "at") == 2
    after = files_of(spark, root)
    assert len(before - after) <= 2 and len(after - before) <= 2  # the file of key7, and one for a new key
    rows |= {"key7": new[1], "fresh": new[3]}
    assert rows_of(versions.read(spark, root)) == sorted(rows.values())
    for step in range(2):
        more = [(f"key{draw.randrange(500)}", -step, 5 + step) for _ in range(30)]
        versions.upsert(root, spark.createDataFrame(more, KIND), "at")
        rows |= {k: (k, n, at) for k, n, at in more}
        assert rows_of(versions.read(spark, root)) == sorted(rows.values())
    assert versions.rollback(spark, root, 1) == 5 and files_of(spark, root) == before
    assert versions.versions(spark, root) == [1, 2, 3, 4, 5] and versions.read(spark, root, 4).count() == len(rows)


def test_a_taken_version_is_a_conflict_and_leaves_the_table(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/t"
    versions.create(spark.createDataFrame([("a", 1, 0), (None, 2, 0)], KIND), root, ["k"])
    held = versions.version(spark, root)
    versions.upsert(root, spark.createDataFrame([("a", 5, 1), (None, 6, 1)], KIND), "at")
    monkeypatch.setattr(versions, "version", lambda *_: held)  # a writer that read the table before
    with pytest.raises(versions.Conflict):
        versions.upsert(root, spark.createDataFrame([("a", 9, 1)], KIND), "at")
    monkeypatch.undo()
    assert rows_of(versions.read(spark, root)) == [("", 6, 1), ("a", 5, 1)]


def test_empty_tables_and_empty_changes(spark, tmp_path):
    root, none = f"{tmp_path}/t", spark.createDataFrame([], KIND)
    versions.create(none, root, ["k"])
    assert versions.read(spark, root).count() == 0
    versions.upsert(root, none, "at")
    versions.upsert(root, spark.createDataFrame([("a", 1, 0)], KIND), "at")
    assert rows_of(versions.read(spark, root)) == [("a", 1, 0)]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"{tmp_path}/other")


def test_keys_of_two_columns(spark, tmp_path):
    root = f"{tmp_path}/t"
    versions.create(spark.range(60).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("n"), F.lit(0).cast("long").alias("at")), root, ["n", "k"], file_rows=20)
    versions.upsert(root, spark.createDataFrame([("1", 1, 9, "x"), ("1", 2, 9, "x")], "k string, n int, at int, extra string"), "at")  # narrower types, another column
    assert versions.read(spark, root).count() == 61 and versions.read(spark, root).filter("at = 9").count() == 2
