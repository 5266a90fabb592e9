"""Seeded splits, samples and dense labels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from idmatch.operators import exact
from idmatch.operators.rows import beside

# Split sizes and ratios.
TEST_PER_CLASS = 2
TRAIN_RATIO = 0.8
HOLDOUT_RATIO = 0.20


def _named(df: DataFrame, chosen: str, rest: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col("chosen"), chosen).otherwise(rest)).drop("chosen")


def split_per_class(
    df: DataFrame, n_test: int = TEST_PER_CLASS, key: str = "sample_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """First ``n_test`` rows of a seeded shuffle per class go to test."""
    return _named(exact.mark_first(df, [label], key, seed, F.lit(n_test)), "test", "train")


def split_train_test_counts(
    df: DataFrame, n_train: int, n_test: int, key: str = "sample_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """Exactly ``n_train`` + ``n_test`` rows per class (fewer if the class is short); the rest are left out."""
    first = exact.mark_first(df, [label], key, seed, F.lit(n_train + n_test), "used").filter("used").drop("used")
    return _named(exact.mark_first(first, [label], key, seed, F.lit(n_train)), "train", "test")


def split_ratio(
    df: DataFrame, ratio: float = 0.2, key: str = "sample_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """round(n * ratio) test rows per class, kept within 1..n-1; a one-row class stays in train."""
    n = F.col("n")
    wanted = F.least(F.greatest(F.round(n * ratio).cast("long"), F.lit(1)), n - 1)
    return _named(exact.mark_first(df, [label], key, seed, F.when(n < 2, 0).otherwise(wanted)), "test", "train")


def split_train_ratio(
    df: DataFrame, ratio: float = TRAIN_RATIO, key: str = "sample_id", label: str = "label", seed: int = 42
) -> DataFrame:
    """floor(n * ratio) train rows per class, at least 1 and fewer than n."""
    n = F.col("n")
    floor = F.greatest(F.floor(n * ratio), F.lit(1))
    wanted = F.when(floor >= n, n - 1).otherwise(floor)
    return _named(exact.mark_first(df, [label], key, seed, wanted), "train", "test")


def fixed_holdout(df: DataFrame, ratio: float = HOLDOUT_RATIO, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """Marks a global seeded sample of round(n * ratio) rows, at least one."""
    n = F.col("n")
    wanted = F.greatest(F.lit(1), F.least(F.round(n * ratio).cast("long"), n))
    return exact.mark_first(df, [], key, seed, wanted, "holdout")


def ensure_holdout(df: DataFrame, path: str, ratio: float = HOLDOUT_RATIO, key: str = "sample_id",
                   seed: int = 42, v: str = "v") -> DataFrame:
    """The stored holdout at ``path``; written on first use and reused afterwards.

    Beside the rows lies one row of metadata (seed, ratio, total rows, holdout size, dims), written last. A holdout
    without it, or with another number of rows than it says, is half-written or damaged and is made anew.
    """
    spark = df.sparkSession
    stored = f"{path.rstrip('/')}/seed={seed}"
    facts = f"{path.rstrip('/')}/facts-seed={seed}"
    known = _stored(spark, facts)
    rows = _stored(spark, stored, df.schema) if known is not None else None
    if rows is None or known.first()["size"] != rows.count():
        fixed_holdout(df, ratio, key, seed).filter("holdout").drop("holdout").write.mode("overwrite").parquet(stored)
        rows = spark.read.schema(df.schema).parquet(stored)
        dims = F.max(F.size(v)).cast("long") if v in df.columns else F.lit(None).cast("long")
        total = df.agg(F.count("*").alias("total"), dims.alias("dims"))
        beside(total, rows.agg(F.count("*").alias("size"))).select(
            F.lit(seed).cast("long").alias("seed"), F.lit(float(ratio)).alias("ratio"), "total", "size", "dims").write.mode("overwrite").parquet(facts)
    return rows


def _stored(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame | None:
    """The table at a path, None where nothing is."""
    try:
        found = (spark.read.schema(schema) if schema else spark.read).parquet(path)
        return None if found.isEmpty() and schema is None else found
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cap_per_class(
    df: DataFrame, n: int, key: str = "sample_id", label: str = "label", seed: int | None = 42
) -> DataFrame:
    """At most ``n`` rows per class: a seeded pick, or the first by key when ``seed`` is None.

    The unseeded form filters a row number, which Spark turns into a per-task group limit before the
    shuffle: a task sends at most ``n`` rows of a class.
    """
    if seed is None:
        ranked = df.withColumn("__r", F.row_number().over(W.partitionBy(label).orderBy(key)))
        return ranked.filter(F.col("__r") <= n).drop("__r")
    return exact.mark_first(df, [label], key, seed, F.lit(n)).filter("chosen").drop("chosen")


def dense_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Label map (ext_id, class_idx): sorted distinct labels numbered from 0."""
    return exact.dense_index(df, label, "class_idx").withColumnRenamed(label, "ext_id")


def next_id(existing: DataFrame, new: DataFrame, id_column: str, key: str, seed: int = 0) -> DataFrame:
    """New rows numbered from max(id) + 1 (from 1 on an empty table), in a seeded order of ``key``."""
    start = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).scalar()
    indexed = exact.shuffled_index(new, key, seed, "__i")
    return indexed.withColumn(id_column, start + F.col("__i") + 1).drop("__i")


def random_phrase(eligible: DataFrame, key: str, seed: int) -> DataFrame:
    """One eligible row, chosen by the seed; a top-1 per task, then of those."""
    return eligible.orderBy(exact.shuffle_key(F.col(key), seed), key).limit(1)


def rank_classes(df: DataFrame, measure: str, key: str = "class", top: int | None = None) -> DataFrame:
    """Rows by a measure, largest first, ties by key."""
    ordered = df.orderBy(F.desc(measure), key)
    return ordered if top is None else ordered.limit(top)
