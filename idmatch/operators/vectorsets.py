"""Labelled vector tables: shape changes, guards, per-dimension and per-class statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.operators import exact
from idmatch.operators.rows import beside

# Guards and report bands.
SD_FLOOR = 1e-10
FEW_ROWS = (10, 20)
IMBALANCE_BANDS = (2.0, 5.0, 10.0)
ZERO_BANDS = (50.0, 80.0)
SPREAD_LIMIT = 100.0
RANGE_EPS = 1e-10


def to_long(df: DataFrame, ids: Iterable[str], v: str = "v") -> DataFrame:
    """One row per value: (ids..., dim, x)."""
    return df.select(*ids, F.posexplode(v).alias("dim", "x"))


def to_wide(df: DataFrame, ids: Iterable[str], v: str = "v") -> DataFrame:
    """Inverse of :func:`to_long`; a group is one vector, so its size is the dimension."""
    ids = list(ids)
    packed = df.groupBy(*ids).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("__p"))
    return packed.select(*ids, F.transform("__p", lambda p: p["x"]).alias(v))


def dim_guard(df: DataFrame, d: int, v: str = "v") -> DataFrame:
    """Rows whose vector has the model's dimension."""
    return df.filter(F.size(v) == d)


def dim_report(df: DataFrame, d: int, v: str = "v") -> DataFrame:
    fits = F.size(v) == d
    return df.agg(F.count_if(fits).alias("kept"), F.count_if(~fits).alias("dropped"))


def filter_classes(df: DataFrame, classes: Iterable[int] | DataFrame, label: str = "label") -> DataFrame:
    """Keep listed classes; a table of classes is joined, a short list becomes a pushed filter."""
    if isinstance(classes, DataFrame):
        return df.join(classes.select(label).distinct(), label, "left_semi")
    return df.filter(F.col(label).isin(list(classes)))


def subset_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Seeded sample of exactly ``n`` rows (all rows if fewer)."""
    return exact.mark_first(df, [], key, seed, F.lit(n)).filter("chosen").drop("chosen")


def union_sets(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return out


def compat_check(train: DataFrame, test: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """One row: dimensions of both sides and the number of test classes unseen in training."""
    sizes = lambda df, side: df.agg(
        F.min(F.size(v)).alias(f"{side}_min_dim"), F.max(F.size(v)).alias(f"{side}_max_dim")
    )
    unseen = (
        test.select(label).distinct().join(train.select(label).distinct(), label, "left_anti")
        .agg(F.count("*").alias("unseen_classes"))
    )
    report = beside(sizes(train, "train"), sizes(test, "test"), unseen)
    same = (
        (F.col("train_min_dim") == F.col("train_max_dim"))
        & (F.col("test_min_dim") == F.col("test_max_dim"))
        & (F.col("train_min_dim") == F.col("test_min_dim"))
    )
    return report.withColumn("compatible", same & (F.col("unseen_classes") == 0))


def _stats(v: Column | str, *metrics: str) -> Column:
    return Summarizer.metrics(*metrics).summary(array_to_vector(V.as_vector(v)))


def zscore_fit(df: DataFrame, v: str = "v") -> DataFrame:
    """One row: arrays ``mean`` and population ``sd`` (tiny sd becomes 1).

    The summariser merges one partial vector per task, so only d values per task are shuffled.
    """
    s = df.agg(_stats(v, "mean", "variance", "count").alias("s"))
    n = F.col("s.count")
    population = lambda x: F.sqrt(F.greatest(x * (n - 1) / n, F.lit(0.0)))
    sd = F.transform(vector_to_array("s.variance"), lambda x: F.when(n > 1, population(x)).otherwise(0.0))
    return s.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(sd, lambda x: F.when(x < SD_FLOOR, 1.0).otherwise(x)).alias("sd"),
    )


def zscore_transform(df: DataFrame, params: DataFrame, v: str = "v") -> DataFrame:
    """Standardise with a one-row parameter table; rows of another dimension are dropped."""
    pair = params.select(F.struct("mean", "sd")).scalar()
    scaled = V.zscore_apply(F.col(v), F.col("__z.mean"), F.col("__z.sd"))
    return df.withColumn("__z", pair).withColumn(v, scaled).filter(F.col(v).isNotNull()).drop("__z")


def class_centroids(df: DataFrame, label: str = "label", v: str = "v") -> DataFrame:
    """Mean vector per class with its norm: (class, n, t, norm). One partial sum per task and class."""
    means = df.groupBy(F.col(label).alias("class")).agg(_stats(v, "mean", "count").alias("s"))
    t = vector_to_array("s.mean")
    return means.select("class", F.col("s.count").alias("n"), t.alias("t")).withColumn(
        "norm", V.l2_norm(F.col("t"))
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percent per class with few-row flags."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    few, some = FEW_ROWS
    return counts.select(
        "class", "n", (F.col("n") * 100.0 / total).alias("pct"),
        (F.col("n") < few).alias("under_10"), (F.col("n") < some).alias("under_20"),
    )


def balance_summary(df: DataFrame, label: str = "label") -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    low, middle, high = IMBALANCE_BANDS
    ratio = F.col("max_n") / F.col("min_n")
    band = F.when(ratio > high, "severe").when(ratio > middle, "high").when(ratio > low, "moderate")
    return counts.agg(
        F.count("*").alias("classes"), F.min("n").alias("min_n"), F.max("n").alias("max_n"),
        F.count_if(F.col("n") < FEW_ROWS[0]).alias("classes_under_10"),
        F.count_if(F.col("n") < FEW_ROWS[1]).alias("classes_under_20"),
    ).withColumn("ratio", ratio).withColumn("band", band.otherwise("balanced"))


def value_audit(df: DataFrame, v: str = "v") -> DataFrame:
    """NaN, infinite and zero values over the whole table; counted inside each row, no explode."""
    count_of = lambda test: F.size(F.filter(v, test))
    infinite = lambda x: F.abs(x) == float("inf")
    per_row = df.select(
        F.size(v).alias("d"), count_of(F.isnan).alias("nan"), count_of(infinite).alias("inf"),
        count_of(lambda x: x == 0.0).alias("zero"),
    )
    pct = F.col("zeros") * 100.0 / F.col("total")
    warn, severe = ZERO_BANDS
    return (
        per_row.agg(
            F.count("*").alias("n_rows"), F.sum("d").alias("total"), F.sum("nan").alias("nans"),
            F.sum("inf").alias("infs"), F.sum("zero").alias("zeros"),
            F.count_if(F.col("nan") + F.col("inf") > 0).alias("invalid_rows"),
        )
        .withColumn("zero_pct", pct)
        .withColumn("zero_band", F.when(pct > severe, "severe").when(pct > warn, "high").otherwise("normal"))
    )


def dim_ranges(df: DataFrame, v: str = "v") -> DataFrame:
    """Per dimension: min, max, range."""
    s = df.agg(_stats(v, "min", "max").alias("s"))
    pairs = F.arrays_zip(vector_to_array("s.min").alias("lo"), vector_to_array("s.max").alias("hi"))
    long = s.select(F.posexplode(pairs).alias("dim", "p"))
    return long.select(
        "dim", F.col("p.lo").alias("min_x"), F.col("p.hi").alias("max_x"),
        (F.col("p.hi") - F.col("p.lo")).alias("range_x"),
    )


def range_summary(ranges: DataFrame) -> DataFrame:
    return ranges.agg(
        F.min("range_x").alias("min_range"), F.max("range_x").alias("max_range")
    ).withColumn("wide_spread", F.col("max_range") / (F.col("min_range") + RANGE_EPS) > SPREAD_LIMIT)


def column_stats(df: DataFrame, dim: int, v: str = "v") -> DataFrame:
    """min, max, mean and population sd of one dimension."""
    x = F.get(F.col(v), F.lit(dim))
    return df.select(x.alias("x")).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.avg("x").alias("mean_x"),
        F.stddev_pop("x").alias("sd_x"),
    )


def relabel(df: DataFrame, label_map: DataFrame, label: str = "label") -> DataFrame:
    """External to internal label through (ext_id, class_idx); unmatched rows are dropped."""
    keyed = label_map.select(F.col("ext_id").alias(label), "class_idx")
    return df.join(keyed, label).drop(label).withColumnRenamed("class_idx", label)


def new_classes(data: DataFrame, model: DataFrame, label: str = "label") -> DataFrame:
    """Classes present in the data and absent from the model."""
    known = model.select(F.col("class").alias(label)).distinct()
    return data.select(label).distinct().join(known, label, "left_anti")


def reconcile_catalog(metadata: DataFrame, stored: DataFrame) -> DataFrame:
    """Class ids listed in metadata against class records found: both, missing or orphan."""
    listed = metadata.select("class").distinct().withColumn("__m", F.lit(True))
    found = stored.select("class").distinct().withColumn("__s", F.lit(True))
    state = F.when(F.col("__s").isNull(), "missing").when(F.col("__m").isNull(), "orphan").otherwise("both")
    return listed.join(found, "class", "full_outer").select("class", state.alias("state"))


def append_vectors(existing: DataFrame, vectors: DataFrame, label_value: int, label: str = "label") -> DataFrame:
    """Enrolment vectors appended under one label."""
    labelled = vectors.withColumn(label, F.lit(label_value).cast(existing.schema[label].dataType))
    return existing.unionByName(labelled.select(*existing.columns))
