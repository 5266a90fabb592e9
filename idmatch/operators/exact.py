"""Exact ranks, selections and quantiles that never put one group into one task.

A window over ``partitionBy(group)`` sorts a whole group in a single task, so a group holding a third
of all rows would decide the run time. Every function here first splits a group by a bucket that is
monotone in the wanted order, counts the buckets (a map-side combined aggregate), and then sorts only
inside a bucket, or only the one bucket that holds the wanted rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idmatch.functions.draws import shuffle_bucket, shuffle_key

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4096
LABEL_RUN = 65_536

BUCKET = "__bucket"
OFFSET = "__offset"


def running_offset(counts: DataFrame, by: Sequence[str], n: str) -> DataFrame:
    """Rows before each bucket of a group. ``counts`` holds one row per (group, bucket)."""
    w = W.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy(BUCKET)
    before = F.sum(n).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(n)
    return counts.withColumn(OFFSET, before)


def _cuts(df: DataFrame, column: str, rows_per_bucket: int) -> list[float]:
    """Quantile cut points of a numeric column; a value that fills several buckets appears several times.

    One aggregate finds the row count and the cut points; only those (at most ``MAX_BUCKETS``) reach the
    driver. A small table has none.
    """
    shares = ", ".join(f"{i / MAX_BUCKETS}D" for i in range(1, MAX_BUCKETS))  # one parsed literal list
    cuts = F.expr(f"percentile_approx(`{column}`, array({shares}), {10 * MAX_BUCKETS})")
    found = df.agg(F.count("*").alias("n"), cuts.alias("cuts")).first()
    buckets = min(MAX_BUCKETS, found["n"] // rows_per_bucket + 1)
    grid = found["cuts"] or []
    return sorted(float(grid[i * MAX_BUCKETS // buckets - 1]) for i in range(1, buckets)) if grid else []


def _cut_at(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    distinct = sorted(set(cuts))
    if not distinct:
        return df.withColumn(name, F.lit(0.0))
    splits = [-float("inf"), *distinct, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol=name, handleInvalid="keep").transform(df)


def equi_depth(df: DataFrame, column: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``__bucket``: equal-depth ranges of a numeric column over the whole table.

    Ranges are cut at quantiles of all rows, so a group that holds a third of the rows spreads over
    about a third of the buckets.
    """
    return _cut_at(df, column, _cuts(df, column, rows_per_bucket), BUCKET)


def equi_depth_pair(df: DataFrame, column: str, tie: str, rows_per_bucket: int) -> DataFrame:
    """``__bucket`` monotone in (column, tie): a value repeated over several buckets is cut again by ``tie``."""
    cuts = _cuts(df, column, rows_per_bucket)
    heavy = sorted({c for c in cuts if cuts.count(c) > 1})
    coarse = _cut_at(df, column, cuts, BUCKET)
    if not heavy:
        return coarse
    ties = df.filter(F.col(column).isin(heavy)).withColumn("__tie", F.col(tie).cast("double"))
    fine_cuts = _cuts(ties, "__tie", rows_per_bucket)
    fine = _cut_at(coarse.withColumn("__tie", F.col(tie).cast("double")), "__tie", fine_cuts, "__fine")
    # A heavy value opens its bucket, so its rows come before the rest of the bucket.
    part = F.when(F.col(column).isin(heavy), F.col("__fine")).otherwise(float(MAX_BUCKETS))
    return fine.withColumn(BUCKET, F.col(BUCKET) * (2.0 * MAX_BUCKETS) + part).drop("__tie", "__fine")


def row_index(df: DataFrame, by: Sequence[str], order: str, tie: str, name: str = "idx",
              rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Dense 0-based position of each row in its group, by (``order``, ``tie``); both numeric.

    Use epoch microseconds for times.
    """
    keyed = df.withColumn("__order", F.col(order).cast("double"))
    bucketed = equi_depth_pair(keyed, "__order", tie, rows_per_bucket).drop("__order")
    offsets = running_offset(bucketed.groupBy(*by, BUCKET).agg(F.count("*").alias("__n")), by, "__n")
    within = F.row_number().over(W.partitionBy(*by, BUCKET).orderBy(order, tie))
    return (
        bucketed.withColumn("__pos", within)
        .join(offsets.select(*by, BUCKET, OFFSET), [*by, BUCKET])
        .withColumn(name, (F.col("__pos") + F.col(OFFSET) - 1).cast("long"))
        .drop("__pos", OFFSET, BUCKET)
    )


def shuffled_index(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """Dense 0-based position of each row in a seeded shuffle of the whole table."""
    keyed = df.withColumn("__digest", shuffle_key(F.col(key), seed))
    keyed = keyed.withColumn(BUCKET, shuffle_bucket(F.col("__digest")))
    offsets = running_offset(keyed.groupBy(BUCKET).agg(F.count("*").alias("__n")), [], "__n")
    within = F.row_number().over(W.partitionBy(BUCKET).orderBy("__digest", key))
    return (
        keyed.withColumn("__pos", within)
        .join(offsets.select(BUCKET, OFFSET), BUCKET)
        .withColumn(name, (F.col("__pos") + F.col(OFFSET) - 1).cast("long"))
        .drop("__pos", OFFSET, BUCKET, "__digest")
    )


def dense_index(labels: DataFrame, label: str, name: str) -> DataFrame:
    """0..K-1 over distinct integer labels in ascending order."""
    distinct = labels.select(label).filter(F.col(label).isNotNull()).distinct()
    keyed = distinct.withColumn(BUCKET, F.floor(F.col(label) / LABEL_RUN))
    offsets = running_offset(keyed.groupBy(BUCKET).agg(F.count("*").alias("__n")), [], "__n")
    within = F.row_number().over(W.partitionBy(BUCKET).orderBy(label))
    return (
        keyed.withColumn("__pos", within)
        .join(offsets.select(BUCKET, OFFSET), BUCKET)
        .select(label, (F.col("__pos") + F.col(OFFSET) - 1).cast("long").alias(name))
    )


def mark_first(
    df: DataFrame, by: Sequence[str], key: str, seed: int, take: Column, name: str = "chosen"
) -> DataFrame:
    """Marks, per group, the first ``take`` rows of a seeded shuffle.

    ``take`` may use the column ``n``, the row count of the group. The shuffle order is a digest, whose
    first digits are an equal-depth bucket: whole buckets below the cut are in, whole buckets above are
    out, and only the rows of the cut bucket (1 in 4096) are ranked. The final lookup joins on
    (group, bucket), so a hot group spreads over 4096 keys.
    """
    by = list(by)
    digest = shuffle_key(F.col(key), seed)
    keyed = df.withColumn("__digest", digest).withColumn(BUCKET, shuffle_bucket(F.col("__digest")))
    slim = keyed.select(*by, key, "__digest", BUCKET)
    counts = running_offset(slim.groupBy(*by, BUCKET).agg(F.count("*").alias("__n")), by, "__n")
    totals = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    plan = (
        counts.withColumn("n", F.sum("__n").over(totals))
        .withColumn("__rest", take.cast("long") - F.col(OFFSET))
        .select(*by, BUCKET, "__n", "__rest")
    )
    split_bucket = (F.col("__rest") > 0) & (F.col("__rest") < F.col("__n"))
    ranked = slim.join(plan.filter(split_bucket), [*by, BUCKET]).withColumn(
        "__pos", F.row_number().over(W.partitionBy(*by, BUCKET).orderBy("__digest", key))
    )
    cuts = ranked.filter(F.col("__pos") == F.col("__rest")).select(
        *by, BUCKET, F.struct(F.col("__digest").alias("d"), F.col(key).alias("k")).alias("__cut")
    )
    status = plan.join(cuts, [*by, BUCKET], "left")
    here = F.struct(F.col("__digest").alias("d"), F.col(key).alias("k"))
    chosen = (
        F.when(F.col("__rest") <= 0, False)
        .when(F.col("__rest") >= F.col("__n"), True)
        .otherwise(here <= F.col("__cut"))
    )
    return (
        keyed.join(status, [*by, BUCKET])
        .withColumn(name, chosen)
        .drop("__digest", BUCKET, "__n", "__rest", "__cut")
    )


def quantiles(df: DataFrame, by: Sequence[str], column: str, shares: Sequence[float]) -> DataFrame:
    """Exact interpolated quantiles, one row per group and share: (by..., share, value).

    Equal values are combined first, buckets are counted, and only buckets that hold a wanted rank are
    ordered. Matches the definition of ``percentile``.
    """
    by = list(by)
    data = df.select(*by, F.col(column).cast("double").alias("__x")).filter(F.col("__x").isNotNull())
    values = equi_depth(data, "__x").groupBy(*by, BUCKET, "__x").agg(F.count("*").alias("__c"))
    counts = values.groupBy(*by, BUCKET).agg(F.sum("__c").alias("__n"))
    totals = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    offsets = running_offset(counts, by, "__n").withColumn("__total", F.sum("__n").over(totals))
    wanted = (
        offsets.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
        .withColumn("__at", F.col("share") * (F.col("__total") - 1))
        .withColumn("__rank", F.explode(F.array_distinct(F.array(F.floor("__at"), F.ceil("__at")))))
        .filter((F.col("__rank") >= F.col(OFFSET)) & (F.col("__rank") < F.col(OFFSET) + F.col("__n")))
        .select(*by, BUCKET, OFFSET, "share", "__at", "__rank")
    )
    needed = values.join(wanted.select(*by, BUCKET, OFFSET).distinct(), [*by, BUCKET])
    w = W.partitionBy(*by, BUCKET).orderBy("__x").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = needed.withColumn("__end", F.sum("__c").over(w) + F.col(OFFSET)).withColumn(
        "__start", F.col("__end") - F.col("__c")
    )
    hits = placed.drop(OFFSET).join(wanted, [*by, BUCKET]).filter(
        (F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end"))
    )
    low = F.min("__x")
    high = F.max("__x")
    part = F.max(F.col("__at") - F.floor("__at"))
    return hits.groupBy(*by, "share").agg((low + (high - low) * part).alias("value"))


def neighbourhood(df: DataFrame, series: str, idx: str, back: int, ahead: int, run: int = 4096) -> tuple[DataFrame, W]:
    """Rows with a halo, and the window to look around in; keep only ``__own`` rows afterwards.

    A series is cut by position into runs of ``run`` rows. The rows within ``back`` (``ahead``) of a border
    are also sent to the following (preceding) run. Looking back or ahead then needs one shuffle on
    (series, run), and no task holds a whole series.
    """
    here, at = F.floor(F.col(idx) / run), F.col(idx) % run
    runs = F.array(
        here, F.when(at >= run - back, here + 1), F.when((at < ahead) & (here > 0), here - 1)
    )
    spread = df.withColumn("__run", F.explode(F.filter(runs, lambda r: r.isNotNull())))
    return spread.withColumn("__own", F.col("__run") == here), W.partitionBy(series, "__run").orderBy(idx)


def neighbour(w, idx: str, column: str, offset: int) -> Column:
    """Value at ``idx + offset``; null when that position is absent."""
    there = F.lag(idx, -offset).over(w) == F.col(idx) + offset
    return F.when(there, F.lag(column, -offset).over(w))


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__own", "__run")


def with_previous(df: DataFrame, series: str, idx: str, column: str, name: str) -> DataFrame:
    """Adds the value at ``idx - 1`` of the same series (null at the start)."""
    spread, w = neighbourhood(df, series, idx, 1, 0)
    return own_rows(spread.withColumn(name, neighbour(w, idx, column, -1)))


def running_sum(df: DataFrame, series: str, idx: str, column: str, name: str, run: int = 4096) -> DataFrame:
    """Running total of ``column`` by position: a sum inside each run plus the total of earlier runs."""
    keyed = df.withColumn(BUCKET, F.floor(F.col(idx) / run))
    offsets = running_offset(keyed.groupBy(series, BUCKET).agg(F.sum(column).alias("__n")), [series], "__n")
    w = W.partitionBy(series, BUCKET).orderBy(idx).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        keyed.withColumn("__sum", F.sum(column).over(w))
        .join(offsets.select(series, BUCKET, OFFSET), [series, BUCKET])
        .withColumn(name, F.col("__sum") + F.col(OFFSET))
        .drop("__sum", OFFSET, BUCKET)
    )
