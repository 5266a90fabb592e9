"""Inputs and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.operators import split

DIMS = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, label, v) of all embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.col("label").cast("long").alias("label"), V.as_vector("embedding").alias("v")
    )


def parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of the seeded per-class split."""
    marked = split.split_ratio(vectors(spark, sf))
    return marked.filter("split = 'train'").drop("split"), marked.filter("split = 'test'").drop("split")


def probes(df: DataFrame) -> DataFrame:
    return df.select(F.col("sample_id").alias("probe_id"), "label", "v")


def r6(column: Column | str, digits: int = 6) -> Column:
    """Rounded output. The small shift sends exact ties one way, whatever order a sum was taken in."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + 10.0 ** -(digits + 3), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Rounds the named columns, or every double column."""
    chosen = set(names) or {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    long = {f.name for f in df.schema.fields if f.dataType.simpleString() == "int"}
    pick = lambda c: r6(c, digits).alias(c) if c in chosen else (F.col(c).cast("long").alias(c) if c in long else F.col(c))
    return df.select(*[pick(c) for c in df.columns])


def s6(expr: str, digits: int = 6) -> str:
    return f"(round({expr} + {10.0 ** -(digits + 3):g}, {digits}) + 0.0)"


EMB = """emb AS (SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
LONG = EMB + """, long AS (SELECT sample_id, label, CAST(unnest(range(len(v))) AS BIGINT) AS dim, unnest(v) AS x FROM emb)"""
PARTS = EMB + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY label
  ORDER BY md5(CAST(sample_id AS VARCHAR) || ':42'), sample_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM emb),
parts AS (SELECT sample_id, label, v, CASE WHEN n >= 2 AND r <= least(greatest(CAST(round(n * 0.2) AS BIGINT), 1), n - 1)
  THEN 'test' ELSE 'train' END AS split FROM ranked),
train AS (SELECT * FROM parts WHERE split = 'train'), test AS (SELECT * FROM parts WHERE split = 'test')"""


def cent(source: str) -> str:
    """Class means of a relation as CTE ``cent(class, n, t)``."""
    return f"""cent AS (SELECT class, max(n) AS n, list(m ORDER BY dim) AS t FROM (SELECT label AS class, dim, avg(x) AS m,
  count(*) AS n FROM (SELECT label, unnest(range(len(v))) AS dim, unnest(v) AS x FROM {source}) GROUP BY label, dim) GROUP BY class)"""


COS = """list_dot_product(p.v, c.t) / (sqrt(greatest(list_dot_product(p.v, p.v), 1e-12))
  * sqrt(greatest(list_dot_product(c.t, c.t), 1e-12)))"""
SCORES = PARTS + ", " + cent("train") + f""",
scores AS (SELECT p.sample_id AS probe_id, p.label, c.class, {COS} AS score FROM test p CROSS JOIN cent c),
rk AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY score DESC, class) AS rank FROM scores),
top2 AS (SELECT probe_id, any_value(label) AS label, max(CASE WHEN rank = 1 THEN class END) AS pred,
  max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN class END) AS class2,
  max(CASE WHEN rank = 2 THEN score END) AS s2, max(CASE WHEN class = label THEN score END) AS own,
  max(CASE WHEN class = label THEN rank END) AS own_rank FROM rk WHERE rank <= 2 OR class = label GROUP BY probe_id)"""
SERIES = """series AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  value AS x FROM events)"""
WAVE = SERIES + """, wave AS (SELECT series_id, idx, (x - 50.0) / 100.0 AS x FROM series)"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """1:1 verification of every test vector against class templates of the training part."""
    from idmatch.operators import vectorsets
    from idmatch.plans import login

    train, test = parts(spark, sf)
    decided = login.verify_attempts(probes(test), vectorsets.class_centroids(train), F.lit(0.1))
    return rounded(decided.drop("reason"))
