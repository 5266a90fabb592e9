"""K templates per class by spherical k-means over all classes at once.

Rows stay partitioned as they are; every step meets them with the small centre table and reduces to one
partial sum per (task, class, centre). No class is collected, whatever share of the rows it holds. The
centre table is written after each step, so the plan does not grow and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.functions import vectors as V
from idmatch.session import durable

ITERATIONS = 10  # fixed value


def _pack(centres: DataFrame) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("k", "t")))
    return centres.groupBy("class").agg(packed.alias("centres"))


def _similarity(c: Column) -> Column:
    return V.dot(F.col("v"), c["t"]) / F.col("norm")


def k_templates(df: DataFrame, k: int, key: str = "sample_id", label: str = "label", v: str = "v",
                iterations: int = ITERATIONS) -> DataFrame:
    """(class, k, t, norm): unit centres; seeds are the first row, then the row least like any centre so far."""
    rows = df.select(F.col(label).alias("class"), F.col(key).alias("id"), V.as_vector(v).alias("v"))
    rows = durable(rows.withColumn("norm", V.l2_norm(F.col("v"))))  # read in every round
    unit = lambda c: V.l2_normalize(c)
    seed = rows.groupBy("class").agg(F.min_by("v", "id").alias("t"))
    centres = durable(seed.select("class", F.lit(0).alias("k"), unit(F.col("t")).alias("t")))
    for i in range(1, max(1, k)):
        near = F.array_max(F.transform("centres", _similarity))
        scored = rows.join(_pack(centres), "class").select("class", "id", "v", near.alias("near"))
        far = scored.groupBy("class").agg(F.min_by("v", F.struct("near", "id")).alias("t"))
        centres = durable(centres.unionByName(far.select("class", F.lit(i).alias("k"), unit(F.col("t")).alias("t"))))
    for _ in range(iterations):
        best = F.array_max(F.transform("centres", lambda c: F.struct(_similarity(c).alias("s"), (-c["k"]).alias("o"))))
        assigned = rows.join(_pack(centres), "class").select("class", (-best["o"]).alias("k"), "v")
        means = assigned.groupBy("class", "k").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("m"))
        moved = centres.join(means, ["class", "k"], "left")
        centres = durable(moved.select("class", "k", F.coalesce(unit(F.col("m")), F.col("t")).alias("t")))
    return centres.withColumn("norm", F.lit(1.0))
