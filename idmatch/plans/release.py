"""Publishing a change of a versioned table only if its accuracy holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idmatch.operators import linear
from idmatch.session import durable
from idmatch.sources import versions

BASELINE = "version long, accuracy double"
OUT = "version long, accuracy double, baseline double, change double, verdict string"


def stored_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(accuracy): that of the last version kept; null before the first."""
    try:
        return spark.read.schema(BASELINE).parquet(path).agg(F.max_by("accuracy", "version").alias("accuracy"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([(None,)], "accuracy double")


def release(spark: SparkSession, root: str, change: DataFrame | None, order: str, accuracy: Callable[[DataFrame], DataFrame], baseline: str, drop: float = 2.0) -> DataFrame:
    """Applies ``change`` to the table at ``root``, measures it, and keeps or takes back the version; one row.

    ``accuracy`` makes the holdout accuracy (percent, one row) of the table's rows. A version that falls more than ``drop``
    below the stored baseline is rolled back at once; one that stays becomes the baseline. Without a change the present
    version is measured. (version, accuracy, baseline, change, verdict): ``version`` is the one that counts afterwards.
    """
    before = versions.versions(spark, root)[-1]
    number = before if change is None else versions.upsert(root, change, order)
    row = durable(linear.regression_gate(accuracy(versions.read(spark, root, number)), stored_baseline(spark, baseline), drop)).first()
    if row["verdict"] == "reject":
        number = versions.rollback(spark, root, before)
    else:
        spark.createDataFrame([(number, row["accuracy"])], BASELINE).write.mode("append").parquet(baseline)
    return spark.createDataFrame([(number, row["accuracy"], row["baseline"], row["change"], row["verdict"])], OUT)
