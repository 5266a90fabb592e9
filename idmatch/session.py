"""Session-level helpers: durable intermediate results and scratch folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Session setting that names the folder of the ``scratch`` block around a call.
SCOPE = "idmatch.scratch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="idmatch-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def durable(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a written table in the shared folder; ``options`` are those of a Parquet writer.

    Cuts lineage and fixes the rows in one pass (a checkpoint would run the last stage twice), so a lost
    executor changes nothing and later readers get column pruning.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, or under the folder of the ``scratch`` block around the call."""
    return f"{(spark.conf.get(SCOPE, None) or shared_dir(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """What runs inside the block hands rows to Python in Arrow batches of about ``size``, which stay outside the heap."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside the block go to one folder, whose path it gives; see ``drop``."""
    before, folder = spark.conf.get(SCOPE, None), scratch_path(spark, "scratch")
    spark.conf.set(SCOPE, folder)
    try:
        yield folder
    finally:
        spark.conf.set(SCOPE, before) if before else spark.conf.unset(SCOPE)


def drop(spark: SparkSession, folder: str) -> None:
    """Deletes a ``scratch`` folder once nothing that was made of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
