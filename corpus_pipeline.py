"""A training corpus from ``documents``: quality, near duplicates, repeated passages, benchmark leaks, source mix.

Each stage works on all its predecessor kept and returns the columns of ``documents`` (the last adds ``taken``). Stages
identify a row by its doc_id and text, so rows that agree in both are one document. An empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idmatch.llm import classifier, copies, decontaminate, jaccard, mixing, substrings
from idmatch.llm.words import typed
from idmatch.session import drop, durable, scratch

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: No stage but the first and third has an SQL form that DuckDB could run on whole tables; tests hold run() against a
#: brute-force version.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The scratch folder that the last stage of each session left for its result.
_LEFT: dict[SparkSession, str] = {}


def _stage(fn: Stage) -> Stage:
    """A stage keeps its intermediate tables in a folder of its own until the next one begins: by then its result is
    written, and nothing reads them any more."""

    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if left := _LEFT.pop(spark, None):
            drop(spark, left)
        with scratch(spark) as _LEFT[spark]:
            return fn(spark, docs, sf_dir)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents with the row's uid."""
    rows = typed(docs, **COLUMNS)
    text, ident = F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(copies.LAST))
    return rows.withColumn("uid", F.xxhash64(ident, text))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for label 0 go."""
    labels = typed(spark.read.parquet(f"{sf_dir}/labels.parquet"), doc_id="long", quality="int").withColumnRenamed("quality", "label")
    return classifier.keep_good(typed(docs, **COLUMNS), labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the one with the least id stays."""
    first = jaccard.first_of_groups(docs, n=5, threshold="0.8")
    return _rows(docs).join(first, "uid", "left_semi").dropDuplicates(["uid"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 13 words that an earlier document has are cut out of the text."""
    done = substrings.substring_dedup(docs, carry=("lang", "source"))
    return done.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("uid").distinct()
    return _rows(docs).join(found, "uid", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source mix takes, with the number of words it takes of each."""
    taken = mixing.mix_sources(docs).filter("taken > 0").select("uid", "taken")
    return _rows(docs).join(taken.dropDuplicates(["uid"]), "uid").select(*COLUMNS, "taken")


STAGES = [("quality classifier", _stage(quality)), ("n-gram Jaccard join", _stage(near_duplicates)), ("substring dedup", _stage(repeated_passages)),
          ("benchmark decontamination", _stage(benchmark_leaks)), ("mixing sources", _stage(mix))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
