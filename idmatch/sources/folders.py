"""Labels from file and folder names. Only paths are read, never the file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idmatch.functions import text
from idmatch.operators import exact

MIN_FILES = 7  # fixed value: files per identity
EXTENSIONS = ("mp3", "wav", "flac", "aiff")  # fixed values


def _paths(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return files.load(root).select("path")


def labeled_files(paths: DataFrame) -> DataFrame:
    """(path, ext_id, class_idx): label from the leading three digits of ``NNN_*`` names, dense class index."""
    name = F.element_at(F.split("path", "/"), -1)
    named = paths.select("path", F.when(name.rlike(r"^\d{3}_"), text.id_from_name(name)).alias("ext_id")).dropna()
    return named.join(exact.dense_index(named, "ext_id", "class_idx"), "ext_id")


def scan_labeled_files(spark: SparkSession, root: str, extension: str = "jpg") -> DataFrame:
    return labeled_files(_paths(spark, root, f"*.{extension}"))


def class_folders(paths: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, min_files: int = MIN_FILES,
                  first_digits: bool = False) -> DataFrame:
    """(path, folder, class): the parent folder is the identity.

    A numeric folder name is the id. Otherwise, with ``first_digits`` the first run of digits is (folders
    without digits are skipped), else a surrogate id above all numeric ones is given. Identities with fewer than
    ``min_files`` files are dropped.
    """
    parts = F.split("path", "/")
    suffix = F.lower(F.element_at(F.split(F.element_at(parts, -1), r"\."), -1))
    files = paths.select("path", F.element_at(parts, -2).alias("folder"), suffix.alias("__x")).filter(
        F.col("__x").isin(list(extensions))
    ).drop("__x")
    counts = files.groupBy("folder").agg(F.count("*").alias("n")).filter(F.col("n") >= min_files)
    if first_digits:
        ids = counts.select("folder", text.first_number(F.col("folder")).alias("class")).filter(F.col("class") >= 0)
    else:
        own = F.when(F.col("folder").rlike(r"^\d+$"), F.col("folder").try_cast("long"))
        ids = counts.select("folder", own.alias("own"))
        unnamed = exact.shuffled_index(ids.filter(F.col("own").isNull()), "folder", 0, "i")
        start = ids.agg(F.coalesce(F.max("own"), F.lit(0))).scalar()
        ids = ids.join(unnamed.select("folder", "i"), "folder", "left").select(
            "folder", F.coalesce("own", F.col("i") + start + 1).alias("class")
        )
    return files.join(ids, "folder").select("path", "folder", "class")


def scan_class_folders(spark: SparkSession, root: str, **options) -> DataFrame:
    return class_folders(_paths(spark, root), **options)
