"""Tables whose versions are manifests of files: snapshots copy nothing, an upsert rewrites only files that hold its keys,
and a rollback is one atomic step.

A manifest lists a version's files with their bucket (digest of the key), rows, least and largest key, and a Bloom filter
of the keys. Data files are never changed once written; a commit writes new files and then publishes a manifest under the
next number by a rename that fails if the number is taken. So a crash at any point leaves the last version as it was, and
of two writers one gets an error and may try again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idmatch.session import durable

#: Rows of a file, about; files of a bucket after which an upsert joins them; hashes and bits a key of the Bloom filter.
FILE_ROWS, MOST_FILES, HASHES, KEY_BITS = 1_000_000, 8, 3, 10
#: Bits of one bitmap of Spark.
PART_BITS = 32768
MANIFEST = "file string, bucket long, rows long, low string, high string, parts long, bloom map<long,binary>"


class Conflict(RuntimeError):
    """Another writer published the same version first."""


@dataclass(frozen=True)
class Version:
    """A published version: its number, its files, and how its table is laid out."""

    number: int
    files: DataFrame
    keys: list[str]
    buckets: int
    schema: T.StructType


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all published versions."""
    fs, p = _fs(spark, f"{root}/_versions")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit())


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version of the table, the latest by default."""
    if number is None:
        known = versions(spark, root)
        if not known:
            raise FileNotFoundError(f"no table at {root}")
        number = known[-1]
    head = spark.read.json(f"{root}/_versions/{number:012d}/head").first()
    files = spark.read.schema(MANIFEST).parquet(f"{root}/_versions/{number:012d}/files")
    return Version(number, files, list(head["keys"]), head["buckets"], T._parse_datatype_json_string(head["schema"]))


def _publish(spark: SparkSession, root: str, number: int, files: DataFrame, keys: Sequence[str], buckets: int, schema: T.StructType) -> int:
    draft = f"{root}/_drafts/{uuid.uuid4().hex}"
    files.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.parquet(f"{draft}/files")
    spark.createDataFrame([(list(keys), buckets, schema.json())], "keys array<string>, buckets long, schema string").coalesce(1).write.json(f"{draft}/head")
    fs, target = _fs(spark, f"{root}/_versions/{number:012d}")
    fs.mkdirs(target.getParent())
    # a rename onto a folder that exists would move into it, so the name is tested; where both writers pass the test, one rename nests and is undone
    if fs.exists(target) or not fs.rename(_fs(spark, draft)[1], target):
        raise Conflict(f"version {number} of {root} is taken")
    nested = _fs(spark, f"{root}/_versions/{number:012d}/{draft.rsplit('/', 1)[1]}")[1]
    if fs.exists(nested):
        fs.delete(nested, True)
        raise Conflict(f"version {number} of {root} is taken")
    return number


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def _text(keys: Sequence[str]) -> Column:
    """The first key as text, for the range of a file; a null key is the empty text."""
    return F.coalesce(F.col(keys[0]).cast("string"), F.lit(""))


def _bits(keys: Sequence[str], parts: Column) -> Column:
    """Places of a key in a Bloom filter of so many bitmaps."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), parts * PART_BITS) for i in range(HASHES)])


def _described(spark: SparkSession, path: str, keys: Sequence[str], schema: T.StructType) -> DataFrame:
    """Manifest rows of the files written under ``path``; reads their keys alone."""
    rows = spark.read.schema(schema).parquet(path).select(*keys, F.col("_metadata.file_path").alias("file"))
    about = rows.groupBy("file").agg(F.count("*").alias("rows"), F.min(_text(keys)).alias("low"), F.max(_text(keys)).alias("high"))
    about = durable(about.withColumn("parts", F.ceil(F.col("rows") * KEY_BITS / PART_BITS).cast("long")).withColumn(
        "bucket", F.regexp_extract("file", r"/__bucket=(\d+)/", 1).cast("long")))
    at = rows.join(about.select("file", "parts"), "file").select("file", F.explode(_bits(keys, F.col("parts"))).alias("bit"))
    maps = at.groupBy("file", F.floor(F.col("bit") / PART_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % PART_BITS).alias("map"))
    return about.join(maps.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("part", "map"))).alias("bloom")), "file")


def _write(rows: DataFrame, root: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """New files of the rows, a file for each bucket they touch, and their manifest rows."""
    path, schema = f"{root}/data/{uuid.uuid4().hex}", rows.schema
    rows.withColumn("__bucket", _bucket(keys, buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(path)
    return _described(rows.sparkSession, path, keys, schema)


def create(df: DataFrame, root: str, keys: Sequence[str], file_rows: int = FILE_ROWS) -> int:
    """First version of a table at ``root``; returns its number."""
    spark, df = df.sparkSession, durable(df)
    buckets = max(1, -(-df.count() // file_rows))
    files = _write(df, root, keys, buckets) if not df.isEmpty() else spark.createDataFrame([], MANIFEST)
    return _publish(spark, root, 1, files, keys, buckets, df.schema)


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the latest by default."""
    return _rows(spark, version(spark, root, number))


def _rows(spark: SparkSession, held: Version, only: DataFrame | None = None) -> DataFrame:
    paths = [r["file"] for r in (held.files if only is None else only).select("file").collect()]
    return spark.read.schema(held.schema).parquet(*paths) if paths else spark.createDataFrame([], held.schema)


def touched(held: Version, new: DataFrame) -> DataFrame:
    """Manifest rows of the files that may hold a key of ``new``: same bucket, key in the range, bits set in the filter."""
    asked = new.select(*held.keys).distinct().withColumn("__bucket", _bucket(held.keys, held.buckets)).withColumn("__text", _text(held.keys))
    met = asked.join(held.files, (F.col("__bucket") == F.col("bucket")) & F.col("__text").between(F.col("low"), F.col("high")))

    def is_set(bit: Column) -> Column:
        inside = (bit % PART_BITS).cast("int")
        byte = F.conv(F.hex(F.substring(F.element_at("bloom", F.floor(bit / PART_BITS)), F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.coalesce(F.call_function("shiftright", byte, inside % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False))

    hit = met.filter(F.forall(_bits(held.keys, F.col("parts")), is_set)).select("file").distinct()
    return held.files.join(hit, "file", "left_semi")


def upsert(root: str, new: DataFrame, order: str) -> int:
    """Version with the rows of ``new`` in place of those with their keys, the latest by ``order`` among several; returns
    its number. Files without such a key stay as they are; a bucket with many files is joined into one."""
    spark, held = new.sparkSession, version(new.sparkSession, root)
    names = held.schema.names
    new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in held.schema.fields])  # a digest depends on the type
    latest = durable(new.groupBy(*[F.col(k).alias(f"__{k}") for k in held.keys]).agg(F.max_by(F.struct(*names), F.col(order)).alias("r")).select("r.*"))
    crowded = held.files.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_FILES)
    written = latest.select(_bucket(held.keys, held.buckets).alias("bucket")).distinct()
    old = durable(touched(held, latest).unionByName(held.files.join(crowded.join(written, "bucket"), "bucket", "left_semi").select(*held.files.columns)).dropDuplicates(["file"]))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in held.keys]
    kept = _rows(spark, held, old).alias("o").join(latest.alias("n"), same, "left_anti")
    merged = kept.unionByName(latest)
    files = held.files.join(old.select("file"), "file", "left_anti")
    if not latest.isEmpty():
        files = files.unionByName(_write(merged, root, held.keys, held.buckets).select(*files.columns))
    return _publish(spark, root, held.number + 1, files, held.keys, held.buckets, held.schema)


def rollback(spark: SparkSession, root: str, number: int) -> int:
    """Makes an earlier version the latest again, as a version of its own; returns its number. No data is read or copied."""
    held = version(spark, root, number)
    return _publish(spark, root, versions(spark, root)[-1] + 1, held.files, held.keys, held.buckets, held.schema)
