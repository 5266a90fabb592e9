"""Identity tables, hex vectors, models, parameters, versions."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idmatch.sources.phrases import PHRASES

# Stored schemas and limits.
SCHEMAS = {
    "usuarios": "id_usuario long, nombres string, apellidos string, fecha_nacimiento date, sexo string, "
    "identificador_unico string, estado string, fecha_registro timestamp_ntz, updated_at timestamp_ntz",
    "credenciales_biometricas": "id_credencial long, id_usuario long, tipo_biometria string, "
    "fecha_captura timestamp_ntz, estado string, updated_at timestamp_ntz",
    "textos_dinamicos_audio": "id_texto long, frase string, estado_texto string, contador_usos int, "
    "limite_usos int, updated_at timestamp_ntz",
    "validaciones_biometricas": "id_validacion long, id_usuario long, id_credencial long, "
    "tipo_biometria string, ip_cliente string, ubicacion string, dispositivo string, timestamp timestamp_ntz, "
    "resultado string, confianza double",
    "caracteristicas_hablantes": "id_caracteristica long, id_usuario long, id_credencial long, "
    "vector_features binary, dimension int, origen string, uuid_dispositivo string, fecha_captura timestamp_ntz",
    "caracteristicas_oreja": "id_caracteristica long, id_usuario long, id_credencial long, "
    "vector_features binary, dimension int, origen string, uuid_dispositivo string, fecha_captura timestamp_ntz",
}
OUTBOX_SCHEMA = ("id_sync long, tabla string, accion string, datos_json string, fecha_creacion timestamp_ntz, "
                 "sincronizado int")
SD_ON_LOAD = 1e-12
PHRASE_LIMIT = 150


def read_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The identity tables below a folder, with declared schemas (no inference pass)."""
    return {n: spark.read.schema(SCHEMAS[n]).parquet(f"{root}/{n}") for n in names or SCHEMAS}


def read_table_jdbc(spark: SparkSession, url: str, name: str, key: str, bounds: tuple[int, int], partitions: int = 32,
                    **properties: str) -> DataFrame:
    """One table over JDBC, read in parallel by key range; filters and columns are pushed to the database."""
    return spark.read.jdbc(url, name, column=key, lowerBound=bounds[0], upperBound=bounds[1],
                           numPartitions=partitions, properties=properties)


def seed_phrases(spark: SparkSession, phrases: list[str] | None = None, limit: int = PHRASE_LIMIT) -> DataFrame:
    """Initial phrase table from the stored list (or another one)."""
    rows = list(enumerate(phrases or PHRASES, 1))
    return phrase_rows(spark.createDataFrame(rows, "id_texto long, frase string"), limit)


def phrase_rows(phrases: DataFrame, limit: int = PHRASE_LIMIT) -> DataFrame:
    """Phrases (id_texto, frase) as new table rows: active, unused, with a limit of uses."""
    return phrases.select(
        "id_texto", "frase", F.lit("activo").alias("estado_texto"), F.lit(0).alias("contador_usos"),
        F.lit(limit).alias("limite_usos"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _from_bytes(raw):
    return raw.map(lambda b: None if b is None else np.frombuffer(b, "<f8"))


@F.pandas_udf(T.BinaryType())
def _to_bytes(v):
    return v.map(lambda x: None if x is None else np.asarray(x, "<f8").tobytes())


def decode_bytes(raw: Column) -> Column:
    """Little-endian float64 bytes to an array; a broken length gives null."""
    return _from_bytes(F.when(F.length(raw) % 8 == 0, raw))


def encode_bytes(v: Column) -> Column:
    return _to_bytes(v)


def decode_vector(text: Column) -> Column:
    r"""``\x`` + hex to an array; null without the prefix or with bad hex."""
    body = F.when(F.substring(text, 1, 2) == "\\x", F.substring(text, 3, 2**30))
    return decode_bytes(F.unhex(F.when(body.rlike("^([0-9A-Fa-f]{2})*$"), body)))


def encode_vector(v: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.hex(encode_bytes(v))))


def save_model(model: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One row per class, and a metadata file (num_classes, dimension, classes)."""
    model.write.mode(mode).parquet(f"{path}/classes")
    meta = model.agg(F.count("*").alias("num_classes"), F.max(F.size("w")).alias("dimension"),
                     F.array_sort(F.collect_list("class")).alias("classes"))
    meta.write.mode(mode).json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> DataFrame:
    """All or nothing: the class rows must match the metadata in number and dimension."""
    model = spark.read.parquet(f"{path}/classes")
    meta = spark.read.schema("num_classes long, dimension int, classes array<long>").json(f"{path}/metadata").first()
    got = model.agg(F.count("*").alias("n"), F.min(F.size("w")).alias("lo"), F.max(F.size("w")).alias("hi")).first()
    if meta is None or got["n"] != meta["num_classes"] or {got["lo"], got["hi"]} != {meta["dimension"]}:
        raise ValueError(f"incomplete model at {path}")
    return model


MODEL_ROW = "class long, w array<double>, b double, platt_a double, platt_b double, thr double"


def load_class_files(spark: SparkSession, root: str, pattern: str = "*.bin") -> DataFrame:
    """Modular layout, one small file per class: int32 dim, weights, bias, two calibration values, threshold.

    The class id is the number in the file name.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long")

    def parse(batches):
        for batch in batches:
            rows = []
            for cls, raw in zip(batch.column("class").to_pylist(), batch.column("content").to_pylist()):
                d = int(np.frombuffer(raw[:4], "<i4")[0])
                x = np.frombuffer(raw[4:4 + 8 * (d + 4)], "<f8")
                if len(x) != d + 4:
                    raise ValueError(f"truncated class file for class {cls}")
                rows.append((cls, x[:d].tolist(), *map(float, x[d:])))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.list_(pa.float64()), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["class", "w", "b", "platt_a", "platt_b", "thr"])

    return files.select(name.alias("class"), "content").mapInArrow(parse, MODEL_ROW)


def load_monolithic_model(spark: SparkSession, path: str) -> DataFrame:
    """One file: uint64 count, int32 dim, then per class int32 id, weights, bias. Truncation is an error."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches):
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                n, d = int(np.frombuffer(raw[:8], "<u8")[0]), int(np.frombuffer(raw[8:12], "<i4")[0])
                layout = np.dtype([("c", "<i4"), ("w", "<f8", (d,)), ("b", "<f8")])
                if len(raw) < 12 + n * layout.itemsize:
                    raise ValueError("truncated model file")
                rows = np.frombuffer(raw[12:12 + n * layout.itemsize], layout)
                ends = pa.array(np.arange(0, (n + 1) * d, d), pa.int32())
                w = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(rows["w"]).reshape(-1)))
                none = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["c"].astype(np.int64)), w, pa.array(rows["b"].copy()), none, none, none],
                    ["class", "w", "b", "platt_a", "platt_b", "thr"],
                )

    return files.mapInArrow(parse, MODEL_ROW)


def save_params(params: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Standardisation or reduction parameters, one row."""
    params.write.mode(mode).parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    params = spark.read.parquet(path)
    if "sd" in params.columns:
        params = params.withColumn("sd", F.transform("sd", lambda x: F.when(F.abs(x) < SD_ON_LOAD, 1.0).otherwise(x)))
    return params


def _lines(spark: SparkSession, path: str) -> list[str]:
    return [r["value"] for r in spark.read.option("wholetext", False).text(path).coalesce(1).collect()]


def _floats(line: str, delimiter: str) -> list[float]:
    return [float(x) for x in line.split(delimiter) if x.strip()]


def read_zscore_file(spark: SparkSession, path: str) -> DataFrame:
    """Three lines: dims; means; sds. One bounded parameter file, one row out."""
    dims, mean, sd = _lines(spark, path)[:3]
    mean, sd = _floats(mean, ";"), _floats(sd, ";")
    if not len(mean) == len(sd) == int(float(dims.strip(" ;"))):
        raise ValueError(f"sizes disagree in {path}")
    sd = [1.0 if abs(x) < SD_ON_LOAD else x for x in sd]
    return spark.createDataFrame([(mean, sd)], "mean array<double>, sd array<double>")


def read_reduction_file(spark: SparkSession, path: str) -> DataFrame:
    """Component files: means then components, with ``,``; or a ``classes;components;dims`` head line with ``;``."""
    lines = [line for line in _lines(spark, path) if line.strip()]
    delimiter = ";" if ";" in lines[0] else ","
    rows = [_floats(line, delimiter) for line in (lines[1:] if delimiter == ";" else lines)]
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError(f"sizes disagree in {path}")
    return spark.createDataFrame([(rows[0], rows[1:], None)],
                                 "mean array<double>, components array<array<double>>, values array<double>")


def snapshot(df: DataFrame, root: str, version: str | None = None) -> str:
    """A full copy under ``version=<stamp>``; returns the version."""
    stamp = version or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    df.write.mode("errorifexists").parquet(f"{root}/version={stamp}")
    return stamp


def rollback(spark: SparkSession, root: str, version: str, current: str) -> DataFrame:
    """Restores a version over the current table and returns it."""
    spark.read.parquet(f"{root}/version={version}").write.mode("overwrite").parquet(current)
    return spark.read.parquet(current)

