"""Binary vector records as a Spark data source.

Layout, little-endian: int32 dim, dim x float64, int32 label, repeated. Records of one size make a file
splittable, so a large file is read by many tasks; ``uniform=false`` reads files of mixed dimensions, one
task per file. A truncated last record ends the scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "vector_records"
MAX_DIM = 10_000  # fixed value
SPLIT_BYTES = 32 * 2**20
SCHEMA = "v array<double>, label int"


def _layout(d: int) -> np.dtype:
    return np.dtype([("d", "<i4"), ("v", "<f8", (d,)), ("label", "<i4")])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[fs.FileInfo]:
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))
                   and "/_" not in f.path[len(at):]), key=lambda f: f.path)


def _check_dim(d: int, path: str) -> int:
    if not 0 < d <= MAX_DIM:
        raise ValueError(f"dimension {d} in {path} is outside 1..{MAX_DIM}")
    return d


@dataclass
class _Range(InputPartition):
    path: str
    d: int
    start: int
    count: int


def _batch(v: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    n, d = v.shape
    ends = pa.array(np.arange(0, (n + 1) * d, d), pa.int32())
    values = pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(v).reshape(-1)))
    return pa.RecordBatch.from_arrays([values, pa.array(label, pa.int32())], ["v", "label"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, uniform: bool):
        self.path, self.uniform = path, uniform

    def partitions(self) -> list[_Range]:
        system, _ = _open(self.path)
        out = []
        for f in _files(self.path):
            if f.size < 4:
                continue
            with system.open_input_file(f.path) as file:
                d = _check_dim(int(np.frombuffer(file.read(4), "<i4")[0]), f.path)
            if not self.uniform:
                out.append(_Range(f.path, d, 0, -1))
                continue
            size = _layout(d).itemsize
            step, total = max(1, SPLIT_BYTES // size), f.size // size
            out += [_Range(f.path, d, s, min(step, total - s)) for s in range(0, total, step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if part.count == 0:
            return
        system, _ = _open(self.path)
        with system.open_input_file(part.path) as file:
            if part.count < 0:
                yield from self._mixed(file, part.path)
                return
            layout = _layout(part.d)
            file.seek(part.start * layout.itemsize)
            rows = np.frombuffer(file.read(part.count * layout.itemsize), layout)
            if (rows["d"] != part.d).any():
                raise ValueError(f"{part.path} mixes dimensions; read it with uniform=false")
            yield _batch(rows["v"], rows["label"])

    @staticmethod
    def _mixed(file, path: str) -> Iterator[pa.RecordBatch]:
        while len(head := file.read(4)) == 4:
            d = _check_dim(int(np.frombuffer(head, "<i4")[0]), path)
            body = file.read(8 * d + 4)
            if len(body) < 8 * d + 4:
                return
            yield _batch(np.frombuffer(body[:-4], "<f8")[None, :], np.frombuffer(body[-4:], "<i4"))


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    dims: tuple[int, ...]


class _Writer(DataSourceArrowWriter):
    """Tasks write to a staging folder; files appear at the target only when the whole job succeeded."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        system, at = _open(self.staging)
        dims: set[int] = set()
        name, out = f"part-{uuid.uuid4().hex}.bin", None
        try:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                lengths = np.diff(batch.column("v").offsets.to_numpy())
                dims |= {int(x) for x in np.unique(lengths)}
                if len(dims) > 1:
                    raise ValueError(f"vectors of dimensions {sorted(dims)} in one record set")
                d = _check_dim(int(lengths[0]), "the input")
                rows = np.empty(batch.num_rows, _layout(d))
                rows["d"] = d
                rows["v"] = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                rows["label"] = batch.column("label").to_numpy(zero_copy_only=False)
                if out is None:
                    system.create_dir(at, recursive=True)
                    out = system.open_output_stream(f"{at}/{name}")
                out.write(rows.tobytes())
        finally:
            if out is not None:
                out.close()
        return _Written(name if out is not None else None, tuple(dims))

    def commit(self, messages: list[_Written | None]) -> None:
        system, at = _open(self.path)
        _, staged = _open(self.staging)
        done = [m for m in messages if m is not None and m.name]
        dims = {d for m in done for d in m.dims}
        if len(dims) > 1:
            self.abort(messages)
            raise ValueError(f"vectors of dimensions {sorted(dims)} in one record set")
        old = _files(self.path) if self.overwrite and system.get_file_info(at).type != fs.FileType.NotFound else []
        for m in done:
            system.move(f"{staged}/{m.name}", f"{at}/{m.name}")
        for f in old:
            system.delete_file(f.path)
        self._drop_staging()

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop_staging()

    def _drop_staging(self) -> None:
        system, at = _open(self.staging)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            system.delete_dir(at)


class VectorRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("uniform", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def read_vector_records(spark: SparkSession, path: str, uniform: bool = True) -> DataFrame:
    """(v, label) rows."""
    spark.dataSource.register(VectorRecords)
    return spark.read.format(FORMAT).option("uniform", str(uniform).lower()).load(path)


def write_vector_records(df: DataFrame, path: str, mode: str = "append", label: str = "label", v: str = "v") -> None:
    """Append or overwrite record files, one per task; all vectors must have one dimension."""
    df.sparkSession.dataSource.register(VectorRecords)
    rows = df.select(df[v].cast("array<double>").alias("v"), df[label].cast("int").alias("label"))
    rows.write.format(FORMAT).mode(mode).save(path)
