"""Slabs of whole texts, and keys that travel sorted, as differences, dealt into buckets by range.

A slab asks about its distinct keys, one entry a key however frequent it is; a bucket hears all slabs on its range of keys
and answers each. The number of buckets follows the amount of text, so a bucket stays small whatever a key's frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idmatch.llm.words import U64, Texts, schema, slices
from idmatch.session import durable, small_batches

#: Text bytes of a slab, about (a longer text is a slab of its own), and for each bucket.
SLAB_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


def planes(values: np.ndarray) -> bytes:
    """Numbers in as many byte planes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    width = raw[0]
    split = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((split.shape[1], 8), np.uint8)
    out[:, :width] = split.T
    return out.reshape(-1).view("<u8").astype(U64)


def pack(keys: np.ndarray, low: int) -> bytes:
    """Ascending keys as differences from ``low`` on."""
    return planes(np.diff(keys, prepend=U64(low)))


def unpack(raw: bytes, low: int) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=U64) + U64(low)


def dealt(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending keys."""
    if not len(keys):
        return []
    bucket = (keys >> U64(shift)).astype(np.int64)
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def shift_for(slabs: DataFrame, bits: int) -> int:
    """How many low bits of a key stay within a bucket."""
    total = slabs.agg(F.sum("size").alias("n")).first().n or 0
    return bits - max(4, (total // BUCKET_BYTES).bit_length())


def slabs(rows: DataFrame, limit: int = 0) -> DataFrame:
    """(slab, each column but text as a list, offs, size, raw): runs of whole texts, compressed, written once."""
    names = [c for c in rows.columns if c != "text"]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out = schema(slab="long", offs="array<long>", size="long", raw="binary")
    for c in names:
        out.add(T.StructField(c, T.ArrayType(kinds[c])))

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, texts in slices(batch, limit=limit or SLAB_BYTES):
                raw = texts.data.tobytes()
                held = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + n]), pa.array([texts.offs.tolist()], pa.list_(pa.int64())), pa.array([len(raw)]),
                     pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary()), *held], ["slab", "offs", "size", "raw", *names])
                n += 1

    with small_batches(rows.sparkSession):  # the texts are compressed already, and a codec would hold whole pages outside the heap
        return durable(rows.mapInArrow(run, out), compression="uncompressed")


def texts_of(row: dict) -> Texts:
    raw = pa.decompress(row["raw"], row["size"], "zstd", asbytes=True)
    return Texts(np.frombuffer(raw, np.uint8), np.array(row["offs"], np.int64))


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one in Python at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def record(rows: list[tuple], **kinds: pa.DataType) -> pa.RecordBatch:
    """Rows of Python values as a batch."""
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def shared_keys(requests: DataFrame, shift: int) -> DataFrame:
    """(slab, answers): for each slab, by bucket, which of its keys occur at two places anywhere.

    ``requests`` holds (bucket, slab, keys, twice): a slab's distinct keys, and bits for those it has at two places itself.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [unpack(r["keys"], r["bucket"] << shift) for r in rows]
        twice = np.concatenate([bits_of(r["twice"], len(k)) for r, k in zip(rows, keys, strict=True)])
        _, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = (np.bincount(inverse, twice)[inverse] > 0) | (times[inverse] > 1)
        ends = np.cumsum([len(k) for k in keys])
        out = [(r["slab"], r["bucket"], len(k), np.packbits(shared[e - len(k) : e]).tobytes()) for r, k, e in zip(rows, keys, ends, strict=True)]
        return pa.Table.from_batches([record(out, slab=pa.int64(), bucket=pa.int64(), n=pa.int64(), shared=pa.binary())])

    found = requests.groupBy("bucket").applyInArrow(run, schema(slab="long", bucket="long", n="long", shared="binary"))
    return found.groupBy("slab").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "shared"))).alias("answers"))


def bits_of(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def answered(row: dict, n: int) -> np.ndarray:
    """The bits of ``shared_keys`` for a slab's n distinct keys in ascending order."""
    bits = [bits_of(a["shared"], a["n"]) for a in row["answers"] or []]
    out = np.concatenate(bits) if bits else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"slab {row['slab']} has {n} keys and {len(out)} answers")
    return out
