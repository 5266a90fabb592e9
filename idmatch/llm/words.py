"""Words, lines and rolling hashes of whole Arrow string columns, as numpy arrays.

A word is a run of characters other than space and \\t \\n \\v \\f \\r. Texts are taken as UTF-8 bytes; a null text has
no bytes. Hashes are polynomial (Rabin-Karp) modulo 2^64, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Text bytes that one pass over arrays takes at once (a longer text is a pass of its own).
SLICE_BYTES = 4 << 20
#: Bytes of spans that are hashed together.
SPAN_BYTES = 1 << 17
BASE = U64(0x9E3779B97F4A7C15)
WORD_BASE = U64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def typed(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast to the given types; other columns, whatever their names, stay out."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def schema(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()])


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Texts:
    """A run of texts: all bytes, and where each text begins and ends."""

    data: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def lower(self) -> Texts:
        """A-Z in lower case."""
        return Texts(LOWER[self.data], self.offs)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        at = np.flatnonzero(mask)
        return np.diff(np.searchsorted(at, self.offs))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 0) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in runs of rows of about ``limit`` text bytes, with the texts of each."""
    limit = limit or SLICE_BYTES
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        to = min(to, len(texts))
        yield batch.slice(at, to - at), Texts(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


@dataclass
class Words:
    """Words of all texts in order: their bytes [start, end), their text, and their number in each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray


def words(texts: Texts) -> Words:
    solid = ~SPACE[texts.data]
    edge = np.zeros(len(solid) + 1, bool)
    edge[texts.offs] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    start = np.flatnonzero(start)
    first = np.searchsorted(start, texts.offs)
    count = np.diff(first)
    return Words(start, np.flatnonzero(end) + 1, np.repeat(np.arange(texts.n), count), first[:-1], count)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """The hash of each byte span; spans must not overlap and must be in order and not empty."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    upto, power = np.cumsum(size), powers(base, int(size.max()))
    out, at = np.empty(len(start), U64), 0
    while at < len(start):  # some spans at a time, so that arrays of eight bytes a byte stay small
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + SPAN_BYTES)))
        n = size[at:to]
        begin = np.cumsum(n) - n
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        value = (data[inside + np.repeat(start[at:to], n)].astype(U64) + U64(1)) * power[inside]
        out[at:to] = np.add.reduceat(value, begin)
        at = to
    return mix(out)


def word_hashes(texts: Texts, w: Words) -> np.ndarray:
    return span_hashes(texts.data, w.start, w.end)


def window_hashes(values: np.ndarray, k: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """The hash of every k values that follow each other (across texts too; mask those with ``whole``)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = values[:n].copy()
    for j in range(1, k):
        total *= base
        total += values[j : j + n]
    return mix(total)


def whole(w: Words, k: int) -> np.ndarray:
    """Marks the windows of k words that lie in one text."""
    n = len(w.doc) - k + 1
    return w.doc[:n] == w.doc[k - 1 :] if n > 0 else np.zeros(0, bool)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the keys that occur more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Marks the places [s, s + width) of each start among n places."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + width, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values that follow each other, the place of its least value by the upper 40 bits (the
    first of equals), so that equal runs choose the same place."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(values) > 1 << 24:  # runs of places overlap by width - 1
        step = (1 << 24) - width
        return np.concatenate([minimizers(values[i : i + step + width - 1], width) + i for i in range(0, n, step)])
    best, reach = (values & ~U64((1 << 24) - 1)) | np.arange(len(values), dtype=U64), 1
    while reach < width:
        step = min(reach, width - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    return (best[:n] & U64((1 << 24) - 1)).astype(np.int64)


def byte_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k bytes that follow each other, k a power of two, by joining halves."""
    h, size, base = data.astype(U64) + U64(1), 1, BASE
    while size < k:
        if len(h) <= size:
            return np.zeros(0, U64)
        h = h[:-size] * base + h[size:]
        base *= base
        size *= 2
    return mix(h)


def nested(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of lists of integers; null lists count as empty."""
    lists = pc.fill_null(lists.cast(pa.large_list(lists.type.value_type)), pa.scalar([], pa.large_list(lists.type.value_type)))
    offs = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values)[offs[0] : offs[-1]] if len(lists) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(lists)), np.diff(offs)), values
