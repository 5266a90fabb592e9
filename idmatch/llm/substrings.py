"""Removal of word windows that an earlier document has, by rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.llm.copies import LAST
from idmatch.llm.packed import dealt, pack, planes, record, rows_of, shift_for, slabs, texts_of, unpack, unplanes
from idmatch.llm.words import U64, Texts, covered, schema, typed, whole, window_hashes, word_hashes, words
from idmatch.session import durable, small_batches

WINDOW = 13
#: Text bytes of a slab that are split into words and hashed together.
PART_BYTES = 1 << 19


#: A slab's windows are sorted a piece at a time, by the upper bits of their keys; a bucket lies in one piece.
PIECE_BITS = 3
#: Windows of a bucket that are sorted together, about.
TOGETHER = 1 << 17


def _parts(texts: Texts) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about ``PART_BYTES`` (a longer text is a run of its own), and the texts they go from and to."""
    offs, at = texts.offs, 0
    while at < texts.n:
        to = min(max(at + 1, int(np.searchsorted(offs, offs[at] + PART_BYTES, "right")) - 1), texts.n)
        yield at, to, Texts(texts.data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def _windows(texts: Texts, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all windows in order of place, and their texts."""
    keys, docs = [np.zeros(0, U64)], [np.zeros(0, np.int32)]
    for at, _, part in _parts(texts):
        w = words(part)
        start = np.flatnonzero(whole(w, window))
        keys.append(window_hashes(word_hashes(part, w), window)[start])
        docs.append((w.doc[start] + at).astype(np.int32))
    return np.concatenate(keys), np.concatenate(docs)


def _pieces(keys: np.ndarray, ids: np.ndarray, docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the windows piece by piece, in ascending order of key and id: their numbers, keys and ids, and where each distinct
    key has its first place, which is that of the least id."""
    piece = (keys >> U64(64 - PIECE_BITS)).astype(np.uint8)
    for p in range(1 << PIECE_BITS):
        at = np.flatnonzero(piece == p)
        if not len(at):
            continue
        own = ids[docs[at]]
        order = np.argsort(own, kind="stable")
        order = order[np.argsort(keys[at][order], kind="stable")]
        at, own = at[order], own[order]
        key = keys[at]
        yield at, key, own, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def _asked(row: dict, window: int, shift: int) -> pa.RecordBatch:
    """The requests of a slab; see ``_requests``."""
    keys, docs = _windows(texts_of(row), window)
    out = []
    for _, key, ids, fresh in _pieces(keys, np.array(row["id"], np.int64), docs):
        own, least = key[fresh], ids[fresh]
        for b, i, j in dealt(own, shift):
            base = int(least[i:j].min())
            out.append((b, row["slab"], pack(own[i:j], b << shift), base, planes((least[i:j] - base).astype(U64))))
    return record(out, bucket=pa.int64(), slab=pa.int64(), keys=pa.binary(), base=pa.int64(), ids=pa.binary())


def _requests(table: DataFrame, window: int, shift: int) -> DataFrame:
    """(bucket, slab, keys, base, ids): the distinct windows of each slab, and the least id that each has there."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                yield _asked(row, window, shift)

    return table.select("slab", "id", "offs", "size", "raw").mapInArrow(run, schema(bucket="long", slab="long", keys="binary", base="long", ids="binary"))


def _earlier(keys: list[np.ndarray], ids: list[np.ndarray], low: int, width: int) -> list[np.ndarray]:
    """For each of the slabs' keys, all from ``low`` on within ``width``, whether another slab has it with a smaller id.

    Every slab's keys ascend, so the slabs are read side by side, a range of keys at a time.
    """
    pieces = min(sum(map(len, keys)) // TOGETHER + 1, width)
    cuts = np.array([low + width * i // pieces for i in range(1, pieces)], U64)
    edges = [[0, *np.searchsorted(k, cuts).tolist(), len(k)] for k in keys]
    out = [np.empty(len(k), bool) for k in keys]
    for p in range(pieces):
        spans = [(e[p], e[p + 1]) for e in edges]
        every = np.concatenate([k[i:j] for k, (i, j) in zip(keys, spans, strict=True)])
        if not len(every):
            continue
        own = np.concatenate([x[i:j] for x, (i, j) in zip(ids, spans, strict=True)])
        order = np.argsort(every, kind="stable")
        every = every[order]
        fresh = np.concatenate([[True], every[1:] != every[:-1]])
        least = np.minimum.reduceat(own[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        earlier = np.empty(len(every), bool)
        earlier[order] = least < own[order]
        at = 0
        for x, (i, j) in zip(out, spans, strict=True):
            x[i:j] = earlier[at : at + j - i]
            at += j - i
    return out


def _answers(requests: DataFrame, shift: int) -> DataFrame:
    """(slab, bucket, n, earlier): for each window a slab asked about, whether a document of a smaller id elsewhere has it."""

    def run(group: pa.Table) -> pa.Table:
        bucket, asked, keys, ids = 0, [], [], []
        for batch in group.to_batches():
            for r in rows_of(batch):
                bucket = r["bucket"]
                keys.append(unpack(r["keys"], bucket << shift))
                ids.append(unplanes(r["ids"]).astype(np.int64) + r["base"])
                asked.append(r["slab"])
        found = _earlier(keys, ids, bucket << shift, 1 << shift)
        out = [(slab, bucket, len(x), np.packbits(x).tobytes()) for slab, x in zip(asked, found, strict=True)]
        return pa.Table.from_batches([record(out, slab=pa.int64(), bucket=pa.int64(), n=pa.int64(), earlier=pa.binary())])

    return requests.groupBy("bucket").applyInArrow(run, schema(slab="long", bucket="long", n="long", earlier="binary"))


def _dropped(row: dict, keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Marks a slab's windows, in order of place, that a document of a smaller id has, here or by the answers."""
    bits = [np.unpackbits(np.frombuffer(a["earlier"], np.uint8), count=a["n"]).astype(bool) for a in row["answers"] or []]
    earlier = np.concatenate(bits) if bits else np.zeros(0, bool)
    out, n = np.zeros(len(keys), bool), 0
    for at, key, ids, fresh in _pieces(keys, np.array(row["id"], np.int64), docs):
        size = np.diff(np.append(fresh, len(key)))
        told, n = earlier[n : n + len(fresh)], n + len(fresh)
        if len(told) == len(fresh):
            out[at] = np.repeat(told, size) | (ids > np.repeat(ids[fresh], size))
    if len(earlier) != n:
        raise ValueError(f"slab {row['slab']} has {n} windows and {len(earlier)} answers")
    return out


def cut(texts: Texts, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str], list[list[int]]]:
    """Per text: words, removed words, remaining words joined by a space, removed runs (first, end, first, end, ...)."""
    w = words(texts)
    removed = np.bincount(w.doc[gone], minlength=texts.n)
    raw = texts.data.tobytes()
    kept, runs = [], []
    for i in range(texts.n):
        if not removed[i]:
            kept.append(b" ".join(raw[texts.offs[i] : texts.offs[i + 1]].split()).decode())
            runs.append([])
            continue
        a, b = w.first[i], w.first[i] + w.count[i]
        stay = np.flatnonzero(~gone[a:b]) + a
        kept.append(b" ".join([raw[s:e] for s, e in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]).decode())
        runs.append(np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))).tolist())
    return w.count, removed, kept, runs


def substring_dedup(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carry..., text, n_words, n_removed, runs) of every document, without the windows of an earlier one.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id, by the texts given.
    ``text`` is what is left, joined by single spaces; ``runs`` are the maximal removed runs of words, as first, end,
    first, end, ... Every window is hashed (Rabin-Karp, 64 bits) and counted in Spark, once for each slab of texts that
    has it, with the least id; see ``packed`` for how they travel. Among n different windows about n^2 / 4e19 pairs share
    a hash by chance.

    Null and empty texts, and those shorter than a window, lose nothing. A null id counts as the largest. Rows with the
    same id do not remove each other; repeated rows each get a row. An empty table gives no rows.
    """
    rows = typed(docs, doc_id="long", text="string", **{c: "string" for c in carry}).withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    table = slabs(rows)
    shift = shift_for(table, 64)
    with small_batches(docs.sparkSession):
        answers = durable(_answers(_requests(table, window, shift), shift))
    given = answers.groupBy("slab").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "earlier"))).alias("answers"))

    def left(row):
        texts = texts_of(row)
        keys, docs = _windows(texts, window)
        drop, n = _dropped(row, keys, docs), 0
        for at, to, part in _parts(texts):
            w = words(part)
            start = np.flatnonzero(whole(w, window))
            here, n = drop[n : n + len(start)], n + len(start)
            count, removed, kept, runs = cut(part, covered(start[here], window, len(w.start)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_id"][at:to], pa.int64()), *[pa.array(row[c][at:to], pa.string()) for c in carry], pa.array(kept, pa.string()), pa.array(count, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.int32()))], ["doc_id", *carry, "text", "n_words", "n_removed", "runs"])

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                yield from left(row)

    return table.join(given, "slab", "left").mapInArrow(run, schema(
        doc_id="long", **{c: "string" for c in carry}, text="string", n_words="long", n_removed="long", runs="array<int>"))
