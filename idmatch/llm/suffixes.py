"""Removal of byte strings that occur twice, by suffix arrays over candidate contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.llm.packed import answered, dealt, pack, record, rows_of, shared_keys, shift_for, slabs, texts_of
from idmatch.llm.words import U64, Texts, byte_hashes, minimizers, schema, typed
from idmatch.session import durable

LENGTH = 200
#: Bytes of an anchor: the run of so many bytes with the least hash in a string. A power of two.
ANCHOR = 128
#: Symbols of one suffix array; contexts of one anchor stay together.
ARRAY = 1 << 16
#: An anchor with more different contexts than this is split by the bytes beside it.
CROWDED = 256
#: Bytes of a slab whose hashes are held at once.
PIECE_BYTES = 1 << 19


def suffix_array(text: list[int]) -> list[int]:
    """The suffixes of a text of integers in ascending order, by Lyndon grouping.

    Suffixes start in groups of one first symbol. Groups are taken in descending order; ``before`` of a suffix is the
    nearest earlier one in a smaller group. All suffixes that one group points back to continue with the group's context
    as often as they are pointed to, so they move to new groups right above their old ones, those with more pointers
    higher. At the end suffixes of one group have one Lyndon prefix. Walking the array in ascending order, each suffix
    then settles the suffixes it is the next smaller one of: the chain of ``before`` pointers from its left neighbour.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    rank = [0] * n
    group = [0] * n
    size = [0] * (n + 1)
    head = 0
    for place, i in enumerate(order):
        rank[i] = place
        if text[i] != text[order[head]]:
            head = place
        group[i] = head
        size[head] += 1
    before = [-1] * n

    def lift(members: list[int], g: int) -> None:
        """Moves members of group g to a group of their own above what is left of it."""
        top = g + size[g]
        for i in members:
            top -= 1
            other, place = order[top], rank[i]
            order[place], rank[other] = other, place
            order[top], rank[i] = i, top
        if top != g:
            size[g] = top - g
            size[top] = len(members)
            for i in members:
                group[i] = top

    high = n
    while high:
        low = group[order[high - 1]]
        if high - low == 1:
            i = order[low]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0 and size[group[j]] > 1:
                lift([j], group[j])
        else:
            pointed: dict[int, int] = {}
            for i in sorted(order[low:high]):
                j = i - 1
                while j >= 0 and group[j] >= low:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
            by_count: dict[int, dict[int, list[int]]] = {}
            for j, times in pointed.items():
                by_count.setdefault(times, {}).setdefault(group[j], []).append(j)
            for times in sorted(by_count, reverse=True):
                for g, members in by_count[times].items():
                    if len(members) < size[g]:
                        lift(members, g)
        high = low
    free = list(range(n))
    settled = [False] * n
    at = n
    for k in range(-1, n):
        if k >= 0:
            at = order[k]
        j = at - 1
        while j >= 0 and not settled[j]:
            settled[j] = True
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            j = before[j]
    return order


def repeated_starts(contexts: list[tuple[int, int, bytes]], width: int) -> list[np.ndarray]:
    """For each context, where strings of ``width`` symbols start that also start elsewhere in any of the contexts.

    A context is (key, cut, rest): the bytes ``rest`` with the key's anchor, as one symbol, before place ``cut``.
    """
    text: list[int] = []
    begin, size = [], []
    anchors: dict[int, int] = {}
    for key, cut, rest in contexts:
        begin.append(len(text))
        text.extend([b + 1 for b in rest[:cut]])
        text.append(anchors.setdefault(key, 257 + len(anchors)))
        text.extend([b + 1 for b in rest[cut:]])
        text.append(0)
        size.append(len(rest) + 2 - width)
    room = np.zeros(len(text), bool)
    for b, n in zip(begin, size, strict=True):
        room[b : b + n] = True
    order = np.array(suffix_array(text), np.int64)
    order = order[room[order]].tolist()
    hit = np.zeros(len(text), bool)
    for i, j in zip(order[:-1], order[1:], strict=True):
        if text[i : i + width] == text[j : j + width]:
            hit[i] = hit[j] = True
    return [np.flatnonzero(hit[b : b + n]) for b, n in zip(begin, size, strict=True)]


def runs_of(places: np.ndarray) -> list[int]:
    """Ascending places as runs: first, end, first, end, ..."""
    if not len(places):
        return []
    gap = np.flatnonzero(np.diff(places) > 1)
    return np.column_stack([places[np.concatenate([[0], gap + 1])], places[np.append(gap, len(places) - 1)] + 1]).ravel().tolist()


def _pieces(texts: Texts, length: int, anchor: int, piece: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The contexts of a slab, some bytes of it at a time, however long its texts are: (hash of the anchor, starts of the
    first and the last string that it anchors, where it stands). A piece reaches ``length - 1`` bytes into the next, so
    every string lies whole in the piece in which it starts."""
    for at in range(0, len(texts.data), piece):
        data = texts.data[at : at + piece + length - 1]
        if len(data) < length:
            return
        start = np.arange(at, at + len(data) - length + 1)
        runs = byte_hashes(data, anchor)
        inside = np.flatnonzero(start + length <= texts.offs[np.searchsorted(texts.offs, start, "right")])
        places = minimizers(runs, length - anchor + 1)[inside]
        first = np.flatnonzero(np.diff(places, prepend=-1))
        last = np.append(first[1:], len(places))[: len(first)] - 1
        yield runs[places[first]], start[inside[first]], start[inside[last]], places[first] + at


def _requests(table: DataFrame, length: int, anchor: int, shift: int, piece: int) -> DataFrame:
    """(bucket, slab, keys, twice): the distinct anchors of each slab, and which of them it has at two places."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                keys, often = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
                for found, *_ in _pieces(texts_of(row), length, anchor, piece):
                    own, times = np.unique(found, return_counts=True)
                    keys.append(own)
                    often.append(times)
                own, inverse = np.unique(np.concatenate(keys), return_inverse=True)
                twice = np.bincount(inverse, np.concatenate(often), minlength=len(own)) > 1
                out = [(b, row["slab"], pack(own[i:j], b << shift), np.packbits(twice[i:j]).tobytes()) for b, i, j in dealt(own, shift)]
                yield record(out, bucket=pa.int64(), slab=pa.int64(), keys=pa.binary(), twice=pa.binary())

    return table.select("slab", "offs", "size", "raw").mapInArrow(run, schema(bucket="long", slab="long", keys="binary", twice="binary"))


def _contexts(table: DataFrame, length: int, anchor: int, piece: int) -> DataFrame:
    """(key, digest, slab, ats, at, n, cut, rest): for each shared anchor of a slab the bytes of all n strings that it
    anchors, without the anchor itself, and where in the slab the first of them starts: at all of ``ats``, ``at`` first.
    Equal contexts of one piece of a slab are one row, so a text that goes on repeating itself gives few."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                texts = texts_of(row)
                own = np.unique(np.concatenate([np.zeros(0, U64), *(np.unique(found) for found, *_ in _pieces(texts, length, anchor, piece))]))
                shared = own[answered(row, len(own))]
                for context in _pieces(texts, length, anchor, piece):
                    wanted = np.isin(context[0], shared)
                    keys, first, last, places = [c[wanted] for c in context]
                    if not len(keys):
                        continue
                    number: dict[tuple[int, bytes], int] = {}
                    rows, which = [], np.empty(len(first), np.int64)
                    for i, (key, a, b, p) in enumerate(zip(keys.view(np.int64).tolist(), first.tolist(), last.tolist(), places.tolist(), strict=True)):
                        rest = texts.data[a:p].tobytes() + texts.data[p + anchor : b + length].tobytes()
                        digest = _digest(p - a, rest)
                        which[i] = k = number.setdefault((key, digest), len(number))
                        if k == len(rows):
                            rows.append((key, digest, row["slab"], a, b - a + 1, p - a, rest))
                    ats = first[np.argsort(which, kind="stable")]
                    ends = np.concatenate([[0], np.cumsum(np.bincount(which))])
                    done = record(rows, key=pa.int64(), digest=pa.binary(), slab=pa.int64(), at=pa.int32(), n=pa.int32(), cut=pa.int32(), rest=pa.binary())
                    yield done.append_column("ats", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ats, pa.int32())))

    return table.mapInArrow(run, schema(key="long", digest="binary", slab="long", at="int", n="int", cut="int", rest="binary", ats="array<int>"))


def _digest(cut: int, rest: bytes) -> bytes:
    return hashlib.md5(b"%d:%b" % (cut, rest)).digest()


def _by_suffix_array(groups: DataFrame, width: int) -> DataFrame:
    """(key, digest, runs) of contexts that occur once and lie next to all others with the same key."""

    def run(batches):
        keys, digests, times, contexts = [], [], [], []

        def done():
            runs = [runs_of(s) for s in repeated_starts(contexts, width)]
            out = [x for x, n in zip(zip(keys, digests, runs, strict=True), times, strict=True) if n == 1 and x[2]]
            for held in (keys, digests, times, contexts):
                held.clear()
            return record(out, key=pa.int64(), digest=pa.binary(), runs=pa.list_(pa.int32()))

        held = 0
        for batch in batches:
            for key, digest, n, cut, rest in zip(*[batch.column(c).to_pylist() for c in ("key", "digest", "times", "cut", "rest")], strict=True):
                if held >= ARRAY and key != keys[-1]:
                    yield done()
                    held = 0
                keys.append(key)
                digests.append(digest)
                times.append(n)
                contexts.append((key, cut, rest))
                held += len(rest)
        if keys:
            yield done()

    return groups.select("key", "digest", "times", "cut", "rest").mapInArrow(run, schema(key="long", digest="binary", runs="array<int>"))


def _split(groups: DataFrame, room: int) -> DataFrame:
    """(key, digest, times, first, part, inner, n, cut, rest): each context as two, with longer anchors.

    Of the ``room`` bytes that a string has beside its anchor at least ``half`` follow the anchor, or else at least as many
    come before it. They join the anchor and, with the side they are on, make its new key ``part``. Equal strings have
    their anchor at one place and so stay together. ``first`` is the number of the first string that went along.
    """
    half = (room + 1) // 2
    left = room - half

    def run(batches):
        for batch in batches:
            out = []
            for key, digest, times, cut, rest in zip(*[batch.column(c).to_pylist() for c in ("key", "digest", "times", "cut", "rest")], strict=True):
                last = len(rest) - room
                for a, b, p in ((max(0, cut - left), min(last, cut), cut), (0, min(last, cut - left - 1), cut - half)):
                    if a <= b:
                        beside = hashlib.md5(b"%d:%d:%b" % (key, p - cut, rest[p : p + half])).digest()
                        inner = rest[a:p] + rest[p + half : b + room]
                        out.append((key, digest, times, a, int.from_bytes(beside[:8], "little", signed=True), _digest(p - a, inner), b - a + 1, p - a, inner))
            yield record(out, key=pa.int64(), digest=pa.binary(), times=pa.int64(), first=pa.int32(), part=pa.int64(), inner=pa.binary(), n=pa.int32(), cut=pa.int32(), rest=pa.binary())

    kinds = schema(key="long", digest="binary", times="long", first="int", part="long", inner="binary", n="int", cut="int", rest="binary")
    return groups.select("key", "digest", "times", "cut", "rest").mapInArrow(run, kinds)


def _undecided(counts: DataFrame) -> DataFrame:
    """(key, kinds) of the keys whose contexts must be compared: several different ones, at least one of them single."""
    return counts.groupBy("key").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).filter("kinds > 1 AND least = 1").select("key", "kinds")


def _whole(counts: DataFrame) -> DataFrame:
    """(key, digest, runs) of the contexts that occur twice: all their strings do."""
    return counts.filter("times > 1").select("key", "digest", F.array(F.lit(0), F.col("n")).alias("runs"))


def _compared(mixed: DataFrame, room: int, crowded: int) -> DataFrame:
    """(key, digest, runs) of the single contexts with strings that another context of their key has too.

    The contexts of a key make one suffix array; if they are more than ``crowded``, the key is split by the bytes beside
    its anchor until they are not. Each split halves ``room``; without room all contexts of a key are equal.
    """
    near = mixed.filter(F.col("kinds") <= crowded).repartition("key").sortWithinPartitions("key")
    found = _by_suffix_array(near, room + 1)
    far = mixed.filter(F.col("kinds") > crowded)
    if far.isEmpty():
        return found
    parts = durable(_split(far, room))
    inner = parts.select(F.col("part").alias("key"), F.col("inner").alias("digest"), "times", "n", "cut", "rest")
    counts = durable(inner.groupBy("key", "digest").agg(F.sum("times").alias("times"), F.min("n").alias("n"), F.min("cut").alias("cut"), F.min("rest").alias("rest")))
    judged = _compared(durable(counts.join(_undecided(counts), "key")), room // 2, crowded).union(_whole(counts))
    mine = parts.filter("times = 1").select("key", "digest", "first", "part", "inner")
    back = mine.join(judged.select(F.col("key").alias("part"), F.col("digest").alias("inner"), "runs"), ["part", "inner"])
    return found.union(back.select("key", "digest", F.transform("runs", lambda r: r + F.col("first")).alias("runs")))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowded: int = CROWDED, piece: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, runs) of every document: its bytes without strings that occur twice.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same or another document, by the
    texts given. ``kept`` is what is left (binary, as a cut may fall inside a character); ``runs`` are the maximal removed
    runs of bytes, as first, end, first, end, ...

    Equal strings have equal anchors, so only strings whose anchor occurs at two places are looked at. An anchor's strings
    at one place lie in one context of less than ``2 * length`` bytes. Equal contexts are counted and become one; a context
    that occurs twice is repeated whole. Different contexts of one anchor are put into one text, the anchor being one
    symbol of it, whose suffix array, built by Lyndon grouping, has equal strings side by side. An anchor with more than
    ``crowded`` different contexts is first split by the bytes beside it, so an array stays small whatever the key.

    Texts are read in pieces of ``piece`` bytes that overlap by ``length - 1`` bytes, so a very long text takes no more memory at once.

    Null and empty texts, and those shorter than ``length``, lose nothing. Repeated rows are copies of each other; each gets
    a row. An empty table gives no rows.
    """
    table = slabs(typed(docs, doc_id="long", text="string"))
    shift = shift_for(table, 64)
    answers = shared_keys(_requests(table, length, anchor, shift, piece), shift)
    contexts = durable(_contexts(table.select("slab", "offs", "size", "raw").join(answers, "slab", "left"), length, anchor, piece))
    one = F.min(F.struct("slab", "at")).alias("one")
    counts = durable(contexts.groupBy("key", "digest").agg(F.sum(F.size("ats")).cast("long").alias("times"), F.min("n").alias("n"), one))
    asked = counts.join(_undecided(counts), "key").select("key", "digest", "times", "kinds", F.col("one.slab").alias("slab"), F.col("one.at").alias("at"))
    mixed = durable(contexts.select("key", "digest", "slab", "at", "cut", "rest").join(asked, ["key", "digest", "slab", "at"]))
    judged = _compared(mixed, length - anchor, crowded).union(_whole(counts))
    # in the slab, where runs of starts begin and end: begin, end, begin, end, ...
    edges = F.flatten(F.transform("ats", lambda at: F.transform("runs", lambda r: r + at)))
    gone = contexts.select("key", "digest", "slab", "ats").join(judged, ["key", "digest"]).select("slab", edges.alias("edges")).groupBy("slab").agg(
        F.flatten(F.collect_list("edges")).alias("edges"))

    def run(batches):
        for batch in batches:
            found = batch.column("edges")
            for i, row in enumerate(rows_of(batch.drop_columns(["edges"]))):
                texts = texts_of(row)
                edges = np.asarray(found[i].values, np.int64) if found[i].is_valid else np.zeros(0, np.int64)
                step = np.zeros(len(texts.data) + 1, np.int32)
                np.add.at(step, edges[::2], 1)
                np.subtract.at(step, edges[1::2] + length - 1, 1)
                lost = np.cumsum(step[:-1], out=step[:-1]) > 0
                kept, removed, runs = [], [], []
                for a, b in zip(texts.offs[:-1].tolist(), texts.offs[1:].tolist(), strict=True):
                    own = lost[a:b]
                    kept.append(texts.data[a:b][~own].tobytes())
                    removed.append(int(own.sum()))
                    runs.append(runs_of(np.flatnonzero(own)) if removed[-1] else [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_id"], pa.int64()), pa.array(kept, pa.binary()), pa.array(np.diff(texts.offs)), pa.array(removed, pa.int64()), pa.array(runs, pa.list_(pa.int32()))],
                    ["doc_id", "kept", "n_bytes", "n_removed", "runs"])

    return table.join(gone, "slab", "left").mapInArrow(run, schema(doc_id="long", kept="binary", n_bytes="long", n_removed="long", runs="array<int>"))
