"""Set-similarity join of documents on word n-grams, and the groups it links."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.llm.components import components
from idmatch.llm.copies import LAST, keyed
from idmatch.llm.packed import dealt, pack, record, shift_for, slabs, texts_of, unpack
from idmatch.llm.words import U64, Texts, mix, schema, window_hashes, word_hashes, words
from idmatch.session import drop, durable, scratch

#: Counters of the frequency sketch, which is sent to every task: 2 MB whatever the input.
COUNTERS = 1 << 18
#: Bits of a shingle's hash in a test of one pair.
BITS = 48
#: Parts of a set whose sizes bound an overlap before a pair is made.
PARTS = 8
FULL = (1 << 15) - 1
#: Shingles in each of the finer parts that bound it once for each pair, in the mean at least, and their largest size.
FINE, FULL_FINE = 16, 255
#: Parts of a set whose sizes bound an overlap of documents in different components.
FEW = 64
#: The most that two rows a and b can share by these parts, in SQL.
FEW_SHARE = (f"aggregate(zip_with(a.few, b.few, (x, y) -> IF(x = {FULL_FINE} AND y = {FULL_FINE}, 1000000000L, CAST(least(x, y) AS BIGINT))), 0L, (s, v) -> s + v)")
#: Sets to read whose places are sent to every task: 20 MB.
SENT = 1 << 19
#: Users of a prefix shingle up to which those of one hub meet by it; those of more meet by what they do not share with the hub.
CROWD = 16
#: The last class of set sizes, and the most users of a shingle that are told apart.
LAST_SIZE, MANY = 255, 255


def sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of all texts as hashes in ascending order per text, and where each text's begin.

    Letters A-Z count as lower case. A text of fewer words is one shingle, a text without words has none.
    """
    texts = texts.lower()
    w = words(texts)
    hashes = word_hashes(texts, w)
    runs = window_hashes(hashes, n)
    found, begin = [], [0]
    for first, count in zip(w.first.tolist(), w.count.tolist(), strict=True):
        if count >= n:
            own = np.unique(runs[first : first + count - n + 1])
        elif count:
            own = mix(window_hashes(hashes[first : first + count], count) + U64(count))
        else:
            own = np.zeros(0, U64)
        found.append(own)
        begin.append(begin[-1] + len(own))
    return np.concatenate(found) if found else np.zeros(0, U64), np.array(begin)


def part_sizes(own: np.ndarray) -> bytes:
    """The sizes of a set's parts by the upper bits of its hashes, more parts the larger it is."""
    bits = max(3, (len(own) // FINE).bit_length() - 1)
    return np.minimum(np.bincount((own >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), FULL_FINE).astype(np.uint8).tobytes()


def may_share(x: bytes, y: bytes, total: int) -> int:
    """The most that two sets of these part sizes can share; ``total`` if a part is too full to say."""
    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if max(x.max(), y.max()) == FULL_FINE:
        return total
    few = min(len(x), len(y))
    return int(np.minimum(x.reshape(few, -1).sum(1), y.reshape(few, -1).sum(1)).sum())


def _digests(table: DataFrame, n: int) -> DataFrame:
    """(doc_id, id, uid, slab, at, n, d1, d2, parts, few): the size, a 128-bit digest and the part sizes of each document's set,
    more parts the larger it is, and ``FEW``."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, begin = sets(texts_of(row), n)
                size, two = np.diff(begin), []
                for salt in (U64(0x51ED270B), U64(0x2545F4914F6CDD1D)):
                    total = np.concatenate([[U64(0)], np.cumsum(mix(values ^ salt))])
                    two.append(pa.array((total[begin[1:]] - total[begin[:-1]]).view(np.int64)))
                parts = [part_sizes(values[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
                where = np.repeat(np.arange(len(size)), size) * FEW + (values >> U64(58)).astype(np.int64)
                few = np.minimum(np.bincount(where, minlength=len(size) * FEW), FULL_FINE).astype(np.int16)
                few = pa.ListArray.from_arrays(pa.array(np.arange(0, len(few) + 1, FEW), pa.int32()), pa.array(few))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(row[c], pa.int64()) for c in ("doc_id", "id", "uid")], pa.array([row["slab"]] * len(size)), pa.array(np.arange(len(size))), pa.array(size), *two, pa.array(parts, pa.binary()), few],
                    ["doc_id", "id", "uid", "slab", "at", "n", "d1", "d2", "parts", "few"])

    return table.mapInArrow(run, schema(**{c: "long" for c in ("doc_id", "id", "uid", "slab", "at", "n", "d1", "d2")}, parts="binary", few="array<smallint>"))


def _frequencies(table: DataFrame, n: int) -> np.ndarray:
    """How often shingles of each hash bucket occur in all sets: one counter table, whatever the input's size."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += np.bincount((sets(texts_of(row), n)[0] % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = table.mapInArrow(run, schema(bucket="long", n="long")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for batch in found.toArrow().to_batches():  # COUNTERS rows at most
        out[batch.column("bucket").to_numpy()] = batch.column("n").to_numpy()
    return out


def _prefixes(values: np.ndarray, begin: np.ndarray, t: Fraction, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, owner, place) of every set's prefix, its first |x| - ceil(t |x|) + 1 shingles in rare-first order."""
    size = np.diff(begin)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((values, seen[(values % U64(COUNTERS)).astype(np.int64)], doc))
    at = np.arange(len(values)) - begin[doc]
    length = size - (size * t.numerator + t.denominator - 1) // t.denominator + 1
    keep = at < length[doc]
    return values[order][keep], doc[keep], at[keep]


def size_classes(size: np.ndarray, t: Fraction) -> np.ndarray:
    """A class for each set size; two similar sets are of one class or of neighbouring ones."""
    step = max(math.log(t.denominator / t.numerator), 1e-9) * (1 + 1e-9)
    return np.minimum(np.log(np.maximum(size, 1)) / step, LAST_SIZE).astype(np.uint8)


def entries(token: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of token and class in ascending order, and the place of each given pair among them."""
    order = np.lexsort((kind, token))
    t, k = token[order], kind[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    place = np.empty(len(t), np.int64)
    place[order] = np.cumsum(new) - 1
    return t[new], k[new], place


def like_users(token: np.ndarray, kind: np.ndarray, times: np.ndarray) -> np.ndarray:
    """For each entry, how often its token occurs with its own class of sizes or a neighbouring one."""
    own, k, place = entries(token, kind)
    total = np.bincount(place, times, minlength=len(own)).astype(np.int64)
    near = (own[1:] == own[:-1]) & (k[1:].astype(np.int64) - k[:-1] <= 1)
    out = total.copy()
    out[1:] += np.where(near, total[:-1], 0)
    out[:-1] += np.where(near, total[1:], 0)
    return out[place]


def _all_prefixes(table: DataFrame, n: int, t: Fraction, shared, shift: int) -> DataFrame:
    """Per slab: rows (bucket, slab, keys, kinds, times) with its distinct prefix shingles by size class and how often it has
    each; and a row of bucket -1 whose ``keys`` are the prefixes themselves, with ``facts``: for each document its id, set
    size, prefix size and the sizes of its set's parts. So texts are not read again once the users of a shingle are known."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, begin = sets(texts_of(row), n)
                token, owner, _ = _prefixes(values, begin, t, shared.value)
                size = np.diff(begin)
                own, kinds, place = entries(token, size_classes(size, t)[owner])
                times = np.minimum(np.bincount(place, minlength=len(own)), MANY).astype(np.uint8)
                where = np.repeat(np.arange(len(size)), size) * PARTS + (values >> U64(61)).astype(np.int64)
                sizes = np.minimum(np.bincount(where, minlength=len(size) * PARTS), FULL).reshape(-1, PARTS)
                packed = [sum(sizes[:, 4 * h + k] << (15 * k) for k in range(4)) for h in (0, 1)]
                facts = np.array([row["id"], size, np.bincount(owner, minlength=len(size)), *packed], np.int64)
                out = [(b, row["slab"], pack(own[i:j], b << shift), kinds[i:j].tobytes(), times[i:j].tobytes(), None) for b, i, j in dealt(own, shift)]
                yield record([*out, (-1, row["slab"], token.tobytes(), None, None, facts.tobytes())],
                             bucket=pa.int64(), slab=pa.int64(), keys=pa.binary(), kinds=pa.binary(), times=pa.binary(), facts=pa.binary())

    return table.mapInArrow(run, schema(bucket="long", slab="long", keys="binary", kinds="binary", times="binary", facts="binary"))


def _all_users(requests: DataFrame, shift: int) -> DataFrame:
    """(slab, answers): for each slab, by bucket, the ``like_users`` of its entries among all slabs, ``MANY`` at most.

    ``requests`` holds (bucket, slab, keys, kinds, times), one entry for a slab's shingle and size class however frequent.
    """

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [unpack(r["keys"], r["bucket"] << shift) for r in rows]
        both = [np.concatenate([np.frombuffer(r[c], np.uint8) for r in rows]) for c in ("kinds", "times")]
        users = np.minimum(like_users(np.concatenate(keys), *both), MANY).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        out = [(r["slab"], r["bucket"], users[e - len(k) : e].tobytes()) for r, k, e in zip(rows, keys, ends, strict=True)]
        return pa.Table.from_batches([record(out, slab=pa.int64(), bucket=pa.int64(), users=pa.binary())])

    found = requests.groupBy("bucket").applyInArrow(run, schema(slab="long", bucket="long", users="binary"))
    return found.groupBy("slab").agg(F.sort_array(F.collect_list(F.struct("bucket", "users"))).alias("answers"))


def _prefix_rows(held: DataFrame, t: Fraction) -> DataFrame:
    """(token, id, n, at, p0, p1, reach): the prefix shingles that the first documents of two classes of like size may
    share, with the sizes of their set's parts and the users of a document's shingles together, for its size."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                token = np.frombuffer(row["keys"], U64)
                ids, size, length, p0, p1 = np.frombuffer(row["facts"], np.int64).reshape(5, -1)
                owner = np.repeat(np.arange(len(ids)), length)
                at = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
                own, _, place = entries(token, size_classes(size, t)[owner])
                users = np.frombuffer(b"".join(a["users"] for a in row["answers"] or []), np.uint8)
                if len(users) != len(own):
                    raise ValueError(f"slab {row['slab']} has {len(own)} keys and {len(users)} answers")
                users = users[place].astype(np.int64)
                reach = (np.bincount(owner, np.where(users > 1, users, 0), minlength=len(ids)) / np.maximum(size, 1)).astype(np.float32)
                first = np.zeros(len(ids), bool)
                first[row["firsts"]] = True
                keep = (users > 1) & first[owner]
                token, owner, at = token[keep], owner[keep], at[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(ids[owner]), pa.array(size[owner].astype(np.int32)),
                     pa.array(at.astype(np.int32)), pa.array(p0[owner]), pa.array(p1[owner]), pa.array(reach[owner])], ["token", "id", "n", "at", "p0", "p1", "reach"])

    return held.mapInArrow(run, schema(token="long", id="long", n="int", at="int", p0="long", p1="long", reach="float"))


def _need(t: Fraction) -> str:
    """The least overlap of two similar sets of the sizes of rows a and b, in SQL."""
    p, q = t.numerator, t.denominator
    return f"ceil(({p}D * (a.n + b.n)) / {p + q}D - 1e-9)"


def _filters(t: Fraction) -> str:
    """Length, positional and suffix filter of two prefix rows a and b, in SQL.

    Past a shared token, no more can be shared than the shorter rest.
    The suffix filter parts both sets by hash: they share at most the sum of the smaller sizes (a part of ``FULL`` or
    more could be any size, so it bounds nothing).
    """
    p, q, need = t.numerator, t.denominator, _need(t)
    bits = lambda side, h, k: f"(shiftright({side}.p{h}, {15 * k}) & {FULL})"
    parts = [(h, k) for h in (0, 1) for k in range(4)]
    least = " + ".join(f"least({bits('a', h, k)}, {bits('b', h, k)})" for h, k in parts)
    full = " OR ".join(f"{bits('a', h, k)} = {FULL} AND {bits('b', h, k)} = {FULL}" for h, k in parts)
    return (f"{q} * least(a.n, b.n) >= {p} * greatest(a.n, b.n) AND least(a.at, b.at) + least(a.n - a.at, b.n - b.at) >= {need}"
            f" AND ({least} >= {need} OR {full})")


def _bounded(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that may be similar enough by the sizes of finer parts of their sets."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("parts").alias(f"parts_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def test(batches):
        for batch in batches:
            keep = []
            for x, y, total in zip(batch.column("parts_a").to_pylist(), batch.column("parts_b").to_pylist(), batch.column("total").to_pylist(), strict=True):
                shared = may_share(x, y, total)
                keep.append(shared * t.denominator >= t.numerator * (total - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = both.select("a", "b", "parts_a", "parts_b", (F.col("n_a") + F.col("n_b")).alias("total"))
    return durable(asked.mapInArrow(test, schema(a="long", b="long")))


def _alike(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that may be similar enough by ``FEW`` parts of their sets."""
    side = lambda s: classes.select(F.col("rep").alias(f"id_{s}"), F.struct("n", "few").alias(s))
    both = pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).join(side("a"), "id_a").join(side("b"), "id_b")
    return both.filter(f"{FEW_SHARE} >= {_need(t)}").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _side_by_side(pairs: DataFrame, classes: DataFrame, table: DataFrame, n: int, bits: int) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...: whole numbers) with the whole sets of both documents: packed shingles x and y, sizes
    na and nb. The set of b is read with the row that asks for it and goes straight to that of a, which is sent once.

    Up to ``SENT`` sets to read are named to every task, so the slabs stay where they are; beyond it slabs are shuffled.
    """
    names, place = pairs.columns, classes.select("rep", "slab", "at")
    of_b = pairs.join(place.withColumnRenamed("rep", "b"), "b").select("slab", "at", *names)
    of_a = pairs.select("a").distinct().join(place.withColumnRenamed("rep", "a"), "a")
    of_a = of_a.select("slab", "at", *[F.col("a") if c == "a" else F.lit(None).cast("long").alias(c) for c in names])
    asked = durable(of_b.union(of_a))
    wanted = asked.groupBy("slab").agg(F.sort_array(F.collect_list(F.struct("at", *names))).alias("wanted"))
    if asked.count() <= SENT:
        wanted = F.broadcast(wanted)
    kinds = {**{c: pa.int64() for c in names}, "n": pa.int64(), "shingles": pa.binary()}

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, begin = sets(texts_of(row), n)
                out, at, own = [], -1, ()
                for w in row["wanted"]:
                    if w["at"] != at:
                        at = w["at"]
                        own = (int(begin[at + 1] - begin[at]), pack(np.unique(values[begin[at] : begin[at + 1]] >> U64(64 - bits)), 0))
                    out.append((*[w[c] for c in names], *own))
                    if len(out) == 256:
                        yield record(out, **kinds)
                        out = []
                yield record(out, **kinds)

    found = durable(table.join(wanted, "slab").mapInArrow(read, schema(**{c: "long" for c in names}, n="long", shingles="binary")))
    left = found.filter("b IS NULL").select("a", F.col("n").alias("na"), F.col("shingles").alias("x"))
    return left.join(found.filter("b IS NOT NULL").withColumnsRenamed({"n": "nb", "shingles": "y"}), "a")


def _verified(pairs: DataFrame, classes: DataFrame, table: DataFrame, n: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, each tested once on the whole sets of its two documents."""
    with scratch(pairs.sparkSession) as read:
        both = _side_by_side(pairs, classes, table, n, BITS)

    def test(batches):
        for batch in batches:
            keep = []
            for x, y, na, nb in zip(*[batch.column(c).to_pylist() for c in ("x", "y", "na", "nb")], strict=True):
                shared = len(np.intersect1d(unpack(x, 0), unpack(y, 0), assume_unique=True))
                keep.append(shared * t.denominator >= t.numerator * (na + nb - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    done = durable(both.select("a", "b", "x", "y", "na", "nb").mapInArrow(test, schema(a="long", b="long")))
    drop(pairs.sparkSession, read)
    return done


def difference_prefix(x: np.ndarray, hub: np.ndarray, t: Fraction, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a set and a hub do not share, and the part of it that a similar set of another component must meet.

    If a and b differ from one hub by A and B, they differ from each other by |A| + |B| - 2 |A & B|, of which a similar
    pair may have c (|a| + |b|), c = (1 - t) / (1 + t). Two sets linked to the hub are in one component already, so one of
    the pair differs from the hub by more than c (|a| + |hub|): then A and B share something, and b more than half of B
    (by equal sizes). The order is the same for all sets of a hub: shingles the hub has not, rare ones first, then those
    only the hub has, which many sets may lack.
    """
    p, q = t.numerator, t.denominator
    own, lost = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    often = lambda values: seen[(values % U64(COUNTERS)).astype(np.int64)]
    apart = np.concatenate([own[np.lexsort((own, often(own)))], lost[np.lexsort((lost, -often(lost)))]])
    d, n = len(apart), len(x)
    length = min(d, n * (q - p) // p + 1)  # whatever the other set's size
    if d * (q + p) <= (q - p) * (n + len(hub)):
        length = min(length, d - ((q - p) * (len(hub) - n) + (q + p) * d) // (2 * (q + p)))
    return apart, apart[:length]


def _differences(members: DataFrame, classes: DataFrame, table: DataFrame, n: int, t: Fraction, shared) -> DataFrame:
    """(ref, id, component, n, d, few, prefix) for each of ``members`` (ref, id, component): how many shingles its set and
    its hub's do not share, the sizes of ``FEW`` parts of them, and their ``difference_prefix``."""
    with scratch(members.sparkSession) as read:
        both = _side_by_side(members.withColumnsRenamed({"ref": "a", "id": "b"}), classes, table, n, 64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    apart, prefix = difference_prefix(unpack(r["y"], 0), unpack(r["x"], 0), t, shared.value)
                    few = np.minimum(np.bincount((apart >> U64(58)).astype(np.int64), minlength=FEW), FULL_FINE)
                    out.append((r["a"], r["b"], r["component"], r["nb"], len(apart), few.astype(np.int16), prefix.view(np.int64)))
                yield record(out, ref=pa.int64(), id=pa.int64(), component=pa.int64(), n=pa.int64(), d=pa.int64(), few=pa.list_(pa.int16()), prefix=pa.list_(pa.int64()))

    kinds = schema(ref="long", id="long", component="long", n="long", d="long", few="array<smallint>", prefix="array<long>")
    done = durable(both.select("a", "b", "component", "x", "y", "nb").mapInArrow(run, kinds))
    drop(members.sparkSession, read)
    return done


def _within(members: DataFrame, classes: DataFrame, table: DataFrame, n: int, t: Fraction, shared) -> DataFrame:
    """The pairs (a, b) of one hub in different components that may be similar enough, by what they do not share with it."""
    p, q = t.numerator, t.denominator
    apart = _differences(members, classes, table, n, t, shared)
    rows = apart.select("ref", "id", "component", "n", "d", F.posexplode("prefix").alias("at", "token"))
    split = rows.groupBy("ref", "token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("ref", "token")
    # an id with several sets has several rows of one hub
    rows = durable(rows.join(split, ["ref", "token"]).join(apart.select("ref", "id", "n", "d", "few").distinct(), ["ref", "id", "n", "d"]))
    need = f"ceil(({p + q}D * (a.d + b.d) - {q - p}D * (a.n + b.n)) / {2 * (p + q)}D - 1e-9)"
    met = rows.alias("a").join(rows.alias("b"), F.expr(
        f"a.ref = b.ref AND a.token = b.token AND a.id < b.id AND a.component <> b.component AND {q} * least(a.n, b.n) >= {p} * greatest(a.n, b.n)"
        f" AND least(a.d - a.at, b.d - b.at) >= {need} AND {FEW_SHARE} >= {need}"))
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def linked(docs: DataFrame, n: int, threshold: str, node: str = "id") -> DataFrame:
    """(doc_id, id, uid, n_shingles, component) of every document: its set size and the least id its links lead to.
    With ``node="uid"`` the row's uid takes the place of its id.

    Two documents link when the Jaccard similarity of their distinct n-word shingles is at least ``threshold``. Documents
    with equal sets are one class from the start, so copies never meet in pairs. Each class writes its prefix, the
    rarest shingles by a frequency sketch of all documents, in one order for all; two similar sets share a prefix shingle.

    A prefix shingle counts for a class only if a set of like size has it too (``size_classes``).

    Round 1 tests every class against the hub of each of its prefix shingles: of the shingle's users the one whose prefix
    has the most users for its size, so the one amid a group of near copies. Round 2 tests pairs that share a prefix shingle and
    are not yet in one component. They meet at their first common prefix shingle, unless more than ``CROWD`` classes use it and
    the hub of the widest reach, of those of like size, is the same for both: those meet by what they do not share with it
    (``difference_prefix``), so a group of near copies, each a little further from the others than a link allows, is not
    multiplied out by what they all have. No link that joins two components is lost. Both rounds apply length, positional
    and suffix filters before a pair is made, a finer suffix filter once for each pair, and test each pair that is left once
    on whole sets.

    Texts without words (null, empty) have no set and are their own component. Null ids count as one largest id. Rows with one
    id are one document to links; each gets a row. An empty table gives no rows.
    """
    t = Fraction(threshold)
    table = slabs(keyed(docs).withColumn("id", F.col(node)))
    digests = durable(_digests(table, n))
    classes = durable(digests.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "slab", "at", "parts", "few")).alias("least")).select(
        "n", "d1", "d2", F.col("least.id").alias("rep"), "least.slab", "least.at", "least.parts", "least.few"))
    shift = shift_for(table, 64)
    shared = docs.sparkSession.sparkContext.broadcast(_frequencies(table, n))
    with scratch(docs.sparkSession) as asked:
        given = durable(_all_prefixes(table, n, t, shared, shift))
    answers = _all_users(given.filter("bucket >= 0").select("bucket", "slab", "keys", "kinds", "times"), shift)
    firsts = classes.groupBy("slab").agg(F.collect_list("at").alias("firsts"))
    held = given.filter("bucket < 0").select("slab", "keys", "facts")
    prefixes = durable(_prefix_rows(held.join(answers, "slab", "left").join(firsts, "slab"), t))
    drop(docs.sparkSession, asked)
    hubs = durable(prefixes.groupBy("token").agg(F.count("*").alias("users"), F.max(F.struct("reach", "id", "n", "at", "p0", "p1")).alias("hub")).filter(
        "users > 1").select("token", "users", "hub.*"))
    meets = F.expr(f"a.id <> b.id AND {_filters(t)}")
    used = durable(prefixes.alias("b").join(hubs.alias("a"), F.expr("a.token = b.token")).select("b.token", "b.id", "b.n", "b.at", "b.p0", "b.p1", "a.users", "a.reach", F.col("a.id").alias("hub_id"), F.col("a.n").alias("hub_n"), meets.alias("meets"),
        F.expr("a.id = b.id AND a.n = b.n AND a.at = b.at AND a.p0 = b.p0 AND a.p1 = b.p1").alias("is_hub")))
    pairs = durable(used.filter("meets").select(F.col("hub_id").alias("a"), F.col("id").alias("b")).distinct())
    links = _verified(_bounded(pairs, classes, t), classes, table, n, t)
    so_far = durable(components(links))
    rest = used.filter("NOT is_hub AND users > 2").join(so_far.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = rest.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("token")
    rest = durable(rest.join(split, "token").drop("meets", "is_hub"))
    # a hub of another size has nothing to compare with, and an id with several sets may meet itself
    hub = F.when(F.expr(f"hub_id <> id AND {t.denominator} * least(n, hub_n) >= {t.numerator} * greatest(n, hub_n)"), F.struct("reach", "hub_id"))
    home = durable(rest.groupBy("id", "component").agg(F.max(hub).alias("hub")).select("id", "component", F.col("hub.hub_id").alias("ref")))
    rest = durable(rest.drop("reach", "hub_id", "hub_n").join(home.select("id", "ref"), "id"))
    crowded = rest.filter(f"users > {CROWD} AND ref IS NOT NULL").select("ref", "token", "id", "component")
    mixed = crowded.groupBy("ref", "token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1")
    members = durable(crowded.join(mixed, ["ref", "token"], "left_semi").select("ref", "id", "component").distinct())
    met = rest.alias("a").join(rest.alias("b"), F.expr(
        f"a.token = b.token AND a.id < b.id AND a.component <> b.component AND (a.users <= {CROWD} OR coalesce(a.ref <> b.ref, true))"
        f" AND least(a.n - a.at, b.n - b.at) >= {_need(t)} AND {_filters(t)}"))
    more = _within(members, classes, table, n, t, shared).union(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))).distinct()
    more = durable(more.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = durable(_alike(more, classes, t))
    more = _bounded(more, classes, t)
    links = links.union(_verified(more, classes, table, n, t)) if not more.isEmpty() else links
    groups = components(links)
    known = classes.select("n", "d1", "d2", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    done = digests.drop("parts", "few").join(known, ["n", "d1", "d2"], "left")
    component = F.coalesce("component", "id")
    return done.select("doc_id", "id", "uid", F.col("n").alias("n_shingles"), component.alias("component"))


def jaccard_groups(docs: DataFrame, n: int = 3, threshold: str = "0.9") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; see ``linked``."""
    return linked(docs, n, threshold).select("doc_id", "n_shingles", F.when(F.col("component") < LAST, F.col("component")).alias("component_id"))


def first_of_groups(docs: DataFrame, n: int = 5, threshold: str = "0.8") -> DataFrame:
    """(uid): of each group of linked rows the one with the least (id, uid), and every row without words.

    Rows link by their texts alone: rows without an id, or with the same, are as many nodes as they have texts.
    """
    done = linked(docs, n, threshold, node="uid").select("component", "n_shingles", F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.col("id").alias("uid")).alias("row"))
    first = done.filter("n_shingles > 0").groupBy("component").agg(F.min("row").alias("row")).select("row.uid")
    return first.union(done.filter("n_shingles = 0").select("row.uid").distinct())
