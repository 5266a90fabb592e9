"""Hard negatives from vectors by one-bit codes with exact bounds.

A vector is turned by a fixed rotation (sign flips and Hadamard butterflies) and kept as LEVELS layers of sign bits: a
layer is the signs of what the layers before left over, turned once more, with its alignment (the length of the leftover
along the signs) beside it, and the length of what remains. An anchor is turned as often and cut to 8-bit steps, so its
product with a layer is eight popcounts. Alignments times those products estimate a score; by Cauchy-Schwarz the error is
at most the anchor's length times the remaining length, plus the anchor's rounding times the length of each layer.
Layers are read one after another, and a row stays a candidate only while its interval can still matter (TESTED). What remains is
scored in integers, so the result is exact.

Rows and anchors are written in packed blocks; a cell is one group of anchor blocks and one of row blocks, both of bounded
size. Cells keep each anchor's best few, which are merged by a window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from idmatch.llm.words import schema, typed
from idmatch.session import durable

#: Layers of bits, those after which candidates are dropped, and rows of a block.
LEVELS, TESTED, BLOCK = 6, (1, 3, 5), 4096
#: Blocks of rows and anchors of a cell: a share of all, within bounds. Tasks that cells are dealt to.
ROW_BLOCKS, ANCHORS, MOST_TASKS = (1, 16), (128, 8192), 1 << 15
SCALE = 256
NO_ID = np.iinfo(np.int64).max


def signs(width: int, turn: int) -> np.ndarray:
    """A fixed row of signs."""
    x = (np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(turn * 0x632BE59BD9B4E019 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where((x >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows turned by a fixed orthogonal map; widths are filled up to a power of two, 64 at least."""
    width = max(64, 1 << (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for turn in range(3):
        y *= signs(width, turn)
        step = 1
        while step < width:
            pair = y.reshape(len(x), -1, 2, step)
            y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(x), width)
            step *= 2
        y /= np.sqrt(width)
    return y


def bits(mask: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words, word by word: (words, rows)."""
    return np.ascontiguousarray(np.packbits(mask, axis=1, bitorder="little").view("<u8").T)


class Codes:
    """LEVELS layers of sign bits of some vectors: bits (layer, word, row), step of each layer (its alignment over the root
    of the width), the length that remains after it, and the whole length."""

    def __init__(self, layers: np.ndarray, step: np.ndarray, left: np.ndarray, length: np.ndarray, ones: np.ndarray | None = None):
        self.layers, self.step, self.left, self.length = layers, step, left, length
        self.ones = np.bitwise_count(layers).sum(axis=1, dtype=np.int64) if ones is None else ones

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        rest, layers, step, left = x.astype(np.float64), [], [], []
        length = np.sqrt((rest**2).sum(axis=1))
        for _ in range(LEVELS):
            rest = rotated(rest)
            up = rest > 0
            along = np.abs(rest).mean(axis=1)
            rest = rest - np.where(up, along[:, None], -along[:, None])
            layers.append(bits(up))
            step.append(along)
            left.append(np.sqrt((rest**2).sum(axis=1)))
        return cls(np.array(layers), np.array(step), np.array(left), length)

    def take(self, part: slice) -> Codes:
        return Codes(self.layers[:, :, part], self.step[:, part], self.left[:, part], self.length[part], self.ones[:, part])

    def stored(self) -> tuple[bytes, bytes]:
        return self.layers.tobytes(), np.concatenate([self.step, self.left, self.length[None, :]]).tobytes()

    @classmethod
    def read(cls, layers: bytes, numbers: bytes, n: int) -> Codes:
        numbers = np.frombuffer(numbers).reshape(-1, n)
        return cls(np.frombuffer(layers, "<u8").reshape(LEVELS, -1, n), numbers[:LEVELS], numbers[LEVELS:-1], numbers[-1])


class Asked:
    """An anchor turned for each layer and cut to 8 bits, for popcounts: (step, rounding, sum, bit planes) of each layer."""

    def __init__(self, length: float, layers: list[tuple[float, float, int, np.ndarray]]):
        self.length, self.layers = length, layers

    @classmethod
    def all_of(cls, x: np.ndarray) -> list[Asked]:
        y, layers = x.astype(np.float64), []
        length = np.sqrt((y**2).sum(axis=1))
        for _ in range(LEVELS):
            y = rotated(y)
            unit = np.maximum(np.abs(y).max(axis=1), 1e-300) / 127
            whole = np.rint(y / unit[:, None]).astype(np.int64)
            lost = np.sqrt(((y - unit[:, None] * whole) ** 2).sum(axis=1) * y.shape[1])
            layers.append((unit, lost, whole.sum(axis=1), np.stack([bits((whole + 128) >> b & 1 == 1) for b in range(8)])))
        return [cls(float(length[i]), [(float(unit[i]), float(lost[i]), int(total[i]), planes[:, :, i]) for unit, lost, total, planes in layers]) for i in range(len(x))]

    def narrow(self, codes: Codes, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Places whose score may be wanted: after each layer in TESTED ``wanted(low, high)`` says which intervals may be."""
        at, about, rounding = np.arange(len(codes.length)), np.zeros(len(codes.length)), 1e-9 * self.length * codes.length + 1e-6
        for i, (unit, lost, total, planes) in enumerate(self.layers):
            up, step = -128 * codes.ones[i][at], codes.step[i][at]  # the planes hold the steps raised by 128
            for word, masks in zip(codes.layers[i][:, at], planes.T, strict=True):
                for b, mask in enumerate(masks):
                    up += np.left_shift(np.bitwise_count(word & mask), b, dtype=np.int64)
            about = about + step * (unit * (2.0 * up - total))  # under set bits twice, less the whole
            rounding = rounding + lost * step
            if i in TESTED:
                reach = self.length * codes.left[i][at] + rounding
                keep = wanted(about - reach, about + reach)
                if not keep.all():
                    at, about, rounding = at[keep], about[keep], rounding[keep]
        return at


def scaled(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of rows of one width; at most what a product can hold in 64 bits."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    most = np.floor(np.sqrt(2.0**62 / max(1, x.shape[1])))
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


BLOCK_FIELDS = {"block": "long", "width": "long", "kind": "string", **dict.fromkeys(("ids", "labels", "rows", "x", "layers", "numbers"), "binary")}


def narrowest(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes."""
    most = int(np.abs(x).max(initial=0))
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def blocks(vectors: DataFrame, limit: int = BLOCK) -> DataFrame:
    """Rows (vec_id, label, v) as packed blocks of one width, by label within a block; written once.

    ``rows`` numbers the rows of the whole table, so that repeated rows stay apart.
    """

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        waiting: dict[int, list[pa.RecordBatch]] = {}

        def packed(width: int) -> pa.RecordBatch:
            nonlocal n
            rows = pa.Table.from_batches(waiting.pop(width)).combine_chunks()
            labels = rows.column("label").to_numpy()
            order = np.argsort(labels, kind="stable")
            rows, ids = rows.take(pa.array(order)), rows.column("vec_id").fill_null(NO_ID).to_numpy()[order]
            number = (task << 32) + n + np.arange(len(ids))
            n += len(ids)
            x = scaled(rows.column("v").combine_chunks())
            kept = narrowest(x)
            one = (int(number[0]), width, kept.dtype.str, *[a.tobytes() for a in (ids, labels[order], number, kept)], *Codes.of(x).stored())
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in one], list(BLOCK_FIELDS))

        for batch in batches:
            width = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for w in np.unique(width):
                own = batch.filter(pa.array(width == w))
                while own.num_rows:
                    held = waiting.setdefault(int(w), [])
                    some = own.slice(0, limit - sum(b.num_rows for b in held))
                    held.append(some)
                    own = own.slice(some.num_rows)
                    if sum(b.num_rows for b in held) == limit:
                        yield packed(int(w))
        for w in sorted(waiting):
            yield packed(w)

    return durable(vectors.mapInArrow(run, schema(**BLOCK_FIELDS)))


class Block:
    def __init__(self, row: dict):
        self.ids, self.labels, self.rows = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "rows"))
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(len(self.ids), -1)
        self.codes = Codes.read(row["layers"], row["numbers"], len(self.ids))

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whole-number products of the rows at these places."""
        return self.x[at].astype(np.int64) @ x

    def of_label(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


def best(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, then smaller ids, then earlier rows."""
    return np.lexsort((rows, ids, -score))[:k]


class Top:
    """The k best so far, as (score, id, row)."""

    def __init__(self, k: int):
        self.k, self.held = k, np.zeros((0, 3), np.int64)

    @property
    def least(self) -> float:
        """A score below this cannot get in any more."""
        return self.held[-1, 0] if len(self.held) == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        all_ = np.concatenate([self.held, np.stack([score, ids, rows], axis=1)])
        self.held = all_[best(all_[:, 0], all_[:, 1], all_[:, 2], self.k)]


def cells(rows: DataFrame, asked: DataFrame, row_blocks: int, groups: int, run: Callable[[list[dict], list[dict]], Iterator[tuple]], out: dict[str, str]) -> DataFrame:
    """``run(row blocks, anchor groups)`` for each cell of the grid: ``row_blocks`` blocks of rows and one group of anchors.
    Blocks are dealt by a digest of their number, so cells are alike however rows and labels lie."""
    n, m = max(1, -(-rows.count() // row_blocks)), groups
    left = rows.withColumn("r", F.pmod(F.xxhash64("block"), F.lit(n))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.withColumn("a", F.col("group").cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    tasks = min(n * m, MOST_TASKS)

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        found = list(run(one.to_pylist(), two.to_pylist()))
        return pa.table({c: pa.array([r[i] for r in found], pa.int64()) for i, c in enumerate(out)})

    spread = lambda df: df.repartition(tasks, "r", "a").groupBy("r", "a")
    return spread(left).cogroup(spread(right)).applyInArrow(cell, schema(**out))


def anchors_of(rows: DataFrame, every: int) -> DataFrame:
    """The rows of packed blocks whose id is divisible by ``every``, as (block, width, row, id, label, x)."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                ids, labels, number = (np.frombuffer(block[c], "<i8") for c in ("ids", "labels", "rows"))
                at = np.flatnonzero((ids % every == 0) & (ids != NO_ID))
                x = np.frombuffer(block["x"], block["kind"]).astype("<i8").reshape(len(ids), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), block["width"])), pa.array(number[at]), pa.array(ids[at]), pa.array(labels[at]), pa.array([x[i].tobytes() for i in at], pa.binary())],
                    ["width", "row", "id", "label", "x"])

    found = rows.mapInArrow(run, schema(width="long", row="long", id="long", label="long", x="binary"))
    return found.withColumn("block", F.xxhash64("row"))


def hard_negatives(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   block: int = BLOCK, row_blocks: tuple[int, int] = ROW_BLOCKS, anchor_group: tuple[int, int] = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, v).

    Components count as floor(256 * x); a score is the inner product of two rows in integers, and a higher score, then the
    smaller vec_id, then the earlier row comes first. Anchors are rows whose vec_id is divisible by ``anchor_every``; their
    positives are the first ``positives`` other rows of their label, and for each positive the negatives are the first
    ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    Rows with a null label, a null or empty vector, or a null or non-finite component take no part. A row without a vec_id
    can be found but is no anchor; it comes last among equal scores. Repeated rows are rows of their own. Vectors of
    another width than the anchor's are not compared with it. Components beyond what a product can hold in 64 bits count as
    the largest that fits (for 64 dimensions beyond a million). Other columns stay out. No rows give no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>"))
    whole = F.forall("v", lambda x: x.isNotNull() & (F.abs(x * float(SCALE)) < float("inf")))
    packed = blocks(rows.filter(F.col("label").isNotNull() & (F.size("v") > 0) & whole), block)
    anchors = durable(anchors_of(packed, anchor_every))
    share = lambda n, parts, least, most: min(max(n // parts, least), most)
    per_cell, n = share(packed.count(), 32, *row_blocks), anchors.count()
    groups = max(1, -(-n // share(n, 8, *anchor_group)))

    def asked(table: DataFrame, *extra: str) -> DataFrame:
        """Anchors dealt to groups of about ``anchor_group``, one packed row each."""
        one = F.struct("width", "row", "id", "label", "x", *extra)
        return durable(table.groupBy(F.pmod("block", F.lit(groups)).alias("group")).agg(F.collect_list(one).alias("anchors")))

    def each(row_side: list[dict], anchor_side: list[dict]) -> Iterator[tuple[list[Block], dict, np.ndarray, Asked]]:
        """The anchors of a cell, each with the row blocks of its width."""
        of_width: dict[int, list[Block]] = {}
        for r in row_side if anchor_side else []:
            of_width.setdefault(r["width"], []).append(Block(r))
        for width, held in of_width.items():
            own = [a for side in anchor_side for a in side["anchors"] if a["width"] == width]
            if own:
                x = np.frombuffer(b"".join(a["x"] for a in own), "<i8").reshape(len(own), width)
                yield from zip([held] * len(own), own, x, Asked.all_of(x), strict=True)

    def nearest(row_side: list[dict], anchor_side: list[dict]) -> Iterator[tuple]:
        for held, a, x, ask in each(row_side, anchor_side):
            top = Top(positives)
            for b in held:
                start, end = b.of_label(a["label"])
                if start == end:
                    continue
                itself = int((b.rows[start:end] == a["row"]).any())
                at = start + ask.narrow(b.codes.take(slice(start, end)), _reaching(top, itself))
                at = at[b.rows[at] != a["row"]]
                top.add(b.scores(at, x), b.ids[at], b.rows[at])
            yield from ((a["row"], *found) for found in top.held.tolist())

    kept = {"anchor": "long", "score": "long", "id": "long", "row": "long"}
    first = lambda df, k, *by: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id", "row"))).filter(F.col("rank") <= k)
    found = first(cells(packed, asked(anchors), per_cell, groups, nearest, kept), positives, "anchor")
    own = durable(found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("own")))

    def farther(row_side: list[dict], anchor_side: list[dict]) -> Iterator[tuple]:
        for held, a, x, ask in each(row_side, anchor_side):
            spans = [(p["rank"], -(-low * p["score"] // 100), high * p["score"] // 100, Top(negatives)) for p in a["own"]]
            spans = [s for s in spans if s[1] <= s[2]]
            for b in held if spans else []:
                start, end = b.of_label(a["label"])
                for part in (slice(0, start), slice(end, len(b.ids))):
                    at = ask.narrow(b.codes.take(part), _between(spans)) + part.start
                    score = b.scores(at, x)
                    for _, least, most, top in spans:
                        fits = (score >= max(least, top.least)) & (score <= most)
                        top.add(score[fits], b.ids[at[fits]], b.rows[at[fits]])
            yield from ((a["row"], rank, *one) for rank, _, _, top in spans for one in top.held.tolist())

    with_own = anchors.join(own.withColumnRenamed("anchor", "row"), "row")
    negative = cells(packed, asked(with_own, "own"), per_cell, groups, farther, {"anchor": "long", "positive": "long", "score": "long", "id": "long", "row": "long"})
    listed = first(negative, negatives, "anchor", "positive").select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = with_own.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.inline("own")).withColumnsRenamed({"rank": "positive", "score": "positive_score", "id": "positive_id"})
    ident = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c)
    return listed.join(pairs, ["anchor", "positive"]).select("anchor_id", ident("positive_id"), "rank", ident("negative_id"), "positive_score", "negative_score")


def _reaching(top: Top, own: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Intervals that may reach the best k, where ``own`` of them (the anchor itself) does not count."""
    floor = -np.inf

    def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        nonlocal floor
        k = top.k + own
        promised = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf
        floor = max(floor, top.least, promised)
        return high >= floor

    return wanted


def _between(spans: list[tuple[int, int, int, Top]]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Intervals that may lie in a span and among its best k."""
    floors = [-np.inf] * len(spans)

    def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(low), bool)
        for i, (_, least, most, top) in enumerate(spans):
            sure = low[(low >= least) & (high <= most)]
            promised = np.partition(sure, len(sure) - top.k)[len(sure) - top.k] if len(sure) >= top.k else -np.inf
            floors[i] = max(floors[i], least, top.least, promised)
            keep |= (high >= floors[i]) & (low <= most)
        return keep

    return wanted
