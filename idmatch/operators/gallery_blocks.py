"""Galleries beyond one broadcast: blocks of templates that meet the probes by a shuffle.

Templates lie in blocks of about ``block_bytes``, ordered by the pivot nearest to the mean of their class, the mean's
angle to that pivot, and the class. A pivot is one of at most PIVOTS class means. For each block the least and largest
angle of its templates to the pivot are known, and by the triangle inequality no template of the block can be nearer to a
probe than the probe's own angle to the pivot allows. A search first scores each probe in its most promising block, and
after that visits only blocks whose bound reaches what it already has. Bounds are exact: no block that could change a
result is left out.

Neighbouring blocks make up a cell: some CELLS in all while a cell stays below CELL_BYTES, so a probe is sent once to each
cell with a block to visit, not once to each block, and what moves grows with the tables and not with their product. Inside
a cell each block is scored against the probes that visit it, and results are reduced over the cell.

A class lies whole in one cell unless cells meet inside it, so a class with very many templates is spread over tasks;
its scores are put together per probe afterwards. (cell, part of its probes) pairs are cogrouped; a part holds at most
about PART_ROWS probes, and nothing but the block bounds (at most some BLOCKS, whatever the gallery) reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from idmatch.operators.matrices import by_width
from idmatch.session import durable

#: Pivots (and bytes of all together), blocks at most about, probes of a part, and pairs that one step takes.
PIVOTS, PIVOT_BYTES, BLOCKS, PART_ROWS, PAIRS = 256, 4 << 20, 1 << 14, 1 << 14, 4_000_000
#: Cells about, and bytes of the templates of one, unless a block has more.
CELLS, CELL_BYTES = 16, 32 << 20
#: Vectors shorter than this have no direction to speak of; a block or probe with one is never skipped.
SHORT = 1e-5
SLACK = 1e-9


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a direction."""
    with np.errstate(all="ignore"):
        length = np.sqrt((x**2).sum(axis=1))
        good = np.isfinite(length) & (length >= SHORT)
        return np.where(good[:, None], x / length[:, None], 0.0), good


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


@dataclass(frozen=True)
class Bounds:
    """Blocks of each width: their numbers in order, pivots, and least and largest angle to the pivot; the numbers of all
    blocks in order, and the cell of each."""

    pivots: dict[int, np.ndarray]
    blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    every: np.ndarray
    cells: np.ndarray

    def cell(self, number: np.ndarray) -> np.ndarray:
        """The cells of some blocks."""
        return self.cells[np.searchsorted(self.every, number)]

    def masks(self, cell: int, number: np.ndarray, wanted: np.ndarray) -> pa.Array:
        """For each row of ``wanted`` one bit for each block of the cell, where its columns are the blocks ``number`` of it."""
        own = self.every[self.cells == cell]
        whole = np.zeros((len(wanted), len(own)), bool)
        whole[:, np.searchsorted(own, number)] = wanted
        bits = np.packbits(whole, axis=1)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())

    def highest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks of this width, the highest cosine that each row can have with a template of each block)."""
        number, pivot, low, high = self.blocks[x.shape[1]]
        turned, good = unit(x)
        out = np.ones((len(x), len(number)))
        known = np.flatnonzero(pivot >= 0)
        if len(known):
            at = angles(turned, self.pivots[x.shape[1]])[:, pivot[known]]
            least = np.maximum(0.0, np.maximum(at - high[known], low[known] - at))
            out[:, known] = np.where(good[:, None], np.cos(np.minimum(least, math.pi)) + SLACK, 1.0)
        return number, np.where(np.isfinite(x).all(axis=1)[:, None], out, -np.inf)


@dataclass(frozen=True)
class Blocks:
    """``table``: (cell, block, class, t, b, split, apart), where ``split`` marks a class that lies in several blocks and
    ``apart`` one that lies in several cells; whether there is one of these, and the most classes of a cell."""

    table: DataFrame
    bounds: Bounds
    has_apart: bool
    most: int

    def of_classes(self) -> DataFrame:
        """(class, cell, wanted): the cells of each class, and its blocks there."""
        shared = self.table.sparkSession.sparkContext.broadcast(self.bounds)
        held = self.table.groupBy("class", "cell").agg(F.collect_set("block").alias("blocks"))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = [shared.value.masks(cell, np.array(own), np.ones((1, len(own)), bool))[0].as_py()
                        for cell, own in zip(batch.column("cell").to_pylist(), batch.column("blocks").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("cell"), pa.array(bits, pa.binary())], ["class", "cell", "wanted"])

        return held.mapInArrow(mark, "class long, cell long, wanted binary")


def _pivots(means: DataFrame) -> dict[int, np.ndarray]:
    """The directions of some class means, chosen by a digest of the class: at most PIVOTS and PIVOT_BYTES."""
    width = means.agg(F.max("width")).first()[0] or 1
    chosen = means.orderBy(F.xxhash64("class", "width")).limit(max(1, min(PIVOTS, PIVOT_BYTES // (8 * width)))).collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in chosen:
        turned, good = unit(np.array([r["mean"]]))
        if good[0]:
            out.setdefault(r["width"], []).append(turned[0])
    return {w: np.array(p) for w, p in out.items()}


def build(gallery: DataFrame, values: int, block_bytes: int) -> Blocks:
    """Blocks of a written gallery (class, t, b) with ``values`` numbers in all."""
    block_bytes = max(block_bytes, values * 8 // BLOCKS)
    spark, rows = gallery.sparkSession, gallery.withColumn("width", F.size("t").cast("long"))
    whole = F.forall("t", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    means = durable(rows.filter(whole & (F.col("width") > 0)).groupBy("class", "width").agg(vector_to_array(Summarizer.mean(array_to_vector("t"))).alias("mean")))
    pivots = _pivots(means)
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, ring = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for width, (at, x) in by_width(batch.column("mean")).items():
                turned, good = unit(x)
                if width in shared.value and good.any():
                    angle = angles(turned, shared.value[width])
                    pivot[at] = np.where(good, angle.argmin(axis=1), -1)
                    ring[at] = np.where(good, angle.min(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("width"), pa.array(pivot), pa.array(ring)], ["class", "width", "pivot", "ring"])

    placed = rows.join(means.mapInArrow(place, "class long, width long, pivot long, ring double"), ["class", "width"], "left")
    order = [F.col("width"), F.coalesce("pivot", F.lit(-1)).alias("pivot"), F.col("ring"), F.col("class")]
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), values * 8 // block_bytes))
    ordered = placed.select(*order, F.xxhash64("t", "b").alias("salt"), "t", "b").repartitionByRange(tasks, "width", "pivot", "ring", "class", "salt")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, room, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            width, pivot = batch.column("width").to_numpy(), batch.column("pivot").to_numpy()
            number = np.empty(batch.num_rows, np.int64)
            for i, kind in enumerate(zip(width.tolist(), pivot.tolist(), strict=True)):
                if room <= 0 or kind != last:
                    n, room, last = n + 1, block_bytes, kind
                number[i] = n
                room -= 8 * kind[0]
            angle = np.full(batch.num_rows, np.nan)
            for w, (at, x) in by_width(batch.column("t")).items():
                turned, good = unit(x)
                fits = good & (pivot[at] >= 0)
                if fits.any():
                    own = shared.value[w][pivot[at[fits]]]
                    angle[at[fits]] = np.arccos(np.clip((turned[fits] * own).sum(axis=1), -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [pa.array((task << 32) + number), *[batch.column(c) for c in ("width", "pivot", "class", "t", "b")], pa.array(angle)],
                ["block", "width", "pivot", "class", "t", "b", "angle"])

    made = durable(ordered.sortWithinPartitions("width", "pivot", "ring", "class", "salt").mapInArrow(
        cut, "block long, width long, pivot long, class long, t array<double>, b double, angle double"))
    # a template without a number never scores; one without a direction keeps its block from being skipped
    short = F.count_if(F.isnan("angle") & whole)
    per_block = made.groupBy("block", "width", "pivot").agg(F.min(F.nanvl("angle", F.lit(math.pi))).alias("low"), F.max(F.nanvl("angle", F.lit(0.0))).alias("high"), short.alias("short"), F.count("*").alias("n")).toArrow().sort_by("block")
    every, cells = _cells(per_block, block_bytes)
    blocks = {}
    for w in np.unique(per_block.column("width").to_numpy()):
        one = per_block.filter(pc.equal(per_block.column("width"), int(w)))
        pivot = np.where(one.column("short").to_numpy() > 0, -1, one.column("pivot").to_numpy())
        blocks[int(w)] = (one.column("block").to_numpy(), pivot, one.column("low").to_numpy(), one.column("high").to_numpy())
    numbered = made.join(durable(spark.createDataFrame(pa.table({"block": every, "cell": cells}))), "block")
    several = lambda c: F.min(c) < F.max(c)
    spread = numbered.groupBy("class").agg(several("block").alias("split"), several("cell").alias("apart")).filter("split")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    table = durable(numbered.join(spread, "class", "left").select("cell", "block", "class", "t", "b", flag("split"), flag("apart")))
    most = table.select("cell", "class").distinct().groupBy("cell").count().agg(F.max("count")).first()[0]
    return Blocks(table, Bounds(pivots, blocks, every, cells), bool(spread.filter("apart").limit(1).count()), most or 0)


def _cells(per_block: pa.Table, block_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all blocks, their cells): runs of blocks of about equal bytes."""
    size = 8 * per_block.column("n").to_numpy() * np.maximum(per_block.column("width").to_numpy(), 1)
    room = max(block_bytes, min(CELL_BYTES, -(-int(size.sum()) // CELLS)))
    cells, cell, held = np.zeros(len(size), np.int64), 0, 0
    for i, own in enumerate(size.tolist()):
        if held and held + own > room:
            cell, held = cell + 1, 0
        cells[i], held = cell, held + own
    return per_block.column("block").to_numpy(), cells


def visits(rows: DataFrame, bounds: Bounds, need: str | None = None, home: bool | None = None, bounded: bool = True) -> DataFrame:
    """``rows`` once for each ``cell`` with blocks to visit; ``wanted`` has a bit for each block of the cell (null: all).

    Without ``need`` those are all blocks. With it, blocks of the row's width whose bound reaches the row's value of that
    column (null: none), and of them only the most promising one (``home`` true) or all but that (``home`` false). A metric
    that angles do not bound (``bounded`` false) visits them all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(bounds)
    out = T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("wanted", T.BinaryType())])

    def reached(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        known: Bounds = shared.value
        if need is None:
            every = np.unique(known.cells)
            for at in range(0, batch.num_rows, step := max(1, PAIRS // max(1, len(every)))):
                some = np.arange(at, min(batch.num_rows, at + step))
                yield np.repeat(some, len(every)), np.tile(every, len(some)), pa.nulls(len(some) * len(every), pa.binary())
            return
        floor = pc.fill_null(batch.column(need), np.inf).to_numpy(zero_copy_only=False)
        for width, (at, x) in by_width(batch.column("v")).items():
            if width not in known.blocks:
                continue
            cells = known.cell(known.blocks[width][0])
            begin = np.flatnonzero(np.diff(cells, prepend=-1))
            for start in range(0, len(at), step := max(1, PAIRS // len(cells))):
                own, some = at[start : start + step], x[start : start + step]
                number, high = known.highest(some)
                first = np.zeros(high.shape, bool)
                first[np.arange(len(own)), high.argmax(axis=1)] = True
                reach = (high >= floor[own][:, None]) if bounded else np.isfinite(high) & (floor[own] < np.inf)[:, None]
                reach = reach if home is None else reach & (first == home)
                visited = np.logical_or.reduceat(reach, begin, axis=1)
                found = []
                for k in np.flatnonzero(visited.any(axis=0)).tolist():
                    row, columns = np.flatnonzero(visited[:, k]), np.flatnonzero(cells == cells[begin[k]])
                    found.append((row, np.full(len(row), cells[begin[k]]), known.masks(cells[begin[k]], number[columns], reach[np.ix_(row, columns)])))
                if found:  # copies of a row side by side are written small
                    row, cell, bits = [np.concatenate([f[i] for f in found]) for i in (0, 1)] + [pa.concat_arrays([f[2] for f in found])]
                    order = np.argsort(row, kind="stable")
                    yield own[row[order]], cell[order], bits.take(pa.array(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, cell, bits in reached(batch):
                for a in range(0, len(row), 1 << 14):
                    part = batch.take(pa.array(row[a : a + (1 << 14)]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell[a : a + (1 << 14)]), bits.slice(a, 1 << 14)], [*part.schema.names, "cell", "wanted"])

    return rows.mapInArrow(run, out)


def wanted(part: pa.RecordBatch, blocks: int) -> np.ndarray:
    """Which of the ``blocks`` of a cell each row of ``part`` visits."""
    column = part.column("wanted")
    out = np.ones((part.num_rows, blocks), bool)
    given = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    if len(given):
        bits = np.frombuffer(b"".join(column.take(pa.array(given)).to_pylist()), np.uint8).reshape(len(given), -1)
        out[given] = np.unpackbits(bits, axis=1, count=blocks).astype(bool)
    return out


def product(met: DataFrame, blocks: Blocks, each: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, part_rows: int = PART_ROWS) -> DataFrame:
    """``each(probes, templates)`` of every cell and part of the probes that visit it."""
    met = durable(met)  # counted, then shuffled
    parts = met.groupBy("cell").count().select("cell", F.ceil(F.col("count") / part_rows).cast("long").alias("parts"))
    spread = met.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    copied = blocks.table.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return spread.groupBy("cell", "part").cogroup(copied.groupBy("cell", "part")).applyInArrow(each, schema)
