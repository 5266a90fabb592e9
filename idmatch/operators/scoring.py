"""Probe x gallery scoring.

Scores are block matrix products inside Arrow batches. A gallery whose size is counted and small goes to
every task. A larger one is cut into blocks that the probes meet by a shuffle (``gallery_blocks``): a search visits
only blocks whose angle bound can matter, everything else meets them all. Top-k, score ranges and histograms are
reduced inside the batch or cell, so the pairs themselves leave a task only when the caller asks for every score.

A score counts only if it is finite. A template is compared with the probes of its own width; a probe that has
no finite score keeps its row, without a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from idmatch.functions.vectors import NORM_FLOOR
from idmatch.operators import gallery_blocks
from idmatch.operators.matrices import by_width
from idmatch.session import durable

GALLERY_BYTES = 64 * 2**20
BLOCK_BYTES = 32 * 2**20
PAIRS_PER_STEP = 4_000_000
#: Below every cosine.
NO_FLOOR = -2.0

COSINE = "cosine"
LINEAR = "linear"


class Gallery:
    """Matrix form of one gallery block: for each width its templates, those of a class side by side."""

    def __init__(self, table: pa.Table | pa.RecordBatch, metric: str):
        classes, b = table.column("class").to_numpy(), table.column("b").to_numpy(zero_copy_only=False)
        self.classes, self.metric, self.n = np.unique(classes), metric, len(classes)
        self.widths = {}
        for width, (rows, t) in by_width(table.column("t")).items():
            order = np.argsort(classes[rows], kind="stable")
            own, first = np.unique(classes[rows][order], return_index=True)
            self.widths[width] = (np.searchsorted(self.classes, own), first, t[order], b[rows][order])

    def scores(self, probes: pa.Array) -> np.ndarray:
        """(probe, class) scores; the best finite score of a class's templates counts, -inf stands for none."""
        out = np.full((len(probes), len(self.classes)), -np.inf)
        for rows, at, s in self.products(by_width(probes)):
            out[np.ix_(rows, at)] = s
        return out

    def products(self, probes: dict[int, tuple[np.ndarray, np.ndarray]], asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, places of classes, scores) of each width of the probes, or of those ``asked``."""
        for width, (rows, x) in probes.items():
            if width not in self.widths:
                continue
            if asked is not None:
                rows, x = rows[asked[rows]], x[asked[rows]]
            if not len(rows):
                continue
            at, first, t, b = self.widths[width]
            with np.errstate(all="ignore"):
                s = x @ t.T
                if self.metric == COSINE:
                    norm = lambda m: np.sqrt(np.maximum((m**2).sum(axis=1), NORM_FLOOR))
                    scale = norm(x)[:, None] * norm(t)[None, :]
                    s = np.where(scale > NORM_FLOOR, s / np.maximum(scale, NORM_FLOOR), np.where(np.isnan(scale), np.nan, -1.0))
                else:
                    s = s + b[None, :]
            s = np.where(np.isfinite(s), s, -np.inf)
            if len(first) < len(t):
                s = np.maximum.reduceat(s, first, axis=1)
            yield rows, at, s


class Cell:
    """Matrix form of a cell: a gallery for each block, in the order of their numbers."""

    def __init__(self, table: pa.Table, metric: str):
        block = table.column("block").to_numpy()
        self.galleries = [Gallery(table.filter(pa.array(block == number)), metric) for number in np.unique(block)]
        self.classes, apart = np.unique(table.column("class").to_numpy()), table.column("apart").to_numpy(zero_copy_only=False)
        self.apart = np.isin(self.classes, table.column("class").to_numpy()[apart])
        #: Numbers that a row of scores needs at once.
        self.n = max([len(self.classes), *[g.n for g in self.galleries]])

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        """(probe, class) scores of each probe in the blocks it visits, as those of a gallery."""
        out, probes = np.full((part.num_rows, len(self.classes)), -np.inf), by_width(part.column("v"))
        asked = gallery_blocks.wanted(part, len(self.galleries))
        for k, gallery in enumerate(self.galleries):
            column = np.searchsorted(self.classes, gallery.classes)
            for rows, at, s in gallery.products(probes, asked[:, k]):
                where = np.ix_(rows, column[at])
                out[where] = np.maximum(out[where], s)
        return out


@dataclass(frozen=True)
class Classes:
    """The classes that the columns of a score matrix stand for."""

    classes: np.ndarray


@dataclass(frozen=True)
class Enrolled:
    """A gallery written once with its size known; pass it instead of a table to score it repeatedly."""

    table: DataFrame
    n: int
    values: int
    cut: dict[int, gallery_blocks.Blocks] = field(default_factory=dict, compare=False)

    @property
    def bytes(self) -> int:
        return self.values * 8

    def blocks(self, block_bytes: int) -> gallery_blocks.Blocks:
        """The gallery in blocks, cut when first asked for."""
        if block_bytes not in self.cut:
            self.cut[block_bytes] = gallery_blocks.build(self.table, self.values, block_bytes)
        return self.cut[block_bytes]


def enrol(gallery: DataFrame | Enrolled) -> Enrolled:
    if isinstance(gallery, Enrolled):
        return gallery
    b = F.col("b").cast("double") if "b" in gallery.columns else F.lit(0.0)
    table = durable(gallery.select(F.col("class").cast("long"), F.col("t").cast("array<double>"), b.alias("b")).filter("class IS NOT NULL AND t IS NOT NULL"))
    size = table.agg(F.count("*"), F.sum(F.size("t"))).first()
    return Enrolled(table, size[0], size[1] or 0)


Reduce = Callable[[pa.RecordBatch, np.ndarray, Gallery | Classes], pa.RecordBatch]


def _steps(batch: pa.RecordBatch, gallery: Gallery | Cell) -> Iterator[pa.RecordBatch]:
    rows = max(1, PAIRS_PER_STEP // max(1, gallery.n))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _score(
    probes: DataFrame, gallery: DataFrame | Enrolled, metric: str, schema: str, reduce: Reduce,
    gallery_bytes: int = GALLERY_BYTES, emits: bool = False,
) -> DataFrame:
    """Apply ``reduce`` to score matrices that hold every (probe, class) pair once. ``probes`` has columns (v, ...);
    ``emits`` says that a reduction returns all its pairs."""
    enrolled = enrol(gallery)
    probes = probes.withColumn("v", F.col("v").cast("array<double>"))
    if enrolled.bytes <= gallery_bytes:
        return _pass(probes, enrolled.table.toArrow(), metric, schema, reduce)
    rows = durable(probes if "row" in probes.columns else probes.withColumn("row", F.monotonically_increasing_id()))
    blocks = enrolled.blocks(min(BLOCK_BYTES, gallery_bytes))
    return _product(rows, gallery_blocks.visits(rows, blocks.bounds), blocks, metric, schema, reduce, emits=emits)


def _product(rows: DataFrame, met: DataFrame, blocks: gallery_blocks.Blocks, metric: str, schema: str, reduce: Reduce, whole: bool = True, emits: bool = False) -> DataFrame:
    """``reduce`` over the cells of ``met``, the rows with the blocks they visit.

    Scores of a class that lies in several cells are first put together per row and then reduced on their own;
    a reduction that may see such a class in parts (``whole`` false) takes them as they come.
    """
    kinds = T._parse_datatype_string(schema)
    out = T.StructType([*kinds.fields, *T._parse_datatype_string("__row long, __class long, __score double").fields])
    whole = whole and blocks.has_apart

    def each(probes: pa.Table, templates: pa.Table) -> pa.Table:
        if not templates.num_rows or not probes.num_rows:
            return pa.Table.from_batches([], to_arrow_schema(out))
        cell, found, parts = Cell(templates, metric), [], []
        split = cell.apart & whole
        for batch in probes.combine_chunks().to_batches():
            for part in _steps(batch, cell):
                s = cell.scores(part)
                found.append(reduce(part, s[:, ~split], Classes(cell.classes[~split])))
                row = np.repeat(part.column("row").to_numpy(), int(split.sum()))
                parts.append((row, np.tile(cell.classes[split], part.num_rows), s[:, split].reshape(-1)))
        reduced = pa.Table.from_batches(found)
        triples = pa.table({n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("__row", "__class", "__score"))})
        return pa.concat_tables([reduced, triples], promote_options="default").select(out.names).cast(to_arrow_schema(out))

    cells = gallery_blocks.product(met, blocks, each, out, max(64, PAIRS_PER_STEP // max(1, blocks.most)) if emits else gallery_blocks.PART_ROWS)
    if not whole:
        return cells.select(*kinds.names)
    cells = durable(cells)
    joined = cells.filter("__class IS NOT NULL").groupBy("__row", "__class").agg(F.max("__score").alias("__score"))
    again = rows.join(joined, F.col("row") == F.col("__row")).drop("__row").sortWithinPartitions("__class")

    def one_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column("__class").to_numpy()
            edge = np.flatnonzero(np.diff(classes, prepend=classes[:1] - 1, append=classes[-1:] + 1)) if len(classes) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                yield reduce(batch.slice(a, b - a), batch.column("__score").to_numpy()[a:b, None], Classes(classes[a : a + 1]))

    return cells.filter("__class IS NULL").select(*kinds.names).unionByName(again.mapInArrow(one_class, kinds))


def _pass(probes: DataFrame, block: pa.Table, metric: str, schema: str, reduce: Reduce) -> DataFrame:
    shared = probes.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gallery = Gallery(shared.value, metric)
        for batch in batches:
            for part in _steps(batch, gallery):
                yield reduce(part, gallery.scores(part.column("v")), gallery)

    return probes.mapInArrow(run, schema)


#: Stands for a missing claim inside a batch.
NO_CLAIM = -(2**63)


def _ids(part: pa.RecordBatch, name: str = "probe_id") -> np.ndarray:
    return pc.fill_null(part.column(name).cast(pa.int64()), NO_CLAIM).to_numpy(zero_copy_only=False)


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best classes of each row, ties by place; -inf where there is none."""
    order = np.argsort(-s, axis=1, kind="stable")[:, : min(k, s.shape[1])]
    found = np.take_along_axis(s, order, axis=1)
    short = k - order.shape[1]
    return np.pad(order, ((0, 0), (0, short))), np.pad(found, ((0, 0), (0, short)), constant_values=-np.inf)


def score_all(probes: DataFrame, gallery: DataFrame | Enrolled, metric: str = COSINE, **options) -> DataFrame:
    """Every finite score: (probe_id, class, score)."""

    def everything(part, s, block):
        row, at = np.nonzero(s > -np.inf)
        return pa.RecordBatch.from_arrays(
            [part.column("probe_id").cast(pa.int64()).take(pa.array(row)), pa.array(block.classes[at]), pa.array(s[row, at])],
            ["probe_id", "class", "score"],
        )

    return _score(probes.select("probe_id", "v"), gallery, metric,
                  "probe_id long, class long, score double", everything, emits=True, **options)


def labelled_scores(probes: DataFrame, gallery: DataFrame | Enrolled, metric: str = COSINE, **options) -> DataFrame:
    """Every finite score with its kind, (probe_id, class, score, genuine), of probes whose own class is enrolled."""
    gallery = enrol(gallery)

    def everything(part, s, block):
        row, at = np.nonzero(s > -np.inf)
        genuine = block.classes[at] == _ids(part, "label")[row]
        return pa.RecordBatch.from_arrays(
            [part.column("probe_id").cast(pa.int64()).take(pa.array(row)), pa.array(block.classes[at]), pa.array(s[row, at]), pa.array(genuine)],
            ["probe_id", "class", "score", "genuine"],
        )

    return _score(known_claims(probes, gallery), gallery, metric,
                  "probe_id long, class long, score double, genuine boolean", everything, emits=True, **options)


def _top(name: str, k: int) -> tuple[str, Reduce]:
    """Reduction to the k best classes of each row, under the row's column ``name``."""

    def best(part, s, block):
        at, found = _best(s, k)
        row, column = np.nonzero(found > -np.inf)
        return pa.RecordBatch.from_arrays(
            [part.column(name).cast(pa.int64()).take(pa.array(row)), pa.array(block.classes[at[row, column]]), pa.array(found[row, column])],
            [name, "class", "score"],
        )

    return f"{name} long, class long, score double", best


def search(rows: DataFrame, blocks: gallery_blocks.Blocks, k: int, metric: str = COSINE) -> DataFrame:
    """The k best classes of each row (row, v) of a gallery in blocks: (row, class, score, rank).

    The k-th best class of a row's most promising block is a floor for the rest of the search.
    """
    schema, best = _top("row", k)
    visit = lambda start, **how: _product(rows, gallery_blocks.visits(start, blocks.bounds, "need", **how), blocks, metric, schema, best, whole=False)
    ranked = lambda df: df.groupBy("row", "class").agg(F.max("score").alias("score")).withColumn(
        "rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "class"))).filter(F.col("rank") <= k)
    start = rows.withColumn("need", F.lit(NO_FLOOR))
    if metric != COSINE:
        return ranked(visit(start, bounded=False))
    home = durable(visit(start, home=True))
    floor = ranked(home).filter(F.col("rank") == k).select("row", F.col("score").alias("need"))
    rest = visit(rows.join(floor, "row", "left").withColumn("need", F.coalesce("need", F.lit(NO_FLOOR))), home=False)
    return ranked(home.unionByName(rest))


def score_topk(probes: DataFrame, gallery: DataFrame | Enrolled, k: int, metric: str = COSINE, gallery_bytes: int = GALLERY_BYTES) -> DataFrame:
    """The k best classes per probe: (probe_id, class, score, rank); ties go to the smaller class."""
    gallery = enrol(gallery)
    if gallery.bytes > gallery_bytes:
        rows = durable(probes.select("probe_id", F.col("v").cast("array<double>").alias("v")).withColumn("row", F.monotonically_increasing_id()))
        found = search(rows.select("row", "v"), gallery.blocks(min(BLOCK_BYTES, gallery_bytes)), k, metric)
        found = found.join(rows.select("row", "probe_id"), "row").select(F.col("probe_id").cast("long").alias("probe_id"), "class", "score")
    else:
        schema, best = _top("probe_id", k)
        found = _score(probes.select("probe_id", "v"), gallery, metric, schema, best)
    w = W.partitionBy("probe_id").orderBy(F.desc("score"), "class")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top2_margin(probes: DataFrame, gallery: DataFrame | Enrolled, metric: str = COSINE, **options) -> DataFrame:
    """Best and second class of every probe: (probe_id, pred, s1, class2, s2, margin)."""
    found = claimed_scores(probes.select("probe_id", "v", F.lit(None).cast("long").alias("label")), gallery, metric, **options)
    return found.select("probe_id", "pred", "s1", "class2", "s2", (F.col("s1") - F.col("s2")).alias("margin"))


def top2_of(scores: DataFrame) -> DataFrame:
    """Best and second class from a score table; an ordered partial aggregate, no sort of all scores."""
    if "rank" not in scores.columns:
        w = W.partitionBy("probe_id").orderBy(F.desc("score"), "class")
        scores = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 2)
    at = lambda column, r: F.max(F.when(F.col("rank") == r, F.col(column)))
    return (
        scores.groupBy("probe_id")
        .agg(at("class", 1).alias("pred"), at("score", 1).alias("s1"),
             at("class", 2).alias("class2"), at("score", 2).alias("s2"))
        .withColumn("margin", F.col("s1") - F.col("s2"))
    )


def claimed_scores(probes: DataFrame, gallery: DataFrame | Enrolled, metric: str = COSINE, **options) -> DataFrame:
    """Best classes of every row, plus the score and rank of the class it claims.

    ``probes`` carries the claim in column ``label``; a probe may come with several claims, a null claim is none.
    The rank counts better classes, so no score list is ordered. Without a finite score there is no best class;
    without a finite score of the claimed class ``own`` and ``better`` are null.
    Output: (probe_id, label, pred, s1, class2, s2, own, better).
    """
    gallery = enrol(gallery)
    rows = probes.select("probe_id", "label", "v").withColumn("row", F.monotonically_increasing_id())
    schema = "row long, probe_id long, label long, pred long, s1 double, class2 long, s2 double, own double, better long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def own_of(part, s, block):
        claim = _ids(part, "label")
        at = np.minimum(np.searchsorted(block.classes, claim), max(len(block.classes) - 1, 0))
        known = block.classes[at] == claim if len(block.classes) else np.zeros(len(claim), bool)
        own = np.where(known, s[np.arange(len(claim)), at], -np.inf) if len(block.classes) else np.full(len(claim), -np.inf)
        return claim, own

    def better_than(own, claim, s, block):
        smaller = block.classes[None, :] < claim[:, None]
        other = block.classes[None, :] != claim[:, None]
        return (((s > own[:, None]) | ((s == own[:, None]) & smaller)) & other).sum(axis=1)

    def reduce(part, s, block):
        claim, own = own_of(part, s, block)
        at, found = _best(s, 2)
        one = lambda k: [pa.array(block.classes[at[:, k]] if len(block.classes) else at[:, k], mask=found[:, k] == -np.inf),
                         pa.array(found[:, k], mask=found[:, k] == -np.inf)]
        return pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("probe_id").cast(pa.int64()), part.column("label").cast(pa.int64()), *one(0), *one(1),
             pa.array(own, mask=own == -np.inf), pa.array(better_than(own, claim, s, block), mask=own == -np.inf)], columns)

    limit = options.get("gallery_bytes", GALLERY_BYTES)
    if gallery.bytes <= limit:
        return _score(rows, gallery, metric, schema, reduce, **options).drop("row")
    rows, blocks = durable(rows.withColumn("v", F.col("v").cast("array<double>"))), gallery.blocks(min(BLOCK_BYTES, limit))
    at = lambda column, r: F.max(F.when(F.col("rank") == r, F.col(column)))
    top = search(rows.select("row", "v"), blocks, 2, metric).groupBy("row").agg(
        at("class", 1).alias("pred"), at("score", 1).alias("s1"), at("class", 2).alias("class2"), at("score", 2).alias("s2"))

    def own_score(part, s, block):
        own = own_of(part, s, block)[1]
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(own, mask=own == -np.inf)], ["row", "own"])

    def count(part, s, block):
        own = part.column("own").to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([part.column("row"), pa.array(better_than(own, _ids(part, "label"), s, block))], ["row", "better"])

    # a claim visits the blocks of its class alone; its rank then visits those that may hold a better one
    claimed = rows.join(blocks.of_classes().withColumnRenamed("class", "label"), "label").select("row", "label", "v", "cell", "wanted")
    own = _product(rows, claimed, blocks, metric, "row long, own double", own_score, whole=False).groupBy("row").agg(F.max("own").alias("own")).filter("own IS NOT NULL")
    asked = durable(rows.select("row", "label", "v").join(own, "row"))
    counted = _product(asked, gallery_blocks.visits(asked, blocks.bounds, "own", bounded=metric == COSINE), blocks, metric, "row long, better long", count)
    better = counted.groupBy("row").agg(F.sum("better").alias("better"))
    return (rows.join(top, "row", "left").join(asked.select("row", "own"), "row", "left").join(better, "row", "left")
            .select(F.col("probe_id").cast("long").alias("probe_id"), F.col("label").cast("long").alias("label"), "pred", "s1", "class2", "s2", "own", "better"))


def genuine_impostor(scores: DataFrame, probes: DataFrame) -> DataFrame:
    """Score table with ``genuine`` flags; probes whose own class has no score are left out."""
    flagged = scores.join(probes.select("probe_id", "label"), "probe_id").withColumn(
        "genuine", F.col("class") == F.col("label")
    )
    known = scores.select(F.col("class").alias("label")).distinct()
    return flagged.join(known, "label", "left_semi").select("probe_id", "class", "score", "genuine")


def known_claims(probes: DataFrame, gallery: DataFrame | Enrolled) -> DataFrame:
    """Probes whose own class is enrolled."""
    enrolled = enrol(gallery).table.select(F.col("class").alias("label")).distinct()
    return probes.select("probe_id", "label", "v").join(enrolled, "label", "left_semi")


def score_range(probes: DataFrame, gallery: DataFrame | Enrolled, metric: str = COSINE, **options) -> DataFrame:
    """Lowest and highest finite score over all pairs, and how many pairs have none: (lo, hi, non_finite)."""

    gallery = enrol(gallery)

    def reduce(part, s, block):
        real = s[s > -np.inf]
        ends = [[real.min()], [real.max()]] if len(real) else [[None], [None]]
        return pa.RecordBatch.from_arrays([pa.array(e, pa.float64()) for e in ends] + [pa.array([s.size - len(real)])], ["lo", "hi", "bad"])

    parts = _score(known_claims(probes, gallery), gallery, metric, "lo double, hi double, bad long", reduce,
                   **options)
    return parts.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.sum("bad"), F.lit(0)).alias("non_finite"))


def score_histogram(
    probes: DataFrame, gallery: DataFrame | Enrolled, lo: float, hi: float, n: int, metric: str = COSINE,
    digits: int | None = None, **options,
) -> DataFrame:
    """Genuine and impostor counts per threshold step, (step, genuine, impostor), without emitting pairs.

    Step i holds finite scores between threshold i and i+1 of ``lo + (hi - lo) * i / n``.
    """

    gallery = enrol(gallery)

    def reduce(part, s, block):
        claim = _ids(part, "label")
        if digits is not None:
            s = np.round(s, digits)
        edges = lo + (hi - lo) * np.arange(n + 1) / n
        step = np.clip(np.searchsorted(edges, s, side="right") - 1, 0, n)
        own, real = block.classes[None, :] == claim[:, None], s > -np.inf
        genuine = np.bincount(step[own & real], minlength=n + 1)
        impostor = np.bincount(step[~own & real], minlength=n + 1)
        used = np.flatnonzero(genuine + impostor)
        return pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(genuine[used]), pa.array(impostor[used])], ["step", "genuine", "impostor"]
        )

    parts = _score(known_claims(probes, gallery), gallery, metric,
                   "step long, genuine long, impostor long", reduce, **options)
    return parts.groupBy("step").agg(F.sum("genuine").alias("genuine"), F.sum("impostor").alias("impostor"))


def topk_accuracy(claimed: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Percent of probes whose true class is within the best k: (k, accuracy)."""
    totals = claimed.agg(*[F.avg((F.coalesce(F.col("better"), F.lit(2**31)) < k).cast("double")).alias(str(k)) for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), (F.col(f"`{k}`") * 100.0).alias("accuracy")) for k in ks])
    return totals.select(F.inline(pairs))


def duplicate_identity(
    batches: DataFrame, gallery: DataFrame | Enrolled, batch: str = "batch_id", first_n: int = 25,
    margin: float = 0.489, consistency: float = 0.70, confident: float = 0.50, **options,
) -> DataFrame:
    """Vote of a new identity's first vectors for an enrolled class.

    One row per batch: (batch, m, confident_votes, top_class, top_votes, duplicate).
    """
    first = (
        batches.withColumn("__r", F.row_number().over(W.partitionBy(batch).orderBy("probe_id")))
        .filter(F.col("__r") <= first_n).drop("__r")
    )
    votes = first.select("probe_id", batch).join(top2_margin(first, gallery, **options), "probe_id", "left")
    votes = votes.withColumn("pred", F.coalesce("pred", F.lit(-1)))
    sure = F.coalesce(F.col("margin"), F.lit(0.0)) >= margin  # scores are finite, so is a margin
    per_class = votes.groupBy(batch, "pred").agg(F.count("*").alias("m"), F.count_if(sure).alias("votes"))
    best = F.max_by(F.struct("pred", "votes"), F.struct(F.col("votes"), -F.col("pred")))
    summed = per_class.groupBy(batch).agg(
        F.sum("m").alias("m"), F.sum("votes").alias("confident_votes"), best.alias("b")
    )
    top_votes = F.col("b.votes")
    duplicate = (
        (top_votes > 0) & (top_votes >= F.ceil(F.col("m") * consistency))
        & (F.col("confident_votes") >= F.ceil(F.col("m") * confident))
    )
    top = F.when(top_votes > 0, F.col("b.pred")).otherwise(F.lit(-1))
    return summed.select(
        batch, "m", "confident_votes", top.alias("top_class"), top_votes.alias("top_votes"),
        duplicate.alias("duplicate"),
    )
