"""Quality rules whose limits follow each language and source."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idmatch.llm.stats import NAMES, counts
from idmatch.llm.words import schema, slices, typed
from idmatch.session import durable

#: Relative width of a sketch bin: a quantile is off by about 1 % of its value.
GAMMA = 1.02
#: Values up to this share one bin.
LEAST = 1e-4
#: A group with fewer rows takes the sketch of its language, and that of all rows below as many again.
MIN_ROWS = 200
#: Fences stand this many inter-quartile ranges outside the quartiles, and at least ``SLACK`` away from them.
REACH = 4.0
SLACK = {"symbol_share": 0.04, "dup_line_share": 0.5, "repeat_share": 0.25, "stuck_share": 0.15, "upper_share": 0.15,
         "bang_share": 0.06, "word_length": 2.0}
#: Measures with a lower fence as well.
TWO_SIDED = ("word_length",)
MEASURES = tuple(SLACK)


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts of ``stats.counts``) of every whole text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                found = counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), part.column("source")] + [pa.array(found[n], pa.int64()) for n in NAMES],
                    ["doc_id", "lang", "source", *NAMES])

    out = schema(doc_id="long", lang="string", source="string", **{n: "long" for n in NAMES})
    return typed(docs, doc_id="long", lang="string", source="string", text="string").mapInArrow(run, out)


def measures(stats: DataFrame) -> DataFrame:
    """The stats with the measures that rules look at; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return stats.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"), "stuck_share": share("n_stuck", "n_words"), "upper_share": share("n_upper", "word_chars"),
        "bang_share": share("n_bangs", "word_chars"), "word_length": share("word_chars", "n_words"),
    })


def sketch(rows: DataFrame, keys: list[str], names: tuple[str, ...] = MEASURES) -> DataFrame:
    """Mergeable quantile sketches: (keys, measure, bin, n). Bins grow by ``GAMMA``, so sketches merge by adding counts."""
    stacked = rows.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("measure"), _bin(F.col(n)).alias("bin")) for n in names])).alias("s"))
    return stacked.groupBy(*keys, "s.measure", "s.bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def _bin(x: Column) -> Column:
    return F.when(x <= LEAST, F.lit(0)).otherwise(F.ceil(F.log(x / LEAST) / F.log(F.lit(GAMMA)))).cast("int")


def _value(b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GAMMA), b) * 2 / (1 + GAMMA))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, rows, q1, q3) of each sketch. A window holds the bins of one sketch, some hundreds at most."""
    w = Window.partitionBy(*keys, "measure")
    run = sketches.withColumns({"upto": F.sum("n").over(w.orderBy("bin")), "rows": F.sum("n").over(w)})
    at = lambda q: _value(F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bin"))))
    return run.groupBy(*keys, "measure").agg(F.max("rows").alias("rows"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def limits(sketches: DataFrame, min_rows: int = MIN_ROWS, reach: float = REACH) -> DataFrame:
    """(lang, source, low_*, high_*): the fences of every group, from its own sketch or the next coarser one that is full enough."""
    own = quartiles(sketches, ["lang", "source"])
    by_lang = quartiles(merge(sketches, ["lang"]), ["lang"]).select(F.col("lang").alias("l2"), F.col("measure").alias("m2"), F.struct("rows", "q1", "q3").alias("lang_q"))
    everywhere = quartiles(merge(sketches, []), []).select(F.col("measure").alias("m3"), F.struct("rows", "q1", "q3").alias("all_q"))
    joined = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("measure") == F.col("m2"))).join(everywhere, F.col("measure") == F.col("m3"))
    pick = lambda q: F.when(F.col("rows") >= min_rows, F.col(q)).when(F.col("lang_q.rows") >= min_rows, F.col(f"lang_q.{q}")).otherwise(F.col(f"all_q.{q}"))
    slack = reduce(lambda c, n: c.when(F.col("measure") == n, F.lit(SLACK[n])), MEASURES[1:], F.when(F.col("measure") == MEASURES[0], F.lit(SLACK[MEASURES[0]])))
    room = F.greatest(reach * (F.col("hi") - F.col("lo")), slack)
    fenced = joined.select("lang", "source", "measure", pick("q1").alias("lo"), pick("q3").alias("hi"))
    one = lambda n, c: F.max(F.when(F.col("measure") == n, c))
    return fenced.groupBy("lang", "source").agg(
        *[one(n, F.col("hi") + room).alias(f"high_{n}") for n in MEASURES], *[one(n, F.col("lo") - room).alias(f"low_{n}") for n in TWO_SIDED])


def quality_rules(docs: DataFrame, min_rows: int = MIN_ROWS, reach: float = REACH) -> DataFrame:
    """One row per document: counts, measures, ``base_failed``, the fences of its group and ``kept``.

    The fixed base rules come first. A document that passes them is kept if every measure lies within the fences of its
    (lang, source), which come from quantile sketches of all documents. Null languages and sources are groups of their
    own; an empty or null text fails the base; repeated rows each get a row; an empty table gives no rows.
    """
    stats = durable(measures(text_stats(docs)))
    fences = limits(sketch(stats, ["lang", "source"]), min_rows, reach).withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    inside = reduce(lambda a, b: a & b, [F.col(n) <= F.col(f"high_{n}") for n in MEASURES] + [F.col(n) >= F.col(f"low_{n}") for n in TWO_SIDED])
    joined = stats.join(fences, stats.lang.eqNullSafe(fences.f_lang) & stats.source.eqNullSafe(fences.f_source)).drop("f_lang", "f_source")
    return joined.withColumn("base_failed", base).withColumn("kept", ~base & inside)
