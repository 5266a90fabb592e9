"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idmatch.llm.copies import keyed
from idmatch.session import durable

#: Words in a block.
BLOCK = 16
#: Words that a shard of a source has in the mean, and the most shards of a source.
SHARD_WORDS, MAX_SHARDS = 8192, 4096
#: No document is taken more often.
MOST = 3
#: A prime above every block count of a shard: multiples of it run through all blocks.
STRIDE = 2654435761


def digest(*parts: Column) -> Column:
    """A number below 2^32 from the text of its parts, the same on every cluster."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target): shares of all words by weight, none above ``most`` times its source.

    Sources in code point order, null last, get the weights in turn. What a full source cannot take is shared among the
    others by weight until none is above its limit: with sources in the order of limit / weight, the full ones are a
    prefix. The windows hold one row for each source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = sources.withColumn("weight", weight).withColumns({"level": level, "place": F.row_number().over(order)})
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    settled = F.min(F.when(fits, F.struct("place", "level"))).over(Window.partitionBy())
    return placed.withColumn("settled", settled).withColumn("settled", F.col("settled.level")).select(
        "source", "source_size", "weight",
        F.least(F.coalesce(F.col("settled") * F.col("weight"), most * F.col("source_size")), most * F.col("source_size").cast("double")).alias("target"))


def apportion(parties: DataFrame, within: list[str], name: list[Column], claim: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds ``quota``, the seats of each party by the highest quotients claim / (2 k + 1).

    ``seats`` is the number to give in each group ``within``. With n parties and N seats, a party's seats lie within a
    factor 1 -+ n / 2N of its proportional share, rounded; only the quotients of seats in that range, about 4 n of them,
    are ranked. Ties go by ``name``. Parties without a claim get nothing.
    """
    group = Window.partitionBy(*within)
    total, n = F.sum(claim).over(group), F.count("*").over(group)
    share = F.when(F.col("all") > 0, F.col(seats) * F.col(claim) / F.col("all")).otherwise(F.lit(0.0))
    slack = F.when(F.col(seats) > 0, F.col("n") / (2 * F.col(seats))).otherwise(F.lit(0.0))
    ranged = parties.withColumns({"all": total, "n": n}).withColumns({
        "low": F.greatest(F.lit(0), F.floor(share * (1 - slack)) - 1).cast("long"),
        "high": F.when(share > 0, F.ceil(share * (1 + slack)) + 1).otherwise(F.lit(0)).cast("long")})
    kept = [c for c in ranged.columns if c not in ("all", "n")]
    given = ranged.withColumn("left", F.col(seats) - F.sum("low").over(group))
    quotients = given.filter("high > low").select(*kept, "left", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("k"))
    best = group.orderBy(F.desc(F.col(claim) / (2 * F.col("k") + 1)), *name)
    won = quotients.withColumn("place", F.row_number().over(best)).groupBy(*within, *[c for c in kept if c not in within]).agg(
        F.sum((F.col("place") <= F.col("left")).cast("long")).alias("won"))
    return won.withColumn("quota", F.col("low") + F.col("won")).drop("low", "high", "won")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), seed: int = 42, block: int = BLOCK,
                shard_words: int = SHARD_WORDS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """(doc_id, uid, source, size, source_size, target, taken): how many words the mix takes of each document.

    A source is cut into shards by a seeded digest of the document id, so a source of any size is spread. Blocks of equal
    word counts go to sources, then to the shards of a source, by highest quotients. In a shard, whose documents follow
    each other in seeded order, a quota of q blocks takes all words as often as they fit and then single blocks, chosen
    by a seeded stride through the blocks. Documents without words (empty or null texts) take none. A document is taken
    at most ``MOST`` times over. Repeated rows each get a row; an empty table gives no rows.
    """
    rows = keyed(docs, carry=("source",))
    sizes = durable(rows.select("doc_id", "uid", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")))
    targets = durable(source_targets(sizes, weights).withColumn("shards", F.least(
        F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("int")))
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    quotas = apportion(targets.withColumn("seats", seats), [], [F.col("source").asc_nulls_last()], "target", "seats").select(
        F.col("source").alias("s"), "source_size", "target", "shards", F.col("quota").alias("source_quota"))
    # a source that gets no block still has a row, as the documents of it need one
    known = targets.select(F.col("source").alias("s"), "source_size", "target", "shards")
    quotas = durable(known.join(quotas.select(F.col("s").alias("q"), "source_quota"), F.col("s").eqNullSafe(F.col("q")), "left").select(
        "s", "source_size", "target", "shards", F.coalesce("source_quota", F.lit(0)).cast("long").alias("source_quota")))
    tied = sizes.join(quotas, sizes.source.eqNullSafe(quotas.s))
    placed = tied.select("doc_id", "uid", "source", "size", "source_size", "target", "source_quota",
                         (digest(F.lit(seed), F.col("doc_id")) % F.col("shards")).cast("int").alias("shard"))
    by_shard = placed.filter("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.max("source_quota").alias("source_quota"))
    shard_quota = apportion(by_shard, ["source"], [F.col("shard")], "shard_size", "source_quota").select(
        F.col("source").alias("s2"), F.col("shard").alias("h2"), "shard_size", "quota")
    order = Window.partitionBy("source", "shard").orderBy(digest(F.lit(seed + 1), F.col("doc_id")), "doc_id", "uid")
    ordered = placed.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = ordered.join(shard_quota, ordered.source.eqNullSafe(shard_quota.s2) & (ordered.shard == shard_quota.h2), "left")
    wanted, m = F.coalesce("quota", F.lit(0)) * block, F.ceil(F.col("shard_size") / block)
    passes = F.least(F.floor(wanted / F.col("shard_size")), F.lit(MOST))
    extra = F.when(passes < MOST, F.floor((wanted - passes * F.col("shard_size")) / block + F.lit(0.5))).otherwise(F.lit(0))
    start = digest(F.lit(seed + 2), F.col("source"), F.col("shard")) % F.col("m")
    counted = joined.withColumns({"m": m.cast("long"), "passes": passes.cast("long"), "extra": extra.cast("long")}).withColumn("start", start)
    chosen = lambda j: (((j * STRIDE) + F.col("start")) % F.col("m")) < F.col("extra")
    overlap = lambda j: F.least(F.col("upto"), (j + 1) * block) - F.greatest(F.col("upto") - F.col("size"), j * block)
    single = F.aggregate(
        F.sequence(F.floor((F.col("upto") - F.col("size")) / block), F.floor((F.col("upto") - 1) / block)), F.lit(0).cast("long"),
        lambda acc, j: acc + F.when(chosen(j), overlap(j)).otherwise(F.lit(0)))
    taken = F.when((F.col("size") > 0) & F.col("m").isNotNull(), F.col("passes") * F.col("size") + F.when(F.col("extra") > 0, single).otherwise(F.lit(0))).otherwise(F.lit(0))
    return counted.select("doc_id", "uid", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
