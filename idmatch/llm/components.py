"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from idmatch.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches.

    Rounds of large-star and small-star: each node's neighbours are tied to the least of them, which halves the depth of
    a component about every round. A node with very many links is only ever grouped by a minimum, combined before the
    shuffle, and joined back, which Spark may split. Each round is a written table; a lost executor repeats one round.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        edges = _star(edges, small=False)
        edges = durable(_star(edges, small=True))
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Small star: the smaller neighbours of u, and u, are tied to the least of them. Large star: the larger ones."""
    if small:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return tied.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
