"""Rows of documents with a key of their own, and which of them stand for their exact copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idmatch.llm.words import typed

LAST = (1 << 63) - 1


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, carry..., id, uid): text without null; ``id`` orders documents, null last; ``uid`` is one number
    for the id and text of a row, so rows that agree in both share it."""
    rows = typed(docs, doc_id="long", text="string", **{c: "string" for c in carry}).withColumn("text", F.coalesce("text", F.lit("")))
    ided = rows.withColumn("id", F.coalesce("doc_id", F.lit(LAST)))
    return ided.withColumn("uid", F.xxhash64("id", "text"))


def first_copies(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """(uid, copies): of the rows with one text, the uid of the row with the least id, and how many rows there are.

    One digest for each row is shuffled, combined before; the text is not.
    """
    digest = F.unhex(F.md5((F.col("text") if text is None else text).cast("binary")))
    found = rows.select("id", "uid", digest.alias("digest")).groupBy("digest").agg(F.min(F.struct("id", "uid")).alias("least"), F.count("*").alias("copies"))
    return found.select(F.col("least.uid").alias("uid"), "copies")
