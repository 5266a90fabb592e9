"""Chat formatting: reply trees to conversations, in a template that can be read back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idmatch.llm.words import typed
from idmatch.session import durable

#: A turn is ``### role: text </turn>\\n``. Inside roles and texts a backslash goes before each of these characters, so a
#: marker never appears in them.
SPECIAL = r"\\#<:"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.S)
LOSS_ROLE = "assistant"


def tree_key() -> Column:
    """The conversation id as a key that joins with itself when null."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"([{SPECIAL}])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def as_tree(turns: DataFrame) -> DataFrame:
    """Messages of flat conversations: each row replies to the row before it by turn (ties: role, then text).

    Null turns come first; a null conversation id is a conversation of its own; null roles and texts are empty.
    """
    rows = typed(turns, conv_id="long", turn="long", role="string", text="string").withColumns(
        {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return placed.select("conv_id", "msg_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf_id, back, msg_id, score): every message of each root-to-leaf path, ``back`` steps before its leaf.

    Self-joins double the distance each time, so a chain of n messages takes log2(n) rounds, and a round only handles
    messages that still have an ancestor that far away. Work is the total length of the paths. A message whose parent
    does not exist is a root. Messages on a cycle have no root and no leaf on it and appear in no path; a branch hanging
    from a cycle is cut where it would pass the cycle a second time, that is it is left out.
    """
    nodes = durable(messages.select(tree_key(), "conv_id", "msg_id", "parent_id", "score").dropDuplicates(["tree", "msg_id"]))
    here = nodes.select("tree", F.col("msg_id").alias("up"))
    jump = durable(nodes.select("tree", "msg_id", F.col("parent_id").alias("up")).join(here, ["tree", "up"]).select("tree", "msg_id", "up"))
    inner = jump.select("tree", F.col("up").alias("msg_id"))
    found = durable(nodes.join(inner, ["tree", "msg_id"], "left_anti").select("tree", F.col("msg_id").alias("leaf_id"), F.lit(0).cast("long").alias("back"), "msg_id"))
    steps, total = 1, nodes.count()
    while steps < total and not jump.isEmpty():
        more = found.join(jump, ["tree", "msg_id"]).select("tree", "leaf_id", (F.col("back") + steps).alias("back"), F.col("up").alias("msg_id"))
        found = durable(found.unionByName(more))
        far = jump.select("tree", F.col("msg_id").alias("up"), F.col("up").alias("further"))
        jump = durable(jump.join(far, ["tree", "up"]).select("tree", "msg_id", F.col("further").alias("up")))
        steps *= 2
    # what still has ancestors after as many steps as there are messages goes round a cycle
    looped = found.join(jump, ["tree", "msg_id"], "left_semi").select("tree", "leaf_id").distinct()
    return found.join(looped, ["tree", "leaf_id"], "left_anti").join(nodes, ["tree", "msg_id"]).select("tree", "conv_id", "leaf_id", "back", "msg_id", "score")


def ranked_branches(path_rows: DataFrame) -> DataFrame:
    """(tree, leaf_id, path_score, rank): the paths of each tree by the sum of their messages' scores, null as 0; ties by
    the lower leaf. The window keeps ``rank <= n`` small before its shuffle."""
    scored = path_rows.groupBy("tree", "leaf_id").agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))), 9).alias("path_score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf_id")))


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv_id, leaf_id, rank, score, formatted): the best ``branches`` root-to-leaf paths of each tree as text.

    ``messages`` has conv_id, msg_id, parent_id, role, text, score; (conv_id, msg_id) is the key. A path is one output
    row, so it must fit into memory, as any conversation must. An empty table gives no rows.
    """
    rows = durable(paths(messages))
    chosen = ranked_branches(rows).filter(F.col("rank") <= branches)
    said = messages.dropDuplicates(["conv_id", "msg_id"]).select(tree_key(), "msg_id", F.concat(
        F.lit("### "), escaped(F.coalesce("role", F.lit(""))), F.lit(": "), escaped(F.coalesce("text", F.lit(""))), F.lit(" </turn>\n")).alias("part"))
    parts = rows.join(chosen, ["tree", "leaf_id"]).join(said, ["tree", "msg_id"])
    joined = parts.groupBy("tree", "leaf_id", "rank").agg(
        F.max("conv_id").alias("conv_id"), F.max("path_score").alias("score"), F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "part"))).alias("turns"))
    return joined.select("conv_id", "leaf_id", "rank", "score", F.array_join("turns.part", "").alias("formatted"))


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; [start, end) is the escaped text in the output."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return turns


def loss_mask(formatted: str, role: str = LOSS_ROLE) -> list[tuple[int, int]]:
    """The spans of the output that count for the loss: the texts of ``role``."""
    return [(start, end) for who, _, start, end in read_back(formatted) if who == role]
