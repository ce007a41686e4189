"""Chat formatting: paths of reply trees, and a template that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

OPEN, ROLE_END, CLOSE = "### ", ": ", "</turn>\n"
#: Characters of the template and their stand-ins. A backslash is always the start of a stand-in, so the stand-ins of
#: the others are replaced first and that of the backslash last when a text is read back.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, stand_in in ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(stand_in))
    return out


def unescape(text: Column) -> Column:
    for raw, stand_in in reversed(ESCAPES):
        text = F.replace(text, F.lit(stand_in), F.lit(raw))
    return text


def reply_paths(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent",
                score: str = "score", best: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees, a row for each message of each path: ``tree``, ``leaf``, ``rank`` (of the
    path within its tree, 1 for the highest mean score, ties to the smaller leaf), ``depth`` (0 for the root), ``node``.

    Self-joins double the step to an ancestor each round: after the round for 2^k every leaf has met all ancestors
    within 2^(k+1) - 1 steps, each once, so a path of n messages needs log2(n) rounds. ``best`` keeps so many paths of
    a tree (a top-k report; None: all). A message whose parent is null or missing is a root; null scores count as 0;
    a (tree, node) pair must be unique; messages on a cycle have no root and are in no path. Messages without a tree
    are one tree, whose id stays null.
    """
    # a struct of a null is no null: it meets its like in every join
    m = written(messages.select(F.struct(F.col(tree).alias("id")).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"),
                                F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score")), "messages")
    known = m.select("tree", F.col("node").alias("up"))
    step = m.select("tree", "node", F.col("parent").alias("up")).join(known, ["tree", "up"]).select("tree", "node", "up")
    step = written(step, "steps")
    roots = m.select("tree", "node").join(step, ["tree", "node"], "left_anti")
    met = m.select("tree", F.col("node").alias("leaf")).join(
        step.select("tree", F.col("up").alias("leaf")), ["tree", "leaf"], "left_anti").select(
        "tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    size, all_messages = 1, m.count()
    while size <= all_messages and not step.isEmpty():
        more = met.join(step, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"),
                                                       (F.col("above") + size).alias("above"))
        met = written(met.unionByName(more), "paths")
        onward = step.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
        step = written(step.join(onward, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "steps")
        size *= 2
    met = met.join(m.select("tree", "node", "score"), ["tree", "node"])
    whole = met.join(roots.select("tree", "node", F.lit(True).alias("root")), ["tree", "node"], "left")
    paths = whole.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max("above").alias("length"), F.max("root").alias("root"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.asc_nulls_first("leaf"))
    paths = paths.where("root").withColumn("rank", F.row_number().over(order))
    if best is not None:
        paths = paths.where(F.col("rank") <= best)
    return met.join(paths.select("tree", "leaf", "rank", "length"), ["tree", "leaf"]).select(
        F.col("tree.id").alias("tree"), "leaf", "rank", (F.col("length") - F.col("above")).alias("depth"), "node")


def format_turns(turns: DataFrame, keys: list[str], order: list[str], role: str = "role", text: str = "text") -> DataFrame:
    """One conversation for each value of ``keys``: ``formatted`` and ``mask``, the loss mask as (start, length) spans
    of code points, start from 0, over the escaped texts of assistants.

    Turns stand in ``order``; a null text or role is empty, an empty text keeps its turn.
    """
    turn = F.concat(F.lit(OPEN), escape(F.col(role)), F.lit(ROLE_END))
    rows = turns.select(*keys, F.struct(*order, turn.alias("_head"), escape(F.col(text)).alias("_body"),
                                        F.coalesce(F.col(role) == "assistant", F.lit(False)).alias("_loss")).alias("t"))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def place(acc, t):
        start = acc["at"] + F.char_length(t["_head"])
        length = F.char_length(t["_body"])
        span = F.struct(start.alias("start"), length.alias("length"))
        return F.struct((start + length + len(CLOSE)).alias("at"),
                        F.when(t["_loss"], F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    return out.select(
        *keys, F.array_join(F.transform("ts", lambda t: F.concat(t["_head"], t["_body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("ts", begin, place, lambda acc: acc["mask"]).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    parts = F.split(formatted, CLOSE, -1)

    def turn(part):
        body = F.substring(part, len(OPEN) + 1, 1 << 30)
        at = F.locate(ROLE_END, body)
        role = F.substring(body, F.lit(1), at - 1)
        text = F.substring(body, at + len(ROLE_END), F.lit(1 << 30))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask, one after the other."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_trees(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", score: str = "score",
                 role: str = "role", text: str = "text", best: int | None = None) -> DataFrame:
    """Each chosen path of each tree as one conversation: ``tree``, ``leaf``, ``rank``, ``formatted``, ``mask``. See
    ``reply_paths`` and ``format_turns``."""
    paths = reply_paths(messages, tree, node, parent, score, best)
    said = messages.select(F.col(tree).alias("_tree"), F.col(node).alias("_node"), F.col(role).alias("role"), F.col(text).alias("text"))
    met = paths.join(said, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("node") == F.col("_node")))
    return format_turns(met, ["tree", "leaf", "rank"], ["depth"])


def threads(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations by turn as reply trees without branches: each turn answers the one before. Turns with one number
    stand by role and text; null numbers come first; turns without a conversation make one, whose id stays null."""
    order = Window.partitionBy(conv).orderBy(F.asc_nulls_first(turn), F.asc_nulls_first(role), F.asc_nulls_first(text))
    return turns.select(F.col(conv).alias("tree"), F.row_number().over(order).alias("node"), F.col(role).alias("role"),
                        F.col(text).alias("text")).withColumn("parent", F.col("node") - 1).withColumn("score", F.lit(0.0))
