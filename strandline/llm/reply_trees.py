"""Conversations from reply trees, with DataFrame operations only.

Messages point to the message they answer. Paths from root to leaf are enumerated by iterative self-joins
that double their reach: a table of jumps (node to its ancestor 1, 2, 4, ... steps up) is joined with itself, and the paths found so
far with the jumps, so a path of n messages takes log2(n) rounds. A leaf's path is a branch; branches of a tree are ranked by
the sum of their messages' scores, and each chosen one becomes one text.

A turn is written ``### role: text</turn>`` and a line feed. Inside roles and texts the backslash becomes \\0, ``#`` \\1 and ``<`` \\2 (in
roles the colon too, \\3), so that no control string can stand in them, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare

OPEN, END = "### ", "</turn>\n"
#: What is written for each character, the backslash first.
ESCAPES = (("\\", "\\0"), ("#", "\\1"), ("<", "\\2"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\3"))
MAX_ROUNDS = 40


def escape(c: Column, table=ESCAPES) -> Column:
    for plain, written in table:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column, table=ESCAPES) -> Column:
    for plain, written in reversed(table):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the messages on the path of every leaf; up is the number of steps from the leaf. ``nodes`` has tree, node
    and parent (null at a root); a parent that is no node makes a root too. Raises RuntimeError on a cycle."""
    own = nodes.select("node").withColumnRenamed("node", "known")
    links = nodes.where("parent is not null").join(own, F.col("parent") == F.col("known"), "left_semi")
    jumps = cut(links.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    leaves = nodes.join(jumps.select(F.col("b").alias("x")).distinct(), F.col("node") == F.col("x"), "left_anti")
    found = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    reach = 1
    for _ in range(MAX_ROUNDS):
        if jumps.isEmpty():
            return found
        further = found.join(jumps, F.col("node") == F.col("a")).select("tree", "leaf", F.col("b").alias("node"), (F.col("up") + reach).alias("up"))
        found = cut(found.union(further))
        second = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps = cut(jumps.join(second, "b").select("a", F.col("c").alias("b")))
        reach *= 2
    raise RuntimeError("the replies run in a circle")


def format_trees(nodes: DataFrame, best: int | None = None) -> DataFrame:
    """One row per chosen branch: tree, leaf, branch_rank, branch_score, n_turns, formatted, and loss: the mask as an array of (start,
    length) in code points, one for each assistant text. ``nodes`` has tree, node, parent, role, text, score; node is unique. ``best``: how many
    branches of each tree (all, if None); ties go to the smaller leaf. Null roles and texts are empty, null scores 0; a tree id may be
    null; an empty table gives no rows."""
    prepare(nodes.sparkSession)
    nodes = cut(nodes.select("tree", "node", "parent", "role", "text", "score"))
    on_path = paths(nodes)
    text = nodes.select("node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0)).cast("double").alias("score"))
    turns = on_path.join(text, "node")
    rank = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    branches = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"), F.count(F.lit(1)).alias("n_turns")).withColumn("branch_rank", F.row_number().over(rank))
    if best is not None:
        branches = branches.where(F.col("branch_rank") <= best)
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(": "))
    body = escape(F.col("text"))
    turns = turns.select("leaf", "up", "role", head.alias("head"), body.alias("body"))
    before = Window.partitionBy("leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.char_length("head") + F.char_length("body") + len(END)
    turns = turns.withColumn("start", F.sum(size.cast("long")).over(before) - F.char_length("body") - len(END))
    mask = F.when(F.col("role") == "assistant", F.struct("start", F.char_length("body").cast("long").alias("length")))
    one = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(END)).alias("turn"), mask.alias("mask"))
    whole = turns.groupBy("leaf").agg(F.sort_array(F.collect_list(one)).alias("all"))
    formatted = whole.select("leaf", F.array_join(F.col("all.turn"), "").alias("formatted"), F.filter(F.col("all.mask"), lambda m: m.isNotNull()).alias("loss"))
    return branches.join(formatted, "leaf").select("tree", "leaf", "branch_rank", "branch_score", "n_turns", "formatted", "loss")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    parts = F.filter(F.split(formatted, END), lambda t: t != "")
    cut_ = F.length(F.lit(OPEN))
    return F.transform(
        parts,
        lambda t: F.struct(
            unescape(F.substring_index(F.substr(t, cut_ + 1), ": ", 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(t, cut_ + 1 + F.char_length(F.substring_index(F.substr(t, cut_ + 1), ": ", 1)) + 2)).alias("text"),
        ),
    )


def chains(conversations: DataFrame) -> DataFrame:
    """Reply trees of ``conversations`` (conv_id, turn, role, text), where each row answers the one before it. Rows with the same turn follow each
    other by role and text, null turns come first. The score is the length of an assistant's text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(order))
    # a null conversation is told apart by the flag, as null keys never join
    key = lambda n: F.struct(F.col("conv_id").isNull().alias("no_id"), F.coalesce("conv_id", F.lit(0)).alias("conv"), n.alias("n"))
    return rows.select(
        F.col("conv_id").alias("tree"),
        key(F.col("n")).alias("node"),
        F.when(F.col("n") > 1, key(F.col("n") - 1)).alias("parent"),
        "role",
        "text",
        F.when(F.col("role") == "assistant", F.char_length("text")).otherwise(0).alias("score"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted texts."""
    turns = formatted.select("tree", "formatted", read_back(F.col("formatted")).alias("turns"), F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), (m["start"] + 1).cast("int"), m["length"].cast("int")))).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join("learnt", "")
    return turns.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
