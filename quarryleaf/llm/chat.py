"""Chat formatting of reply trees, in DataFrame functions only.

A tree is a table of messages with parents. Iterative self-joins give every leaf its path to the root: each round
doubles the distance of the ancestors known, so a path of d messages takes log2(d) rounds. Paths of a conversation are
ranked by the mean score of their messages, and each chosen path becomes one formatted conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryleaf.llm.common import written

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column, line: bool = False) -> Column:
    r"""Reversible: a backslash becomes \0, the opening of a control string, <|, becomes \1, in a role a newline \2."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("\\1"))
    return F.replace(out, F.lit("\n"), F.lit("\\2")) if line else out


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\2"), F.lit("\n")), F.lit("\\1"), F.lit("<|"))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def chained(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as trees: (conv, node, parent, role, text, score), the parent the turn before.

    Turns with equal numbers follow each other by role and text; a null turn comes first; repeated rows are turns of
    their own; null roles and texts are empty. Rows with a null conversation make up one conversation.
    """
    base = rows.select(rows[conv].cast("long").alias("conv"), rows[turn].cast("long").alias("turn"), F.coalesce(rows[role].cast("string"), F.lit("")).alias("role"), F.coalesce(rows[text].cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = base.withColumn("node", F.row_number().over(order).cast("long"))
    return placed.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def paths(tree: DataFrame) -> DataFrame:
    """(conv, node, parent) -> (conv, leaf, node, up): every message above each leaf and its distance from it.

    Nodes are unique within a conversation. A message whose parent is missing is a root. Messages in a cycle have no
    leaf and no path; a cycle above a leaf ends its path before a message would come twice.
    """
    here = tree.select("conv", "node", "parent")
    jump = written(_known_parents(here).where("parent is not null"))  # later: ancestors at `reach`, of nodes that have one
    key = _same("a.conv", "b.conv")
    leaves = here.alias("a").join(here.alias("b"), key & (F.col("a.node") == F.col("b.parent")), "left_anti").select("a.conv", F.col("a.node").alias("leaf"))
    found = written(leaves.select("conv", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    reach = 1
    while True:
        step = found.alias("a").join(jump.alias("b"), key & (F.col("a.node") == F.col("b.node"))).select("a.conv", "a.leaf", F.col("b.parent").alias("node"), (F.col("a.up") + reach).alias("up"))
        more = written(step)
        if more.limit(1).count() == 0:
            return found
        grown = found.unionByName(more)
        new = written(grown.groupBy("conv", "leaf", "node").agg(F.min("up").alias("up")))
        if new.count() == found.count():  # only messages met before: a cycle
            return found
        found = new
        jump = written(jump.alias("a").join(jump.alias("b"), key & (F.col("a.parent") == F.col("b.node"))).select("a.conv", "a.node", F.col("b.parent").alias("parent")))
        reach *= 2


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _known_parents(here: DataFrame) -> DataFrame:
    both = here.alias("a").join(here.alias("b"), _same("a.conv", "b.conv") & (F.col("a.parent") == F.col("b.node")), "left")
    return both.select("a.conv", "a.node", F.col("b.node").alias("parent"))


def chosen_paths(tree: DataFrame, keep: int | None = 1) -> DataFrame:
    """(conv, leaf, node, up, rank) of the best paths of each conversation: by mean score (null as 0), then length, then
    leaf. Nodes are unique within a conversation; null conversations are one."""
    way = paths(tree)
    scored = way.alias("a").join(tree.select("conv", "node", "score").alias("b"), _same("a.conv", "b.conv") & (F.col("a.node") == F.col("b.node"))).select("a.conv", "a.leaf", "a.node", "a.up", "b.score")
    ranks = scored.groupBy("conv", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"), F.count("*").alias("n"))
    best = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("score"), F.desc("n"), "leaf")))
    best = best if keep is None else best.where(F.col("rank") <= keep)
    return way.alias("a").join(best.alias("b"), _same("a.conv", "b.conv") & (F.col("a.leaf") == F.col("b.leaf"))).select("a.conv", "a.leaf", "a.node", "a.up", "b.rank")


def format_paths(tree: DataFrame, keep: int | None = 1, assistant: str = "assistant") -> DataFrame:
    """One row per chosen path: conv, leaf, rank, formatted, loss (array of start and length, in code points).

    A turn is <|im_start|>, role, newline, text, <|im_end|>, newline, with role and text escaped; the loss mask covers
    the texts of the assistant. Null roles and texts count as empty, an empty tree gives no row. A conversation is one row
    and its chosen path is put together by one task: that is the output's own shape.
    """
    way = chosen_paths(tree, keep)
    words = tree.select("conv", "node", F.concat(F.lit(START), escaped(F.coalesce("role", F.lit("")), True), F.lit("\n")).alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role") == assistant, F.lit(False)).alias("learn"))
    rows = way.alias("a").join(words.alias("b"), _same("a.conv", "b.conv") & (F.col("a.node") == F.col("b.node")))
    turns = rows.groupBy("a.conv", "a.leaf", "a.rank").agg(F.array_sort(F.collect_list(F.struct((-F.col("a.up")).alias("at"), "b.head", "b.body", "b.learn"))).alias("turns"))
    tail = F.lit(END + "\n")
    size = len(END) + 1
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("turns", empty, lambda acc, t: F.struct(
        (acc["at"] + F.length(t["head"]) + F.length(t["body"]) + size).alias("at"),
        F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans")))
    return turns.select("conv", "leaf", "rank", F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], tail)), "").alias("formatted"), spans["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of formatted conversations, from the formatted text and its loss mask alone; no row gives no row."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p.contains(END))
    turn = F.transform(parts, lambda p: F.struct(
        unescaped(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substring_index(p.substr(F.instr(p, F.lit("\n")) + 1, F.length(p)), END, 1)).alias("text")))
    learnt = F.array_join(F.transform("loss", lambda x: unescaped(F.substring("formatted", x["start"] + 1, x["length"]))), "")
    out = formatted.select("*", turn.alias("turns"), learnt.alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
