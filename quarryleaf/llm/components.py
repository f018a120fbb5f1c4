"""Connected components of a distributed edge table. Each round is written as a table, whose size lets Spark broadcast
it where it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryleaf.llm.common import discard, written


def roots(parents: DataFrame) -> DataFrame:
    """(node, parent) with parent <= node, one row per node -> (node, comp): the root each chain ends at.

    Pointer doubling: each round halves the length of all chains, so that log2(longest chain) rounds suffice. A parent
    without a row of its own is a root.
    """
    now = written(parents.select("node", F.col("parent").alias("comp")))
    while True:
        up = now.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = written(now.join(up, "comp", "left").select("node", F.coalesce("next", "comp").alias("new"), "comp"))
        discard(now)
        now = step.select("node", F.col("new").alias("comp"))
        if step.where("new <> comp").limit(1).count() == 0:
            return now


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, comp): the smallest node reachable. Min-label rounds with pointer jumping; the labels of
    neighbours are combined before the shuffle, so a node with very many edges costs its task one row per map task."""
    both = edges.where("a <> b").select("a", "b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp")))
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("comp").alias("near"))
        met = labels.join(seen, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        step = written(met.join(up, "low", "left").select("node", "comp", F.least("low", F.coalesce("next", "low")).alias("new")))
        discard(labels)
        labels = step.select("node", F.col("new").alias("comp"))
        if step.where("new <> comp").limit(1).count() == 0:
            return labels
