"""Pointer jumping: the ends of chains and the components of pairs, in a number of rounds that grows with the logarithm only.

Every round is one join that doubles how far each pointer reaches, written before the next; nothing is collected but whether
something moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut


def chain_ends(links: DataFrame) -> DataFrame:
    """source, target: where each chain of links (source, target; one a source, no loops) ends.

    A cycle ends at its smallest member, which gets no row of its own; what leads into it ends there too."""
    state = cut(links.select("source", F.col("target").alias("to"), F.least("source", "target").alias("least")))
    n, steps = state.count(), 1
    while steps < 2 * n:
        onward = state.select(F.col("source").alias("to"), F.col("to").alias("next"), F.col("least").alias("seen"))
        state = cut(state.join(onward, "to", "left").select("source", F.coalesce("next", "to").alias("to"),
            F.coalesce(F.least("least", "seen"), "least").alias("least"), F.col("next").isNotNull().alias("moved")))
        steps *= 2
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    # whoever still points at a source, points into a cycle, all of which that source has seen
    cycle = state.select(F.col("source").alias("to"), F.col("least").alias("end"))
    ends = state.join(cycle, "to", "left").select("source", F.coalesce("end", "to").alias("target"))
    return ends.where("source <> target")


def components(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of pairs (a, b), whatever their direction.

    Each round hangs a tree's root under the smallest root that its pairs touch, then halves the way to the roots."""
    both = cut(pairs.where("a <> b").select("a", "b").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lone = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    parent = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up")))
    while True:
        up = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        near = both.join(up, "a").join(up.toDF("b", "ub"), "b").where("ub < ua")
        hang = near.groupBy(F.col("ua").alias("node")).agg(F.min("ub").alias("under"))
        hung = parent.join(hang, "node", "left").select("node", F.least("up", F.coalesce("under", "up")).alias("new"), "up")
        hung = cut(hung)
        over = hung.select(F.col("node").alias("new"), F.col("new").alias("top"))
        jumped = cut(hung.join(over, "new").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        still = jumped.where("moved").isEmpty()
        parent = jumped.drop("moved")
        if still:
            break
    found = parent.select("node", F.col("up").alias("component"))
    return found.unionByName(lone.join(found.select("node"), "node", "left_anti"))
