"""Connected components of a graph that is held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import hinted, small_side, stored


def forest_roots(parents: DataFrame, name: str = "roots") -> DataFrame:
    """node, root of a forest given as node, parent (parent < node, at most one row a node), by pointer jumping.

    Every round halves the depth; rounds are written to the shared folder, so a lost executor costs one round.
    """
    now = stored(parents.select("node", F.col("parent").alias("root")), name)
    while True:
        up = small_side(now.select(F.col("node").alias("_node"), F.col("root").alias("_root")))
        jumped = now.join(up, F.col("root") == F.col("_node"), "left").select("node", F.coalesce("_root", "root").alias("root"), (F.col("_root").isNotNull()).alias("_moved"))
        jumped = stored(jumped, name)
        now = jumped.select("node", "root")
        if jumped.filter("_moved").isEmpty():
            return now


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of the edges a, b but the roots themselves.

    Alternates large-star and small-star steps until nothing changes. Neighbourhood minima are aggregates joined back,
    never lists, so a node with very many neighbours is no single group in memory. No step makes more rows than there
    are edges, so the edges that are left bound the minima, which are broadcast only while that bound is small.
    """
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), name)
    rows, before = now.count(), None
    while True:
        both = now.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(now.select(F.col("m").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("low"))
        large = both.join(hinted(low, 2 * rows), "x").filter("y > x and y != low").select(F.col("y").alias("v"), F.col("low").alias("m"))
        large = stored(large, name)
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(hinted(least, rows), "v").filter("m != low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        now = stored(small.unionByName(least.select("v", F.col("low").alias("m"))).distinct(), name)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("v", "m") % 1_000_003)).first())
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("m").alias("root"))
        rows, before = state[0], state
