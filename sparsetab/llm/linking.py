"""Connected components of links between documents, by alternating stars.

Links are pairs of keys of any one ordered type.  Each round joins every node to the least of its neighbours: first
its larger neighbours move there, then its smaller ones.  Links turn into stars around the least node of each
component, in a number of rounds that grows with the logarithm of the number of nodes.  A hub with very many links
is aggregated before the shuffle and joined by a plain equi-join of two tables, which Spark splits when it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparsetab.lineage import cut


def _towards_least(links: DataFrame, larger: bool) -> DataFrame:
    """Large star: neighbours above a node move to the least node next to it (itself included).  Small star: those below."""
    if larger:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a written table, so that the join below deals out both its sides and a hub can be split
    least = cut(around.groupBy("a").agg(F.min("b").alias("_least")).select(F.col("a").alias("_a"), F.least("a", "_least").alias("_least")))
    moved = around.join(least, F.col("a") == F.col("_a"))
    if larger:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionByName(
            least.select(F.col("_a").alias("a"), F.col("_least").alias("b")))
    return out.where("a <> b")


def _is_done(state: DataFrame) -> bool:
    """Whether every node hangs from one node, and that from none."""
    ends = state.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        state.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.agg(F.coalesce(F.max(F.col("hangs") + F.col("holds") * F.least("hangs", F.lit(1))), F.lit(0))).first()[0] <= 1


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; the root is the least node of its component.

    Null ends and links of a node with itself are left out; links may repeat and point either way.
    """
    state = cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a) != F.col(b)).distinct())
    while not _is_done(state):
        state = cut(_towards_least(_towards_least(state, larger=True), larger=False).distinct())
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
