"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import save


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node reachable.

    Each round every node points to its least neighbour if that is smaller; pointers are followed to their roots by
    doubling; links are then drawn between roots. Nodes only move to smaller ones, so there are no cycles, and each
    round at least halves the components that still have links. Tables of a round are stored in the shared folder.
    """
    links = save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = save(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().select("node", F.col("node").alias("root")), "nodes")
    while links.limit(1).count():
        up = save(links.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")), "up")
        while True:  # p becomes the pointer of p, until no pointer's target points on
            further = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            moved = save(up.join(further, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("on")), "up")
            up = moved.select("v", "p")
            if not moved.where("on").limit(1).count():
                break
        root = up.select(F.col("v").alias("root"), "p")
        nodes = save(nodes.join(root, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
        left, right = up.select(F.col("v").alias("a"), F.col("p").alias("pa")), up.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        drawn = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
        links = save(drawn.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return nodes.select("node", F.col("root").alias("component"))
