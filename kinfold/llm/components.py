"""Connected components of a table of links, without any node's links in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def connected(links: DataFrame) -> DataFrame:
    """From links (a, b) to (node, root), root the same for all nodes of a component; only linked nodes have a row.

    Each round every node hooks to its least neighbour, chains are shortened twice, and the links between what
    nodes hook to go on, without those inside one node. A hot node's links meet only in a partial minimum
    and in joins that split it. Rounds grow with the logarithm of the longest path. Self-links and repeats
    are harmless; no links give no rows.
    """
    edges, roots = cut(links.where("a <> b").distinct()), None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")))
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("next"))
            hook = cut(hook.join(above, "up").select("node", F.col("next").alias("up")))
        if roots is None:
            roots = hook.select("node", F.col("up").alias("root"))
        else:
            above = hook.select(F.col("node").alias("root"), "up")
            roots = cut(roots.join(above, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        for end in ("a", "b"):
            edges = edges.join(hook.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("up", end)
        edges = cut(edges.where("a <> b").select("a", "b").distinct())
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
