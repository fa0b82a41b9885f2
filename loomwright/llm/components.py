"""Connected components of a graph of links, by stars that grow and shrink in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Workspace


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """``node, component`` (the smallest node that can be reached) of every node in ``links`` (columns a, b; long).

    Each round hangs all neighbours of a node under the smallest of them, first the larger
    ones, then the smaller ones; it ends when a round changes nothing. Neighbours are never
    gathered: a node's smallest is an aggregate, joined back to its edges, so a node with
    many of them is split like any other skewed key. The rounds grow with the logarithm of
    the number of nodes.
    """
    edges = space.keep(f"{name}-0", links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, turn = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u")
        small = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        edges = space.keep(f"{name}-{turn}", small)
        space.drop(f"{name}-{turn - 1}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
