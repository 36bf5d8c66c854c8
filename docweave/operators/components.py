"""Connected components of a table of links, by alternating star steps over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of the links (a, b); both are longs, or
    structs of one type, which are ordered by their fields; no order asked.

    Edges point from the larger node to the smaller.  The large step hangs every larger neighbour of a node below the
    node's smallest neighbour, the small step does so with the node itself and its smaller neighbours; rounds grow with
    the logarithm of the component's size, also along chains.  Smallest neighbours are summed before the shuffle and
    joined back one to a node, so a node with very many links is split like any skewed join.
    """
    edges = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("below")).distinct()
    )
    while True:
        both = edges.union(edges.select(F.col("below").alias("node"), F.col("node").alias("below")))
        least = both.groupBy("node").agg(F.min("below").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.join(least, "node").where("below > node").select(F.col("below").alias("node"), F.col("m").alias("below"))
        large = checkpointed(large.where("node <> below").distinct())
        lowest = large.groupBy("node").agg(F.min("below").alias("m"))
        hung = large.join(lowest, "node")
        small = hung.select(F.col("below").alias("node"), F.col("m").alias("below")).union(hung.select("node", F.col("m").alias("below")))
        edges = checkpointed(small.where("node <> below").distinct())
        # Done when all are stars: no node hangs below one that itself hangs below another.
        if edges.join(edges.select(F.col("node").alias("below")), "below", "left_semi").isEmpty():
            break
    tops = edges.select(F.col("below").alias("node"), F.col("below").alias("component")).distinct()
    return edges.select("node", F.col("below").alias("component")).union(tops)
