"""Connected components of a table of links, by alternating large and small stars.

Each round rewrites the links with two grouped minima and two joins; nothing is gathered in one task or on the
driver but a count and a checksum of the links.  The rounds grow with the logarithm of the number of nodes.
The joins are merges at any size: a broadcast goes through the driver, takes a megabyte or more there for a few rows and
stays until the driver collects its garbage, and there would be several in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralith.llm.common import dropped, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node that the node knows (itself included)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is linked to the smallest of them. Links have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (u long, v long, either order) to (id, component): every node that has a link to another one, and the
    smallest node reachable from it. Links of a node to itself and null ends count for nothing.
    """
    edges = saved(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        before, edges = edges, saved(_small_star(_large_star(edges)))
        dropped(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links don't settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
