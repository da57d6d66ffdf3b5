"""Connected components of links between numbered nodes, by alternating star contractions.

A large star hangs every larger neighbour of a node on its smallest neighbour, a small star every smaller one; repeated, each
component becomes one star around its smallest node, in a number of rounds that grows with the logarithm of its diameter. Only
smallest neighbours are gathered for a node, by an aggregation that combines before it shuffles. They are written before edges are
joined with them: between two plain tables Spark splits the edges of a node with very many neighbours over tasks. Each round is a
written table too: nothing is collected, and lost executors cost a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.llm.common import written


def _hang(edges: DataFrame, low: DataFrame) -> DataFrame:
    return edges.join(low, "u").where(F.col("v") != F.col("low"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that some link (columns a and b, in any order) joins to another one.

    Links of a node with itself and links with a null end count for nothing; repeated links count once."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, n = written(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low")
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        small = _hang(large, low).select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v"))).where(F.col("u") != F.col("v")).distinct()
        edges = written(small, "edges")
        # a set of stars: every u has one v, and no v is a u. The sums tell whether a round has changed anything.
        now = tuple(edges.agg(F.count(F.lit(1)), F.countDistinct("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == n and now[0] == now[1]:
            break
        n = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
