"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import attach, removed, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the neighbours of each node (large: those above it; small: those below, and itself) to its least neighbour."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = attach(both, least, ["u"], ["m"], "n", F.col("v")).withColumn("m", F.least("u", "m"))  # a root of very many nodes is joined by broadcast
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u, v) that is not its component's least node; root is that least node.

    Links in any order and number; a link of a node with itself says nothing.
    Large-star and small-star rounds shorten all paths at once, so the rounds
    grow with the logarithm of the longest path. Only whether a round was the
    last reaches the driver.
    """
    pair = F.col("u") != F.col("v")
    edges = written(links.filter(pair).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        after = written(_star(_star(edges, True), False), "links")
        ends = after.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(after.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        loose = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0)))
        done = loose.isEmpty()  # every node points to one other, and that to none: all are roots' stars
        removed(edges)
        edges = after
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
