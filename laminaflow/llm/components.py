"""Connected components of an edge table by alternating stars, with every step a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laminaflow.llm.tables import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node with an edge reaches.

    ``edges`` has columns a and b; direction, repeats and loops don't matter. Large star: hang every larger neighbour of
    a node on its smallest neighbour; small star: do so with the smaller ones; until nothing changes, when every edge
    points to the smallest node of its component.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        around = _both_ways(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = stored(small, "small-star")
        # a forest of stars: no node hangs on a node that itself hangs on another, and none on two
        twice = small.groupBy("a").count().where("count > 1").limit(1)
        deep = small.join(small.select(F.col("a").alias("c")), F.col("b") == F.col("c"), "left_semi").limit(1)
        edges = small
        if twice.isEmpty() and deep.isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
