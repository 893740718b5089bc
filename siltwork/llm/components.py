"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialised


def _symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or both smaller and greater ones: each component is a star then."""
    ends = F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.n").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return nodes.filter("up + down > 1 and up > 0").limit(1).count() == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of long nodes as (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps: each node's greater neighbours, then its smaller ones, are
    tied to the least node in its neighbourhood. Both need only a minimum for each node, which combines
    before the shuffle, and a join with it, which Spark splits where a node is hot. The number of edges
    never grows, and each round's edges are written to the shared folder, so lineage stays short. Nodes
    without an edge to another node don't occur in the result.
    """
    edges = materialised(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        if _stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct().toDF("node", "component")
            )
        both = _symmetric(edges)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.filter("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialised(large.filter("a <> b").distinct(), "links")
        # now a > b in each row: a's smaller neighbours
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(least, F.col("a") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        before, edges = edges, materialised(small.filter("a <> b").distinct(), "links")
        discard(before)
        discard(large)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
