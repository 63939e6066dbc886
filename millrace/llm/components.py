"""Connected components over a distributed edge table (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import materialize


def downward(edges: DataFrame) -> DataFrame:
    """Distinct links (a, b) from the larger end to the smaller; null ends and self links count as none."""
    ends = edges.where(F.col("a") != F.col("b"))
    return ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def step(now: DataFrame) -> DataFrame:
    """One large-star and one small-star over links from larger to smaller ends; components stay the same.

    Least ends are pre-aggregated to one row a node; a hub's links meet it in a
    join, which Spark splits where it is skewed, and are never a list.
    """
    # large-star: every neighbour above a node is tied to the node's smallest neighbour
    least = now.groupBy("a").agg(F.min("b").alias("m"))
    large = now.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
    # small-star: every neighbour below a node, and the node, are tied to the smallest of them
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return small.where(F.col("a") != F.col("b")).distinct()


def finished(now: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has just one, which has none: each root and its star."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("n"), F.lit(0).alias("root")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("n"), F.lit(1).alias("root")),
    )
    nodes = now.select(F.explode(ends).alias("x")).select("x.*").groupBy("node").agg(F.sum("n").alias("n"), F.max("root").alias("root"))
    return nodes.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("root") == 1))).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node long, component long): the smallest node reachable by links.

    Only nodes with an edge to another node are returned; null ends and self
    links count as no link, repeated ones as one, and an empty table has no nodes.
    Each round is written to the shared folder; the number of rounds grows with
    the logarithm of the longest path.  No neighbour list is gathered in a task.
    """
    now = materialize(downward(edges), "edges")
    while not finished(now):
        now = materialize(step(now), "edges")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
