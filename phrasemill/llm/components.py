"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.common import release, stage


def _least(pairs: DataFrame) -> DataFrame:
    """For each ``a`` the least of itself and all its ``b``."""
    return pairs.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = both.join(_least(both), "a").where("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the edge to the least node stays, the others turn to it
    return down.join(_least(down), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                               F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node points to two others, or both points and is pointed at."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    met = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return met.where("out > 1 or out = 1 and into = 1").limit(1).count() == 0


def stars(edges: DataFrame) -> DataFrame:
    """``(node, component)``, staged, for every node of ``edges(a, b)`` but the smallest of each component.

    Self-loops and repeated edges do no harm. Each round keeps one row an edge at most, is written to
    the shared folder, and hot nodes are joined to one row each, so skewed joins can be split. After
    about log(n) rounds the edges are stars around the smallest nodes.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while not _settled(now):
        after = stage(_small(_large(now)), "edges")
        release(now)
        now = after
    found = now.toDF("node", "component")
    found._staged_at = now._staged_at
    return found


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    A node that only has a self-loop is not returned.
    """
    found = stars(edges)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
