"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamesh.llm._io import unstage, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over written edges (a, b): every node's neighbours (the larger ones, if large, else those not over it) are tied to the least of node and neighbours.

    The least ones are written before edges meet them: both sides of the join are plain exchanges then, so adaptive
    execution can split a node with many neighbours. On top of an aggregation it could not.
    """
    if large:
        near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
    tied = near.join(least, F.col("a") == F.col("n"))
    if large:
        tied = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    tied = tied.where("a <> b")
    out = written(tied if large else tied.distinct(), "edges")
    unstage(least)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether (a, b) are stars: no node has two centres, and no centre has one."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): for every node of edges (a, b) other than its component's least, the least node reachable.

    Edges are undirected; loops, repeated edges and edges with nulls are let go. No component is ever in one task: a
    step groups by node with partial minima, and a node with many neighbours is a skewed join whose sides adaptive execution
    splits. Each half of a step is written to the shared folder, the one before it deleted. A chain of n nodes takes about log n steps; RuntimeError after `most`.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        half = _stars(now, True)
        unstage(now)
        now = _stars(half, False)
        unstage(half)
    raise RuntimeError(f"components not settled after {most} steps")
