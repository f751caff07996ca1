"""Bounded traversals over an edge table, as frontier joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def bfs(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """``(start, node, depth)``: nodes within ``depth`` hops of each start, by the fewest hops.

    ``starts(start)``; without a depth the walk goes on until it finds nothing new; cycles end at
    visited nodes; lineage is cut every round.
    """
    edges = edges.select("src", "dst").distinct()
    edges = cut(edges) if depth is None or depth > 1 else edges
    front = cut(starts.select("start", F.col("start").alias("node")).distinct())
    seen = front.withColumn("depth", F.lit(0))
    for level in count(1) if depth is None else range(1, depth + 1):
        step = front.join(edges, front.node == edges.src).select("start", F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(level)))
    return seen


def closure(edges: DataFrame) -> DataFrame:
    """``(start, node, depth)`` for every node with an outgoing edge, without the node itself, however far."""
    return bfs(edges, edges.select(F.col("src").alias("start"))).where("depth > 0")


def relations(edges: DataFrame, start: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Expanded nodes and emitted edges: with depth 1 only the start is expanded, and edges to unexpanded targets are kept."""
    spark = edges.sparkSession
    nodes = bfs(edges, spark.createDataFrame([(start,)], "start string"), max(0, depth - 1)).select("node", "depth")
    return nodes, edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")


def budgeted(visited: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """Visited rows as far as their running cost stays within the budget.

    The visited set is bounded by depth and start; the running sum is over it in one order.
    """
    total = F.sum(cost).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return visited.withColumn("spent", total).where(F.col("spent") <= budget)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))
