"""Connected components by alternating large-star and small-star steps.

Each step is a min-aggregate per node and a join back, over tables cut by
staging; nothing is gathered on the driver. Pairs shrink to stars whose centre
is the smallest node of the component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    smallest = _min_neighbour(down)
    moved = down.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(smallest.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Every node points to one centre, no centre points on."""
    if edges.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), two longs; component is the smallest node reachable.

    The table of edges is read several times: stage it first.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = stage(edges, "edges")
    for _ in range(most_rounds):
        if _is_stars(edges):
            centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
        edges = stage(_small_star(_large_star(edges)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
