"""Connected components of a graph given as edges, by alternating star contractions.

Large star: every node tells its larger neighbours the smallest node it knows. Small star: every node tells its smaller
neighbours. After a logarithmic number of rounds each component is a star around its smallest node. All of it is joins and
minima on Spark: no edge reaches the driver, and a hub's edges are minima with map-side combine, never one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from voxelweave.llm.common import sized, stored


def _large_star(edges: DataFrame, stored: Callable) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    larger = edges.select("v", "u")  # u > v by construction: v tells u
    told = larger.join(sized(least).withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
    return told.where("u <> v")


def _small_star(edges: DataFrame, stored: Callable) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    told = edges.join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, stored: Callable = stored, rounds: int = 100) -> DataFrame:
    """Rows (node, component) of all nodes that have an edge; ``edges`` has two integer columns ``u`` and ``v``.

    component: smallest node reachable. Self-loops, repeated edges, either direction and null ends (dropped) are allowed;
    no edges give no rows. ``stored`` writes and reads back the rounds' tables. Raises if ``rounds`` contractions do not settle it (they roughly halve the depth each).
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        edges = stored(_small_star(_large_star(edges, stored), stored), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
