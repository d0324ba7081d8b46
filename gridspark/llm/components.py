"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SCOPES, scratch, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the smallest of its neighbours and itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and the node, point to the smallest of them. Edges come as u > v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether the edges are stars: every u has one edge, and no u is a v."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("low"), F.lit(0).alias("high")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return nodes.where("low > 1 or (low = 1 and high = 1)").isEmpty()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges (u, v)``; the root is the component's smallest node.

    Each round is written to the shared folder, so a lost executor repeats one round at most; only whether it is done reaches
    the driver. Loops and repeated edges do no harm; no edges give no rows.
    """
    edges, last = edges.where("u <> v"), None
    for _ in range(most):
        with scratch() as made:  # a round is deleted when the next one is done
            edges = stored(_small_star(_large_star(edges)), "stars")
            made[:] = [last] if last else []
        last = edges
        if _done(edges):
            break
    else:
        raise RuntimeError(f"not done after {most} rounds")
    if _SCOPES:
        _SCOPES[-1].append(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
