"""Distributed connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is an aggregate (a minimum per node, combined before the shuffle) and a join, so a node with very many
neighbours is never gathered in one place.  Each step's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import drop_stored, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v).  Large: each node links its larger neighbours to its smallest one (or itself).
    Small: each node links its smaller neighbours, and itself, to the smallest of them."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = (edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select("u", F.col("m").alias("v"))))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component: the smallest node reachable.

    Self-loops and edges with a null end are ignored.  Raises if ``max_steps`` rounds do not settle it (a
    logarithmic number does in practice).
    """
    e = (edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    now = stored(e, "components")
    for _ in range(max_steps):
        nxt = stored(_star(_star(now, True), False), "components")
        drop_stored(now)
        now = nxt
        # done when every node points at one node, and that one points nowhere
        roots = now.select(F.col("v").alias("u"), F.lit(2).alias("n")).distinct()
        if now.select("u", F.lit(1).alias("n")).union(roots).groupBy("u").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty():
            break
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
