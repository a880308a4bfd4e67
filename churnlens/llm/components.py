"""Connected components by alternating large-star and small-star steps.

Every step is one grouped minimum and one join, so that a node with very many
neighbours is reduced on the map side and its join is split by AQE. No list of
neighbours and no component is ever gathered in one task or in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import written


def _star(nbr: DataFrame, keep) -> DataFrame:
    """For each node u the smallest m of u and its neighbours; an edge (v, m) for each neighbour v that ``keep`` takes."""
    least = nbr.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return nbr.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node per node, for nodes that have an edge.

    ``edges``: columns ``a`` and ``b`` (long). Returns ``node`` and ``root``.
    Self loops and repeated edges do no harm; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "cc")
    last = None
    for _ in range(max_rounds):
        # large star: every neighbour above u is linked to the smallest node near u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _star(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        # small star: every neighbour below u, and u itself, is linked to the smallest of them
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        own = down.groupBy("u").agg(F.min("v").alias("m")).select("u", F.col("m").alias("v"))
        e = _star(down, F.col("v") < F.col("u")).where("u <> v").union(own).distinct()
        e = written(e, "cc")
        # a star forest no longer changes: every node above has one edge, and no root has one itself
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == now:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = e.groupBy("u").agg(F.min("v").alias("root"))
    return root.select(F.col("u").alias("node"), "root").union(
        root.select(F.col("root").alias("node"), "root").distinct())
