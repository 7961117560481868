"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """One row (node, root) per linked node; root is the smallest node it reaches.

    Union-find as a table: every round hangs nodes below the smallest neighbour, until
    the edges form stars.  Rounds grow with the logarithm of a component's size; a hub
    is pre-aggregated before each shuffle and its edges are only joined, so that
    adaptive execution can split them.  Nulls and self-links are ignored, repeated
    links count once; no links give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = materialize(
        links.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    while True:
        state = edges.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
        ).first()
        if seen == state or state["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct())
