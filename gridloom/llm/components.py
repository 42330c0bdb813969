"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is a few joins and aggregates over edges; nothing is gathered in one task or on the driver, and each round's edges are
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    found = down.join(least, "u")
    return found.select(F.col("u").alias("a"), F.col("m").alias("b")).union(found.where("v <> m").select(F.col("v"), F.col("m"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of each node a that isn't the smallest of its component, and that smallest node b; ``edges`` has long columns a and b."""
    now = materialize(edges.where("a <> b").select("a", "b").distinct())
    while not now.isEmpty():
        now = materialize(_small_star(_large_star(now).distinct()))
        n, children = now.agg(F.count("*"), F.count_distinct("a")).first()
        if n == children and now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break  # every edge leads from a node to a root: stars
    return now
