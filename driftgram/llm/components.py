"""Connected components over an edge table, by alternating large-star and small-star steps.

Nodes are bigints. Each step is a grouped minimum and an equality join, so no node's
neighbours are ever gathered; lineage is cut with a checkpoint after each round.

Edge cases: edges may repeat, run both ways or join a node to itself (which says nothing); no edge
may have a null end; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds grow with the logarithm of the number of nodes; beyond this many something is wrong.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hooked = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't itself the least of its component."""
    now = common.checkpointed(edges.select("a", "b").where("a <> b").distinct())
    sign = (F.count("*"), F.bit_xor(F.xxhash64("a", "b")))
    seen = now.agg(*sign).first()
    for _ in range(MAX_ROUNDS):
        now = common.checkpointed(_small_star(_large_star(now).distinct()).distinct())
        found = now.agg(*sign).first()
        if found == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = found
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
