"""Connected components of a graph given as edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle


def _toward_least(pairs: DataFrame) -> DataFrame:
    """Of (u, v): each u with the least of u and its vs. Aggregated before it is shuffled, so that a hot u costs nothing."""
    return settle(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, least): every node of the edges (u, v) and the least node that it can reach.

    Large stars link the larger neighbours of a node to its least one, small stars the smaller
    ones; both keep the components. Rounds are written to the shared folder and end when one
    changes nothing. Joins go by node with both sides read from tables, so that Spark can split a
    hot node. Self-loops and repeated edges are allowed. The number of rounds grows with the
    logarithm of the longest path; more than max_rounds of them raise.
    """
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = settle(both.join(_toward_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = _toward_least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")).where("u <> m"))
        edges = settle(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
    return stars.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("least")).distinct())
