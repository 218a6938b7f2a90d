"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def _both_ways(e: DataFrame) -> DataFrame:
    return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(e: DataFrame) -> DataFrame:
    """Each row (u, v) with the least node among u and its neighbours. Skew of a hub is split by AQE's skew join."""
    least = e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return e.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Labels of the nodes that ``edges`` (long columns a, b) touch: (node, component), the component being its
    least node. Null ends and loops are ignored; no edges give no rows.

    Every round is two aggregations and two joins on a node; edges are settled in the shared folder after each, so
    lineage stays short. Rounds grow with the logarithm of the longest path. Nothing is collected but two totals."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = settle(e), None
    for _ in range(max_rounds):
        state = tuple(e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first())
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        seen = state
        large = _with_least(_both_ways(e)).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").unionByName(small.select("u", F.col("least").alias("v")))
        e = settle(small.distinct())
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
