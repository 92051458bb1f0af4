"""Connected components of an edge table by alternating large and small stars.

Every round is joins and minima on the edge table; it is written between
rounds, so the plan stays short, a lost executor costs one round, and nothing
is collected.  The number of rounds grows with the logarithm of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "label"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b; long) to (node, label): label is the smallest node
    reachable.  Nodes that are their own label have no row; loops, repeated
    and reversed edges change nothing."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("label").alias("node"), F.col("node").alias("label")))
        least = both.groupBy("node").agg(F.least(F.min("label"), F.first("node")).alias("m"))
        large = (both.join(least, "node").where("label > node").select(F.col("label").alias("node"), F.col("m").alias("label"))
                 .where("node <> label").distinct())
        lower = large.groupBy("node").agg(F.min("label").alias("m"))
        small = large.join(lower, "node").where("label <> m").select(F.col("label").alias("node"), F.col("m").alias("label"))
        now = stored(small.unionByName(lower.select("node", F.col("m").alias("label"))).distinct())
        before, state = state, _state(now)
        if state == before:
            return now
