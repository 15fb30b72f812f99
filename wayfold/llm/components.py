"""Connected components of an edge table, without gathering it anywhere.

Alternating large-star and small-star rounds (Kiveris and others, 2014): each round is a
grouped minimum and a join, the edges never outnumber those given, and a few rounds suffice for
graphs of any diameter seen in practice.  A hub is pre-aggregated and its star is made
by a join, so no task gathers the neighbours of a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    side = both if large else both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:
        out = side.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = side.join(least.hint("merge"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return out if large else out.distinct()  # a large star only moves ends, so it makes no more edges


def _signature(edges: DataFrame) -> tuple:
    """A count and two hashes that equal edge tables share, and others but by a chance of 2 ** -127."""
    one, two = F.xxhash64("a", "b"), F.xxhash64("b", F.lit(7), "a")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(one), F.bit_xor(two)).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it reaches) of each node that has an edge."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = saved(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while (found := _signature(now)) != seen:
        seen = found
        large = saved(_star(now, True), "large")
        release(now)
        now = saved(_star(large, False), "small")
        release(large)
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops).groupBy("node").agg(F.min("component").alias("component"))
