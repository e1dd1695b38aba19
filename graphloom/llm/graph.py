"""Connected components of a graph of any size, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """v and root, the least node it is connected to, for every node of edges (a, b) but the roots themselves. Nodes are bigints.

    Each round hangs the larger neighbours of every node under its least neighbour, then the smaller ones; rounds grow with the logarithm of the
    longest path. The least neighbours are written before they are joined, so that a node of many edges can be split by AQE.
    """
    now = materialize(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "lz4")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "lz4")
        large = materialize(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "lz4")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "lz4")
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = materialize(small.select("e.*").filter("a != b").distinct(), "lz4")
        state, before = _state(now), state
        if state == before:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
