"""Distributed connected components by alternating large-star and small-star steps.

Every step reads and writes tables in the shared folder. A node with very many links is a skewed partition of a plain
join between two written tables, which Spark splits; nothing is collected beyond a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import work


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """The number of edges and two 64-bit digests of their set; edges are distinct."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def _linked(pairs: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b) with the least of a and its b for each a."""
    least = work.put(pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), tag)
    return pairs.join(least.hint("merge"), "a"), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b), longs; component is the smallest node reachable."""
    now = work.put(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined, least = _linked(both, "large")
        large = work.put(joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        work.drop(least, now)
        joined, least = _linked(large, "small")
        ends = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        small = work.put(joined.select(ends.alias("e")).select("e.*").filter("a <> b").distinct(), "edges")
        work.drop(least, large)
        now, before, state = small, state, _state(small)
        if state == before:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
