"""Connected components by alternating star contractions over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import respread, stage_table


def _stars(links: DataFrame) -> DataFrame:
    """Each ``u, v`` with the least ``m`` of u's links and itself. A hot u can be split: both sides are dealt anew."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(respread(F.col("u")).alias("k"), F.least("u", "m").alias("m"))
    return links.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` edges of longs to ``node, component``, for nodes with an edge to another; the component is its least node.

    Larger neighbours are hung on a node's least neighbour, then smaller ones, until nothing changes; each round is
    written to the shared folder. The number of rounds grows with the logarithm of a component's width.
    """
    edges = stage_table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", [edges])
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _stars(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        # u's links all point down: each, and u itself, to the least of them.
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        turned = stage_table(down.filter("u <> v").distinct(), "cc", [edges, edges])
        if _same(edges, turned):
            return turned.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = turned


def _same(a: DataFrame, b: DataFrame) -> bool:
    digest = [F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))]
    return a.agg(*digest).first() == b.agg(*digest).first()
