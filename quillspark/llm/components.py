"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_by_size, materialise

BROADCAST_ROWS = 1_000_000  #: rows (16 bytes each) up to which the least neighbours are broadcast


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges(a, b); loops and repeats are allowed.

    Each round hangs the neighbours of a node on the smallest of them, first those above the node,
    then those below; rounds end when the edges stay the same. Nodes with many neighbours meet partial
    aggregation only: their least neighbour comes by broadcast, where all nodes' are known to be few, or where the node is one of the
    bounded number of large ones. Every round is a written table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current = materialise(pairs, "edges")
    print_of = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = print_of(current)
    while before[0]:
        few = 2 * before[0] <= BROADCAST_ROWS
        meet = lambda rows, least: rows.join(F.broadcast(least.drop("members")), "a") if few else join_by_size(rows, least, ["a"])
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("members")).select("a", F.least("a", "m").alias("m"), "members")
        large = meet(both, lowest).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("members"))
        small = meet(large, least)
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        following = materialise(small, "edges")
        now = print_of(following)
        forget(large)
        forget(current)
        current = following
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
