"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: neighbours of a node (the larger or the smaller ones) are tied to its smallest neighbour.

    The minimum is combined before the shuffle, so a node with any number of neighbours costs a row per task.
    """
    ends = edges.select(F.col("u"), F.col("v"))
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    tied = both.join(least, "u")
    if larger:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """Of edges (u, v): (node, root), root the smallest node reachable; isolated nodes don't appear.

    Self-loops, repeated and reversed edges do no harm; an empty table gives an empty one. Each round is stored, so lost
    executors cost one round; the rounds grow with the logarithm of the longest chain.
    """
    edges = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stored(_contract(_contract(edges, True), False), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
