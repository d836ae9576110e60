"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.tables import removed, written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of one orderable type -> (node, component), component = the smallest node reachable.

    Self-loops, repeats and nulls are ignored; only nodes with an edge to another node are returned.
    Each round links every neighbour above a node to the node's smallest neighbour (large star), then
    every neighbour below it (small star), until the edges form stars. Rounds grow with the logarithm
    of the longest chain; each one is written to the shared folder, and nothing but a digest of the
    edges reaches the driver.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.where("a <> b").select(hi.alias("u"), lo.alias("v")).distinct())
    digest = _digest(now)
    while digest[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, digest = digest, _digest(after)
        removed(now)
        now = after
        if digest == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
