"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.session import materialize


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones.
    Minima are aggregates, and joins with them are one row per node, so a node with very many
    neighbours is split like any skewed key. The number of rounds grows with the logarithm of
    the longest chain. Every round is written to the shared folder.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    current = materialize(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), label)
    state = fingerprint(current)
    while state[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(nearest, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        current = materialize(small.union(nearest.select("u", F.col("m").alias("v"))).distinct(), label)
        before, state = state, fingerprint(current)
        if before == state:
            break
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
