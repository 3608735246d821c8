"""Connected components of an edge table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.workspace import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(
        F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Node u (the larger end) and its neighbours below are tied to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where("v != m").select(
        F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node that has an edge.

    edges: u, v, numbers. Each round is written to the shared folder, so no plan grows; the
    number of rounds is logarithmic in the size of the largest component. Loops and repeated
    edges change nothing.
    """
    edges = materialize(edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "edges")
