"""Which nodes are outdated, and in which order they are rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.operators import graph
from landspan.operators.journal import manifest


def outdated_seeds(nodes: DataFrame, edges: DataFrame, done: DataFrame) -> DataFrame:
    """Nodes outdated by themselves: never run, or a parent missing or finished later."""
    never = nodes.select("node_id").join(done, "node_id", "left_anti")
    child = done.select(F.col("node_id").alias("child"), F.col("completed").alias("own"))
    parent = done.select(F.col("node_id").alias("parent"), F.col("completed").alias("above"))
    older = (
        edges.join(child, "child").join(parent, "parent", "left")
        .where(F.col("above").isNull() | (F.col("own") < F.col("above")))
        .select(F.col("child").alias("node_id"))
    )
    return never.union(older).distinct()


def outdated(nodes: DataFrame, edges: DataFrame, journal: DataFrame) -> DataFrame:
    """Outdated ``node_id``: the seeds and everything downstream of them.

    Journal rows of nodes that left the graph take no part.
    """
    done = manifest(journal).join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    return graph.reached(nodes, edges, outdated_seeds(nodes, edges, done))


def worklist(
    selected: DataFrame, node_levels: DataFrame, stale: DataFrame | None
) -> DataFrame:
    """Selected nodes that are stale (all of them when ``stale`` is None), in build order."""
    picked = selected.select("node_id")
    if stale is not None:
        picked = picked.join(stale, "node_id", "left_semi")
    return graph.in_order(picked, node_levels)
