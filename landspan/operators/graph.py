"""Dependency graph over node tables.

``nodes(node_id, kind)``, ``owns(node_id, schema, name, type)``, ``deps`` of the same
shape, ``edges(child, parent)``.  Iterative operators keep one frontier per round, write
it to the shared folder, and stop when a round is empty.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.operators.recursion import recursive_union
from landspan.workspace import Rounds, by_rows, materialize

OBJECT = ["schema", "name", "type"]
# Rounds after which settled nodes are left behind.
COMPACT = 8


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Node ids used more than once: ``(node_id, uses)``."""
    counts = nodes.groupBy("node_id").agg(F.count("*").alias("uses"))
    return counts.where("uses > 1")


def owner_conflicts(owns: DataFrame) -> DataFrame:
    """Objects claimed more than once, with claims, number of owners and two of them."""
    counts = owns.groupBy(*OBJECT).agg(
        F.count("*").alias("claims"),
        F.count_distinct("node_id").alias("owners"),
        F.min("node_id").alias("first_owner"),
        F.max("node_id").alias("last_owner"),
    )
    return counts.where("claims > 1")


def edges(deps: DataFrame, owns: DataFrame) -> DataFrame:
    """Distinct ``(child, parent)``: who requires an object, who owns it."""
    parents = owns.withColumnRenamed("node_id", "parent")
    return (
        deps.withColumnRenamed("node_id", "child")
        .join(parents, OBJECT)
        .select("child", "parent")
        .distinct()
    )


def missing_owners(deps: DataFrame, owns: DataFrame) -> DataFrame:
    """Required objects nobody owns: ``(node_id, schema, name, type)``."""
    return deps.join(owns, OBJECT, "left_anti").select("node_id", *OBJECT).distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct ``node_id`` reached from ``seeds`` along parent -> child, seeds included."""
    links = materialize(edges.select("child", "parent"), "links")

    def children(frontier: DataFrame) -> DataFrame:
        parents = frontier.withColumnRenamed("node_id", "parent")
        return links.join(parents, "parent").select(F.col("child").alias("node_id"))

    return recursive_union(seeds.select("node_id"), children)


def chains(single: DataFrame) -> DataFrame:
    """Nearest ancestor with no or several parents: ``(node_id, anchor, steps, open, hit)``.

    ``single(node_id, parent)`` are the nodes with one parent.  Pointers double their reach
    in each round, so a chain costs the logarithm of its length.  When a round closes no
    pointer, those still open run in a cycle.  With a column ``hit`` on nodes, that of the result
    says whether some node from here up to below the anchor has it.
    """
    hit = F.col("hit") if "hit" in single.columns else F.lit(False)
    single = materialize(single, "single-parents")
    rows = single.count()
    names = single.select(F.col("node_id").alias("anchor"), F.lit(True).alias("more"))
    runs = materialize(
        single.withColumnRenamed("parent", "anchor").join(by_rows(names, rows), "anchor", "left").select(
            "node_id", "anchor", F.lit(1).alias("steps"), F.coalesce("more", F.lit(False)).alias("open"),
            hit.alias("hit")),
        "chains")
    before, left = None, runs.where("open").count()
    while left and left != before:
        reach = runs.select(F.col("node_id").alias("anchor"), F.col("anchor").alias("far"),
                              F.col("steps").alias("far_steps"), F.col("open").alias("far_open"),
                              F.col("hit").alias("far_hit"))
        jumped = runs.where("open").join(by_rows(reach, rows), "anchor").select(
            "node_id", F.col("far").alias("anchor"), (F.col("steps") + F.col("far_steps")).alias("steps"),
            F.col("far_open").alias("open"), (F.col("hit") | F.col("far_hit")).alias("hit"))
        runs = materialize(runs.where("NOT open").unionByName(jumped), "chains")
        before, left = left, runs.where("open").count()
    return runs


def _peel(start: DataFrame, links: DataFrame) -> DataFrame:
    """Settled nodes ``(node_id, level, hit)`` of a graph with weighted links.

    ``start(node_id, closed, reach, level, hit)``: minus the number of parents; the level where
    there are none.  ``links(child, parent, weight, hot)``; a node is hit by itself, by a hot link, or by a
    parent that is.  A round adds a row for each node some
    of whose parents it settles; the node settles in the round that brings its sum to zero.
    After ``COMPACT`` rounds only nodes that are still open are carried on, one row each.
    """
    spark = start.sparkSession
    settled = Rounds(spark, "levels", start.select("node_id", "level", "hit").schema)
    frontier = None
    while True:
        seen = Rounds(spark, "open-nodes", start.schema)
        opened = seen.append(start)
        frontier = opened.where("level IS NOT NULL") if frontier is None else frontier
        for _ in range(COMPACT):
            if not (rows := frontier.count()):
                settled.append(seen.all().where("level IS NOT NULL"))
                return settled.all()
            parents = frontier.select(F.col("node_id").alias("parent"), "level", "hit")
            touched = links.join(by_rows(parents, rows), "parent").groupBy(F.col("child").alias("node_id")).agg(
                F.count("*").alias("now"), F.max(F.col("level") + F.col("weight")).alias("best"),
                F.max(F.col("hot") | F.col("hit")).alias("got"))
            # What is known of each node meets what it gets in an aggregation, so no table of nodes is broadcast.
            step = seen.all().select("node_id", "closed", "reach", "hit").unionByName(
                touched, allowMissingColumns=True).groupBy("node_id").agg(
                F.max("now").alias("now"), F.max("best").alias("best"), F.max("got").alias("got"),
                F.sum("closed").alias("before"), F.max("reach").alias("high"), F.max("hit").alias("own")).where(
                "now IS NOT NULL AND before IS NOT NULL")
            reach = F.greatest("best", "high")
            frontier = seen.append(step.select(
                "node_id", F.col("now").alias("closed"), reach.alias("reach"),
                F.when(F.col("before") + F.col("now") == 0, reach).alias("level"),
                (F.col("got") | F.col("own")).alias("hit"),
            )).where("level IS NOT NULL")
        settled.append(seen.all().where("level IS NOT NULL"))
        start = seen.all().groupBy("node_id").agg(
            F.sum("closed").alias("closed"), F.max("reach").alias("reach"),
            F.max("level").alias("level"), F.max("hit").alias("hit")).where("level IS NULL")


def sweep(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Topological level per node, and whether a seed reaches it: ``(node_id, level, hit)``.

    Level 0 has no parent, every other node is one above its highest parent; nodes that
    never settle lie on or below a cycle, or a parent is no node, and their level is NULL.  Runs of
    nodes with one parent each are contracted first; the rest is settled round by round, each node
    once, with what its parents hand down.
    """
    ids = nodes.select("node_id").distinct()
    links = materialize(edges.select("child", "parent").distinct(), "links")
    pairs = links.count()
    need = ids.join(by_rows(links, pairs).withColumnRenamed("child", "node_id"), "node_id", "left").groupBy("node_id").agg(
        F.count("parent").alias("parents"), F.min("parent").alias("parent"))
    if seeds is None:
        need = need.withColumn("hit", F.lit(False))
    else:
        need = need.join(seeds.select("node_id", F.lit(True).alias("seed")).distinct(), "node_id", "left").select(
            "node_id", "parents", "parent", F.coalesce("seed", F.lit(False)).alias("hit"))
    need = materialize(need, "parents")
    rows = max(need.count(), pairs)
    through_one = chains(need.where("parents = 1").select("node_id", "parent", "hit"))
    through = through_one.select(F.col("node_id").alias("parent"), "anchor", "steps", F.col("hit").alias("hot"))
    # A parent within a chain stands for the anchor above it.
    short = materialize(
        need.where("parents > 1").select(F.col("node_id").alias("child")).join(by_rows(links, pairs), "child")
        .join(by_rows(through, rows), "parent", "left")
        .groupBy("child", F.coalesce("anchor", "parent").alias("parent"))
        .agg((F.max(F.coalesce("steps", F.lit(0))) + 1).alias("weight"),
             F.max(F.coalesce("hot", F.lit(False))).alias("hot")),
        "short-links")
    several = short.groupBy(F.col("child").alias("node_id")).agg((-F.count("*")).alias("closed"))
    none = need.where("parents = 0").select(
        "node_id", F.lit(0).cast("long").alias("closed"), F.lit(0).alias("reach"), F.lit(0).alias("level"), "hit")
    start = none.unionByName(several.join(by_rows(need.select("node_id", "hit"), rows), "node_id").select(
        "node_id", "closed", F.lit(0).alias("reach"), F.lit(None).cast("int").alias("level"), "hit"))
    top = _peel(start, short)
    above = top.select(F.col("node_id").alias("anchor"), "level", F.col("hit").alias("above"))
    below = through_one.join(by_rows(above, rows), "anchor")
    done = top.unionByName(below.select(
        "node_id", (F.col("level") + F.col("steps")).alias("level"), (F.col("hit") | F.col("above")).alias("hit")))
    return ids.join(by_rows(done, rows), "node_id", "left").select("node_id", "level", "hit")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Topological level per node: ``(node_id, level)``, NULL on and below cycles; see ``sweep``.

    Sorting by (level, node_id) is a topological order.
    """
    return sweep(nodes, edges).select("node_id", "level")


def reached(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node_id`` of the nodes that are seeds or below one.

    Settled in one sweep over the graph, so the rounds follow its depth without runs of single-parent
    nodes, and each node is written once. Only nodes on or below cycles are searched from the seeds.
    """
    seeds = materialize(seeds.select("node_id"), "seeds")
    swept = materialize(sweep(nodes, edges, seeds), "swept")
    hit = swept.where("hit").select("node_id")
    stuck = swept.where("level IS NULL").select("node_id")
    if stuck.isEmpty():
        return hit
    into = edges.join(stuck.withColumnRenamed("node_id", "child"), "child", "left_semi")
    first = seeds.join(stuck, "node_id", "left_semi").union(
        into.join(hit.withColumnRenamed("node_id", "parent"), "parent", "left_semi").select("child"))
    return hit.union(reachable(into, first))


def require_acyclic(nodes: DataFrame, edges: DataFrame, node_levels: DataFrame | None = None) -> None:
    """Raise when some node has no level, and name a cycle or what such nodes wait for."""
    from landspan.operators import cycles

    node_levels = levels(nodes, edges) if node_levels is None else node_levels
    stuck = [row["node_id"] for row in node_levels.where("level IS NULL").orderBy("node_id").take(5)]
    if not stuck:
        return
    if names := cycles.name_cycle(cycles.on_cycles(nodes, edges, node_levels), edges):
        raise ValueError(f"nodes are in a cycle: {' <- '.join(names)}")
    raise ValueError(f"nodes wait for a parent that is no node, for example {stuck}")


def select_nodes(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose whole id matches; ``*`` stands for any text, nothing else is special."""
    if "+" in pattern.removeprefix("+").removesuffix("+"):
        raise ValueError("'+' is only allowed at the start and the end of a pattern")
    if "+" in pattern:
        raise NotImplementedError("the '+' graph operator is not supported")
    body = ".*".join(re.escape(piece) for piece in pattern.split("*"))
    return nodes.where(F.col("node_id").rlike(f"^{body}$"))


def in_order(selected: DataFrame, node_levels: DataFrame) -> DataFrame:
    """Selected nodes with their level, in topological order."""
    return selected.join(node_levels, "node_id").orderBy("level", "node_id")


def schemas(owns: DataFrame) -> DataFrame:
    """Distinct schemas of the owned objects, sorted."""
    return owns.select("schema").distinct().orderBy("schema")


def render(nodes: DataFrame, deps: DataFrame, owns: DataFrame) -> DataFrame:
    """One line per fact about a node: ``(node_id, kind, role, object)``.

    ``role`` is input, output or, for a node with neither, none.  One row per object keeps
    a node with very many objects spread over tasks.
    """
    full = F.concat_ws(".", "schema", "name")
    facts = deps.select("node_id", F.lit("input").alias("role"), full.alias("object")).unionByName(
        owns.select("node_id", F.lit("output").alias("role"), full.alias("object"))
    )
    return nodes.join(facts.distinct(), "node_id", "left").select(
        "node_id", F.upper(F.substring("kind", 1, 1)).alias("kind"),
        F.coalesce("role", F.lit("none")).alias("role"), "object",
    )
