"""Cycles of a dependency graph: strongly connected components and one cycle by name.

Nodes that are on no cycle are trimmed from both sides. What is left is colored: every node takes the
least name among the nodes that reach it, and the nodes that reach back to the owner of their color
without leaving it are one component. Components found are taken out, and the rest starts again.
Before coloring, runs of nodes with one parent each are contracted, so rounds follow the
contracted graph; a cycle of such nodes only is settled by pointer doubling. As soon as no more than
``FINISH`` edges are left, one task finds their components in one pass.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.operators import graph
from landspan.workspace import Rounds, by_rows, materialize

NAMED = "node_id string, component string"
# Nodes of a cycle that a message names.
SHOWN = 20
# Edges that one task finishes.
FINISH = 100_000


def on_cycles(nodes: DataFrame, edges: DataFrame, node_levels: DataFrame | None = None) -> DataFrame:
    """``(node_id, component)`` of every node on a cycle; the component is named by its least node.

    Other nodes without a level lie below a cycle, or wait for a parent that is no node.
    """
    spark = nodes.sparkSession
    node_levels = graph.levels(nodes, edges) if node_levels is None else node_levels
    stuck = node_levels.where("level IS NULL").select("node_id")
    found = Rounds(spark, "components", spark.createDataFrame([], NAMED).schema)
    found.append(spark.createDataFrame([], NAMED))
    # Nodes without a cycle above them have a level, so only the other side is trimmed at first.
    left, sides = _between(edges, stuck), (True,)
    while True:
        left, sides = _trimmed(left, sides), (False, True)
        if left.limit(FINISH + 1).count() <= FINISH:
            found.append(left.repartition(1).mapInArrow(_finish, NAMED))
            return found.all()
        counts = left.groupBy(F.col("child").alias("node_id")).agg(
            F.count("*").alias("parents"), F.min("parent").alias("parent"))
        counts = materialize(counts, "cycle-parents")
        rows = counts.count()
        chains = graph.chains(counts.where("parents = 1").select("node_id", "parent"))
        # Pointers that never close run in, or into, a cycle of nodes with one parent each.
        open_runs = by_rows(chains.where("open"), rows)
        loops = _loops(counts.join(open_runs, "node_id", "left_semi").select("node_id", "parent"))
        several = counts.where("parents > 1")
        if several.isEmpty():
            found.append(loops)
            return found.all()
        colored, components = _by_color(left, several.select("node_id"), chains.where("NOT open"))
        found.append(loops)
        found.append(components)
        # A color whose owner's component is known is done with as far as it was examined.
        done = loops.select("node_id").unionByName(colored)
        left = _between(left, _ends(left).join(by_rows(done, rows), "node_id", "left_anti"))


def _finish(batches):
    """Components of a few edges: nodes in the order in which a walk leaves them, then walks against the
    edges from the last one left.
    """
    above, below = defaultdict(list), defaultdict(list)
    for batch in batches:
        for child, parent in zip(*(column.to_pylist() for column in batch.columns)):
            above[child].append(parent)
            below[parent].append(child)
    left, seen = [], set()
    for start in [*below, *above]:
        stack = [] if start in seen else [(start, iter(below[start]))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            following = next((n for n in rest if n not in seen), None)
            if following is None:
                left.append(stack.pop()[0])
            else:
                seen.add(following)
                stack.append((following, iter(below[following])))
    placed, rows = set(), []
    for start in reversed(left):
        if start in placed:
            continue
        group, stack = [], [start]
        placed.add(start)
        while stack:
            group.append(node := stack.pop())
            more = [n for n in above[node] if n not in placed]
            placed.update(more)
            stack.extend(more)
        if len(group) > 1 or start in above[start]:
            rows.extend((node, min(group)) for node in group)
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)],
                                     names=["node_id", "component"])


def _ends(links: DataFrame) -> DataFrame:
    return links.select(F.col("child").alias("node_id")).union(links.select("parent")).distinct()


def _between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Distinct edges between some nodes, written."""
    ids = materialize(ids, "cycle-nodes")
    some = by_rows(ids, ids.count())
    return materialize(
        edges.select("child", "parent").distinct()
        .join(some.withColumnRenamed("node_id", "child"), "child", "left_semi")
        .join(some.withColumnRenamed("node_id", "parent"), "parent", "left_semi").select("child", "parent"),
        "cycle-links")


def _trimmed(links: DataFrame, sides: tuple[bool, ...]) -> DataFrame:
    """Edges between nodes that have a cycle above (and, flipped, below) them, or lie on one."""
    for flip in sides:
        turned = links.select(F.col("parent").alias("child"), F.col("child").alias("parent")) if flip else links
        stuck = graph.levels(_ends(links), turned).where("level IS NULL").select("node_id")
        links = _between(links, stuck)
    return links


def _loops(single: DataFrame) -> DataFrame:
    """Cycles of a table in which every node has one parent, itself in the table.

    After as many steps as there are nodes every pointer is on a cycle, and every node of a cycle
    is pointed at. The least name on the way doubles its reach along with the pointers.
    """
    at = materialize(single.select("node_id", F.col("parent").alias("far"),
                                   F.least("node_id", "parent").alias("component")), "loops")
    rows = at.count()
    for _ in range(math.ceil(math.log2(max(2, rows)))):
        jump = at.select(F.col("node_id").alias("far"), F.col("far").alias("next"),
                         F.col("component").alias("beyond"))
        at = materialize(at.join(by_rows(jump, rows), "far").select(
            "node_id", F.col("next").alias("far"), F.least("component", "beyond").alias("component")), "loops")
    ends = at.select(F.col("far").alias("node_id")).distinct()
    return at.join(by_rows(ends, rows), "node_id", "left_semi").select("node_id", "component")


def _by_color(links: DataFrame, anchors: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that need no further look, and the components among them.

    ``anchors(node_id)`` have several parents each; every other node hangs below one of them
    (``chains``), or below a cycle that is known already.
    """
    # Every frame here is at most as large as the edges.
    rows = links.count()
    above = chains.select(F.col("node_id").alias("parent"), "anchor")
    short = anchors.withColumnRenamed("node_id", "child").join(by_rows(links, rows), "child").join(
        by_rows(above, rows), "parent", "left")
    short = materialize(short.select("child", F.coalesce("anchor", "parent").alias("parent")).join(
        by_rows(anchors, rows).withColumnRenamed("node_id", "parent"), "parent", "left_semi").distinct(), "cycle-short")
    color = _spread(anchors.select("node_id", F.col("node_id").alias("color")), short)
    named = color.withColumnRenamed("node_id", "child").withColumnRenamed("color", "child_color")
    within = materialize(short.join(by_rows(named, rows), "child").join(
        by_rows(color, rows).withColumnRenamed("node_id", "parent"), "parent").where(
        "color = child_color").select(F.col("parent").alias("child"), F.col("child").alias("parent"), "color"),
        "cycle-colors")
    owners = color.where("node_id = color").select("node_id")
    # Against the edges from the owner, within its color; a link to itself counts.
    reached = graph.reachable(within.select("child", "parent"), owners)
    looped = reached.join(by_rows(within.select(F.col("parent").alias("node_id")), rows), "node_id", "left_semi")
    core = materialize(looped.join(by_rows(color, rows), "node_id").select("node_id", F.col("color").alias("component")), "cycle-core")
    # An owner without a way back is on no cycle. Nodes that hang below a core may lie on it too: those
    # from which a way leads back into it.
    hanging = chains.join(by_rows(core, rows).withColumnRenamed("node_id", "anchor"), "anchor").select("node_id", "component")
    members = materialize(core.unionByName(hanging), "cycle-members")
    child = members.select(F.col("node_id").alias("child"), F.col("component").alias("child_component"))
    parent = members.select(F.col("node_id").alias("parent"), "component")
    inner = links.join(by_rows(child, rows), "child").join(by_rows(parent, rows), "parent").where("component = child_component")
    back = graph.levels(members.select("node_id"), inner.select(
        F.col("parent").alias("child"), F.col("child").alias("parent"))).where("level IS NULL")
    kept = members.join(by_rows(back, rows), "node_id", "left_semi").select("node_id", "component")
    least = kept.groupBy("component").agg(F.min("node_id").alias("least"))
    components = materialize(kept.join(by_rows(least, rows), "component").select("node_id", F.col("least").alias("component")),
                             "cycle-components")
    done = members.select("node_id").union(owners).distinct()
    below = chains.join(by_rows(owners, rows).withColumnRenamed("node_id", "anchor"), "anchor", "left_semi").select(
        "node_id")
    return materialize(done.union(below).distinct(), "cycle-done"), components


def _spread(color: DataFrame, links: DataFrame) -> DataFrame:
    """The least color among all nodes that reach a node; only what changed goes on."""
    color = materialize(color, "color")
    changed, total = color, color.count()
    while rows := changed.count():
        offer = changed.select(F.col("node_id").alias("parent"), F.col("color").alias("offer"))
        offered = links.join(by_rows(offer, rows), "parent").groupBy(F.col("child").alias("node_id")).agg(
            F.min("offer").alias("offer"))
        after = materialize(color.join(by_rows(offered, total), "node_id", "left").select(
            "node_id", F.least("color", "offer").alias("color"), (F.col("offer") < F.col("color")).alias("less")), "color")
        color, changed = after.select("node_id", "color"), after.where("less").select("node_id", "color")
    return color


def name_cycle(members: DataFrame, edges: DataFrame) -> list[str]:
    """Nodes of one cycle, each the parent of the one before it; the first is also the last.

    Follows the least parent of each node of the first component; long cycles are cut after
    ``SHOWN`` nodes.
    """
    first = members.agg(F.min("component")).first()[0]
    if first is None:
        return []
    inside = members.where(F.col("component") == F.lit(first)).select("node_id")
    links = _between(edges, inside)
    single = materialize(links.groupBy(F.col("child").alias("node_id")).agg(F.min("parent").alias("parent")), "cycle-one")
    loop = _loops(single)
    one = loop.where(F.col("component") == F.lit(loop.agg(F.min("component")).first()[0]))
    way = {r["node_id"]: r["parent"] for r in single.join(one, "node_id", "left_semi").orderBy("node_id").take(1)}
    names = list(way)
    while len(names) <= SHOWN:
        above = way.get(names[-1]) or single.where(F.col("node_id") == F.lit(names[-1])).first()["parent"]
        names.append(above)
        if above == names[0]:
            return names
    return [*names, "..."]
