import random
from graphlib import CycleError, TopologicalSorter

import pytest
from pyspark.sql import functions as F

from landspan import workspace
from landspan.operators import cycles, graph
from landspan.operators.recursion import recursive_union
from landspan.plans import freshness

NODES = "node_id string, kind string"
EDGES = "child string, parent string"
OWNED = "node_id string, schema string, name string, type string"


def _nodes(spark, ids):
    return spark.createDataFrame([(i, "source") for i in ids], NODES)


def _levels(spark, ids, edges):
    found = graph.levels(_nodes(spark, ids), spark.createDataFrame(edges, EDGES)).collect()
    return {r["node_id"]: r["level"] for r in found}


@pytest.mark.parametrize("ids, edges, want", [
    ([], [], {}),
    (["a"], [], {"a": 0}),
    (["a", "b", "c"], [("b", "a"), ("c", "b")], {"a": 0, "b": 1, "c": 2}),
    (["a", "b", "c", "d"], [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "a")],
     {"a": 0, "b": 1, "c": 1, "d": 2}),
    (["a", "b", "r"], [("a", "b"), ("b", "a")], {"a": None, "b": None, "r": 0}),
    (["a", "b"], [("a", "a"), ("b", "a")], {"a": None, "b": None}),
    (["a", "b"], [("b", "a"), ("b", "a")], {"a": 0, "b": 1}),
])
def test_levels(spark, ids, edges, want):
    assert _levels(spark, ids, edges) == want


def test_levels_are_a_topological_order_of_a_random_graph(spark):
    rng = random.Random(3)
    ids = [str(i) for i in range(60)]
    edges = [(str(i), str(rng.randrange(i))) for i in range(1, 60) for _ in range(rng.randrange(4))]
    found = _levels(spark, ids, edges)
    assert all(found[c] > found[p] for c, p in edges)
    order = sorted(ids, key=lambda i: (found[i], i))
    sorter = TopologicalSorter({i: {p for c, p in edges if c == i} for i in ids})
    assert set(sorter.static_order()) == set(order)


def _brute_levels(ids, edges):
    """Longest way from above by repeated relaxation; None where it never ends."""
    parents = {i: {p for c, p in edges if c == i} for i in ids}
    found = {}
    while True:
        more = {i: 1 + max((found[p] for p in ps), default=-1) for i, ps in parents.items()
                if i not in found and all(p in found for p in ps)}
        if not more:
            return {i: found.get(i) for i in ids}
        found |= more


@pytest.mark.parametrize("seed, parents, span", [(1, 1, 3), (2, 2, 2), (3, 3, 40), (4, 2, 6)])
def test_levels_with_chains_cycles_and_unknown_parents(spark, seed, parents, span):
    rng = random.Random(seed)
    ids = [str(i) for i in range(90)]
    edges = [(str(i), str(max(0, i - rng.randint(1, span))))
             for i in range(1, 90) for _ in range(rng.randint(0 if rng.random() < 0.1 else 1, parents))]
    # A cycle of single parents with a tail, a cycle through a node of several, a parent that is no node.
    more = ["u", "v", "w", "tail", "m", "n", "orphan", "below"]
    edges += [("u", "v"), ("v", "w"), ("w", "u"), ("tail", "u"), ("m", "n"), ("n", "m"), ("n", "5"),
              ("orphan", "nobody"), ("below", "orphan"), ("below", "3"), ("stranger", "3")]
    assert _levels(spark, ids + more, edges) == _brute_levels(ids + more, edges)


def test_levels_broadcast_no_table_of_nodes(spark, monkeypatch, capsys):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 100)
    joined = []
    append = workspace.Rounds.append
    monkeypatch.setattr(workspace.Rounds, "append", lambda self, df: joined.append(df) or append(self, df))
    k = spark.range(1, 3001).withColumnRenamed("id", "k")
    links = k.where("k > 3").selectExpr("cast(k as string) child", "explode(array(k div 2, k div 3)) p").selectExpr(
        "child", "cast(p as string) parent")
    found = graph.levels(k.selectExpr("cast(k as string) node_id"), links)
    found.explain()
    want = {}
    for i in range(1, 3001):
        want[i] = 0 if i <= 3 else 1 + max(want[i // 2], want[i // 3])
    assert {int(r.node_id): r.level for r in found.collect()} == want
    assert "Broadcast" not in capsys.readouterr().out
    for df in joined:  # rounds of 100 nodes and more
        if df.count() > 1000:
            df.explain()
            assert "Broadcast" not in capsys.readouterr().out


def test_components_with_shuffled_joins_only(spark, monkeypatch):
    monkeypatch.setattr(workspace, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cycles, "FINISH", 0)
    rng = random.Random(11)
    ids = [f"n{i}" for i in range(25)]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(45)]
    found = cycles.on_cycles(_nodes(spark, ids), spark.createDataFrame(edges, EDGES))
    assert {r.node_id: r.component for r in found.collect()} == _brute_components(edges)


def test_levels_of_a_long_chain(spark):
    nodes = spark.range(600).select(F.col("id").cast("string").alias("node_id"), F.lit("source").alias("kind"))
    edges = spark.range(1, 600).select(
        F.col("id").cast("string").alias("child"), (F.col("id") - 1).cast("string").alias("parent"))
    found = graph.levels(nodes, edges)
    assert found.count() == found.where("level = int(node_id)").count() == 600


def test_acyclic_check(spark):
    nodes = _nodes(spark, ["a", "b", "c"])
    with pytest.raises(ValueError, match="a <- b <- a"):
        graph.require_acyclic(nodes, spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b")], EDGES))
    with pytest.raises(ValueError, match="no node, for example \\['b', 'c'\\]"):
        graph.require_acyclic(nodes, spark.createDataFrame([("b", "z"), ("c", "b")], EDGES))
    graph.require_acyclic(nodes, spark.createDataFrame([("b", "a"), ("c", "b")], EDGES))
    with pytest.raises(CycleError):
        tuple(TopologicalSorter({"a": {"b"}, "b": {"a"}}).static_order())


def _brute_components(edges):
    reach = {(p, c) for c, p in edges}
    while True:
        more = {(a, d) for a, b in reach for c, d in edges_of(reach, b)} - reach
        if not more:
            break
        reach |= more
    on = {a for a, b in reach if a == b}
    return {a: min(b for b in on if (a, b) in reach and (b, a) in reach) for a in on}


def edges_of(reach, node):
    return [(a, b) for a, b in reach if a == node]


@pytest.mark.parametrize("seed, n, share, finish", [
    (1, 24, 1.2, 0), (3, 25, 2.0, 9999), (5, 60, 1.3, 9999)])
def test_components_of_random_graphs(spark, monkeypatch, seed, n, share, finish):
    """0: everything is colored; else one task finishes."""
    monkeypatch.setattr(cycles, "FINISH", finish)
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(n)]
    edges = [(rng.choice(ids), rng.choice([*ids, "missing"])) for _ in range(int(n * share))]
    found = cycles.on_cycles(_nodes(spark, ids), spark.createDataFrame(edges, EDGES)).collect()
    assert {r.node_id: r.component for r in found} == _brute_components(
        [(c, p) for c, p in edges if p != "missing"])
    assert len(found) == len({r.node_id for r in found})


def test_a_long_cycle_with_tails_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(cycles, "FINISH", 0)
    ring = [(f"r{i:03}", f"r{(i + 1) % 60:03}") for i in range(60)]
    tail = [("t0", "r007"), ("t1", "t0"), ("r009", "u0"), ("u0", "u1")]
    ids = [c for c, _ in ring] + ["t0", "t1", "u0", "u1"]
    nodes, edges = _nodes(spark, ids), spark.createDataFrame(ring + tail, EDGES)
    members = cycles.on_cycles(nodes, edges)
    assert {(r.node_id, r.component) for r in members.collect()} == {(c, "r000") for c, _ in ring}
    named = cycles.name_cycle(members, edges)
    assert named == [f"r{i:03}" for i in range(cycles.SHOWN + 1)] + ["..."]


SHELVES = ["attic.box", "cellar.rack.1", "cellar.rack.20", "cellar.wine", "hall.rack"]


@pytest.mark.parametrize("pattern, want", [
    ("*rack", ["hall.rack"]),
    ("cellar*1", ["cellar.rack.1"]),
    ("*.rack*", ["cellar.rack.1", "cellar.rack.20", "hall.rack"]),
    ("**", SHELVES),
    ("hall.rack", ["hall.rack"]),
    ("cellar", []),
    ("hall?rack", []),
    ("[ah]*", []),
    ("", []),
])
def test_select(spark, pattern, want):
    nodes = _nodes(spark, SHELVES[::-1])
    levels = graph.levels(nodes, spark.createDataFrame([], EDGES))
    picked = graph.in_order(graph.select_nodes(nodes, pattern), levels)
    assert [r["node_id"] for r in picked.collect()] == want


@pytest.mark.parametrize("pattern, error", [
    ("+a", NotImplementedError), ("a+", NotImplementedError), ("+a+", NotImplementedError),
    ("a+b", ValueError), ("++a", ValueError)])
def test_select_plus_raises(spark, pattern, error):
    with pytest.raises(error):
        graph.select_nodes(_nodes(spark, ["a"]), pattern)


def test_ownership(spark):
    owns = spark.createDataFrame(
        [("n1", "s", "t", "relation"), ("n2", "s", "t", "relation"), ("n1", "s", "f", "function"),
         ("n1", "s", "u", "relation")], OWNED)
    clash = graph.owner_conflicts(owns).collect()
    assert [(r["name"], r["owners"], r["first_owner"]) for r in clash] == [("t", 2, "n1")]
    deps = spark.createDataFrame(
        [("n3", "s", "u", "relation"), ("n3", "s", "u", "function"), ("n3", "s", "f", "function")], OWNED)
    assert [tuple(r) for r in graph.edges(deps, owns).collect()] == [("n3", "n1")]
    assert [tuple(r) for r in graph.missing_owners(deps, owns).collect()] == [("n3", "s", "u", "function")]
    assert [r[0] for r in graph.schemas(owns).collect()] == ["s"]
    twice = graph.duplicate_nodes(_nodes(spark, ["a", "b", "a"]))
    assert [tuple(r) for r in twice.collect()] == [("a", 2)]
    shown = graph.render(_nodes(spark, ["n1", "n3", "n9"]), deps, owns).collect()
    facts = {(r["node_id"], r["kind"], r["role"], r["object"]) for r in shown}
    assert ("n9", "S", "none", None) in facts and ("n1", "S", "output", "s.f") in facts
    assert ("n3", "S", "input", "s.u") in facts


def test_reachable_ends_on_cycles_and_keeps_hot_parents_whole(spark):
    edges = spark.range(5000).select(
        (F.col("id") + 1).cast("string").alias("child"), F.lit("0").alias("parent"))
    edges = edges.union(spark.createDataFrame([("0", "17"), ("x", "4000")], EDGES))
    found = graph.reachable(edges, spark.createDataFrame([("0",)], "node_id string"))
    assert found.count() == found.distinct().count() == 5002


def test_recursive_union_with_null_rows(spark):
    base = spark.createDataFrame([(1, None), (1, None), (2, "a")], "k int, t string")
    out = recursive_union(base, lambda f: f.select((F.col("k") + 2).alias("k"), "t").where("k < 8"))
    assert sorted((r["k"], r["t"] or "") for r in out.collect()) == [
        (1, ""), (2, "a"), (3, ""), (4, "a"), (5, ""), (6, "a"), (7, "")]


def _outdated(spark, ids, edges, runs):
    journal = spark.createDataFrame(runs, "node_id string, completed int")
    found = freshness.outdated(_nodes(spark, ids), spark.createDataFrame(edges, EDGES), journal)
    return sorted(r[0] for r in found.collect())


def test_outdated_rules(spark):
    chain = [("b", "a"), ("c", "b"), ("d", "c")]
    ids = ["a", "b", "c", "d"]
    fresh = [("a", 1), ("b", 2), ("c", 3), ("d", 3)]
    assert _outdated(spark, ids, chain, fresh) == []
    # A parent that ran later; everything below follows, the parent itself does not.
    assert _outdated(spark, ids, chain, [*fresh, ("a", 9)]) == ["b", "c", "d"]
    # Equal times are fresh, several runs count by the last one.
    assert _outdated(spark, ids, chain, [("a", 1), ("a", 5), ("b", 5), ("c", 5), ("d", 5)]) == []
    # Never run, and the journal row of a node that left the graph.
    assert _outdated(spark, ids, chain, [("a", 1), ("c", 3), ("d", 3), ("gone", 99)]) == ["b", "c", "d"]
    assert _outdated(spark, ids, chain, []) == ids


@pytest.mark.parametrize("seed, parents, loops", [(1, 3, 0), (2, 2, 3), (4, 2, 0)])
def test_reached_is_what_a_search_finds(spark, seed, parents, loops):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(50)]
    edges = [(ids[i], ids[rng.randrange(i)]) for i in range(1, 50) for _ in range(rng.randrange(parents + 1))]
    edges += [(rng.choice(ids), rng.choice(ids)) for _ in range(loops)] + [("n3", "missing")] * (seed == 4)
    first = rng.sample(ids, 4)
    found, front = set(first), set(first)
    while front:
        front = {c for c, p in edges if p in front} - found
        found |= front
    got = graph.reached(_nodes(spark, ids), spark.createDataFrame(edges, EDGES),
                        spark.createDataFrame([(i,) for i in first], "node_id string"))
    assert sorted(r.node_id for r in got.collect()) == sorted(found)


def test_worklist_limits_after_propagation_and_keeps_order(spark):
    nodes = _nodes(spark, ["z", "y", "x"])
    edges = spark.createDataFrame([("y", "z"), ("x", "y")], EDGES)
    levels = graph.levels(nodes, edges)
    journal = spark.createDataFrame([("y", 1), ("x", 1)], "node_id string, completed int")
    stale = freshness.outdated(nodes, edges, journal)
    picked = nodes.where("node_id <> 'z'")
    assert [r["node_id"] for r in freshness.worklist(picked, levels, stale).collect()] == ["y", "x"]
    forced = freshness.worklist(nodes, levels, None)
    assert [r["node_id"] for r in forced.collect()] == ["z", "y", "x"]
