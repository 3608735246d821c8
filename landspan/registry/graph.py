"""Queries over dependency graphs."""

from pyspark.sql import functions as F

from landspan.operators import cycles, graph
from landspan.operators.recursion import recursive_union
from landspan.plans import derived
from landspan.plans.derived import table


def _parts(spark, folder):
    """A node per part, with two parents each: k div 2 and k div 3."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    nodes = part.select(F.col("k").cast("string").alias("node_id"), F.lit("source").alias("kind"))
    edges = None
    for divisor in (2, 3):
        more = part.where("k > 1 AND k % 5 <> 0").select(
            F.col("k").cast("string").alias("child"),
            F.expr(f"k DIV {divisor}").cast("string").alias("parent"),
        )
        edges = more if edges is None else edges.union(more)
    return nodes, edges.where("child <> parent")


def g_levels(spark, folder):
    return graph.levels(*_parts(spark, folder))


def g_chain(spark, folder):
    """All parts in one chain in order of their keys, broken only where a key is missing."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    ids = part.select(F.col("k").cast("string").alias("node_id"), F.lit("source").alias("kind"))
    links = part.select("k", (F.col("k") - 1).alias("above")).join(
        part.select(F.col("k").alias("above")), "above", "left_semi").select(
        F.col("k").cast("string").alias("child"), F.col("above").cast("string").alias("parent"))
    return graph.levels(ids, links)


def g_cycles(spark, folder):
    """Nodes on or below a cycle; component where they are on one."""
    nodes, edges = _parts(spark, folder)
    # Every key that is 7 mod 50 also waits for a node below itself.
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    back = part.where("k % 50 = 7").select(
        F.expr("CAST(k DIV 2 AS STRING)").alias("child"), F.col("k").cast("string").alias("parent")
    )
    links = edges.union(back)
    found = graph.levels(nodes, links)
    return found.where("level IS NULL").select("node_id").join(
        cycles.on_cycles(nodes, links, found), "node_id", "left")


def e_recursive(spark, folder):
    """Pairs (id, ancestor) of every user: the recursive UNION of a table function."""
    events = table(spark, folder, "events").select("user_id").distinct()
    edges = derived.halving_edges(events, "user_id")
    start = events.select(
        F.col("user_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("ancestor")
    )

    def up(frontier):
        return frontier.join(edges, F.col("ancestor") == F.col("child")).select(
            "id", F.col("parent").alias("ancestor")
        )

    return recursive_union(start, up)


def g_edges(spark, folder):
    _, owns, deps = derived.key_objects(spark, folder)
    return graph.edges(deps, owns)


def g_missing_owner(spark, folder):
    _, owns, deps = derived.key_objects(spark, folder)
    return graph.missing_owners(deps, owns.where("name NOT LIKE '%7'"))


def g_duplicates(spark, folder):
    # Node ids of line items repeat: a line number is not unique within its order.
    items = table(spark, folder, "lineitem")
    nodes = items.select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("node_id"))
    return graph.duplicate_nodes(nodes)


def g_owner_conflicts(spark, folder):
    items = table(spark, folder, "lineitem")
    owns = items.select(
        F.concat(F.lit("order."), F.col("l_orderkey")).alias("node_id"),
        F.lit("part").alias("schema"), F.concat(F.lit("t"), F.col("l_partkey")).alias("name"),
        F.lit("relation").alias("type"),
    )
    return graph.owner_conflicts(owns)


def g_select(spark, folder):
    nodes, _, _ = derived.key_objects(spark, folder)
    return graph.select_nodes(nodes, "*er*.1*2")


def g_schemas(spark, folder):
    _, owns, _ = derived.key_objects(spark, folder)
    return graph.schemas(owns)


def g_render(spark, folder):
    return graph.render(*_render_inputs(spark, folder))


def _render_inputs(spark, folder):
    nodes, owns, deps = derived.key_objects(spark, folder)
    return nodes, deps, owns


QUERIES = {f.__name__: f for f in (
    g_levels, g_chain, g_cycles, e_recursive, g_edges, g_missing_owner, g_duplicates,
    g_owner_conflicts, g_select, g_schemas, g_render,
)}

_PARTS = """
    nodes AS (SELECT p_partkey AS k FROM part),
    edges AS (
        SELECT k AS child, k // 2 AS parent FROM nodes WHERE k > 1 AND k % 5 <> 0
        UNION
        SELECT k, k // 3 FROM nodes WHERE k > 1 AND k % 5 <> 0
    )"""
_OBJECTS = """
    nodes AS (
        SELECT 'region.' || r_regionkey AS node_id, 'source' AS kind, 'region' AS schema,
            't' || r_regionkey AS name, NULL AS need_schema, NULL AS need_name FROM region
        UNION ALL SELECT 'nation.' || n_nationkey, 'transform', 'nation', 't' || n_nationkey,
            'region', 't' || n_regionkey FROM nation
        UNION ALL SELECT 'customer.' || c_custkey, 'transform', 'customer', 't' || c_custkey,
            'nation', 't' || c_nationkey FROM customer
        UNION ALL SELECT 'orders.' || o_orderkey, 'custom', 'orders', 't' || o_orderkey,
            'customer', 't' || o_custkey FROM orders
    )"""
ORACLES = {
    "g_levels": f"""
        WITH RECURSIVE {_PARTS}, walk AS (
            SELECT k, 0 AS level FROM nodes WHERE k NOT IN (SELECT child FROM edges)
            UNION
            SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.k
        )
        SELECT CAST(k AS VARCHAR) AS node_id, CAST(max(level) AS INTEGER) AS level
        FROM walk GROUP BY k""",
    "g_chain": """
        WITH runs AS (SELECT p_partkey AS k, p_partkey - row_number() OVER (ORDER BY p_partkey) AS run FROM part)
        SELECT CAST(k AS VARCHAR) AS node_id, CAST(k - min(k) OVER (PARTITION BY run) AS INTEGER) AS level
        FROM runs""",
    "g_cycles": f"""
        WITH RECURSIVE {_PARTS}, links AS (
            SELECT child, parent FROM edges
            UNION SELECT k // 2, k FROM nodes WHERE k % 50 = 7
        ), reach AS (
            SELECT child AS k, parent AS above FROM links
            UNION SELECT r.k, l.parent FROM reach r JOIN links l ON l.child = r.above
        ), loops AS (SELECT k FROM reach WHERE k = above
        ), components AS (
            SELECT a.k, min(CAST(a.above AS VARCHAR)) AS component
            FROM reach a JOIN reach b ON b.k = a.above AND b.above = a.k GROUP BY a.k
        ), stuck AS (
            SELECT DISTINCT k FROM reach WHERE k IN (SELECT k FROM loops) OR above IN (SELECT k FROM loops)
        )
        SELECT CAST(k AS VARCHAR) AS node_id, component FROM stuck LEFT JOIN components USING (k)""",
    "e_recursive": """
        WITH RECURSIVE users AS (SELECT DISTINCT user_id AS n FROM events),
        edges AS (SELECT n AS child, n // 2 AS parent FROM users WHERE n % 3 <> 0 AND n > 1),
        walk AS (
            SELECT n AS id, n AS ancestor FROM users
            UNION
            SELECT w.id, e.parent FROM walk w JOIN edges e ON e.child = w.ancestor
        )
        SELECT CAST(id AS VARCHAR) AS id, CAST(ancestor AS VARCHAR) AS ancestor FROM walk""",
    "g_edges": f"""
        WITH {_OBJECTS}
        SELECT DISTINCT c.node_id AS child, p.node_id AS parent
        FROM nodes c JOIN nodes p ON p.schema = c.need_schema AND p.name = c.need_name""",
    "g_missing_owner": f"""
        WITH {_OBJECTS}
        SELECT DISTINCT c.node_id, c.need_schema AS schema, c.need_name AS name, 'relation' AS type
        FROM nodes c LEFT JOIN nodes p
            ON p.schema = c.need_schema AND p.name = c.need_name AND p.name NOT LIKE '%7'
        WHERE c.need_name IS NOT NULL AND p.name IS NULL""",
    "g_duplicates": """
        SELECT l_orderkey || '.' || l_linenumber AS node_id, count(*) AS uses
        FROM lineitem GROUP BY 1 HAVING count(*) > 1""",
    "g_owner_conflicts": """
        SELECT 'part' AS schema, 't' || l_partkey AS name, 'relation' AS type,
            count(*) AS claims, count(DISTINCT l_orderkey) AS owners,
            min('order.' || l_orderkey) AS first_owner, max('order.' || l_orderkey) AS last_owner
        FROM lineitem GROUP BY l_partkey HAVING count(*) > 1""",
    "g_select": f"""
        WITH {_OBJECTS} SELECT node_id, kind FROM nodes
        WHERE regexp_full_match(node_id, '.*er.*\\.1.*2')""",
    "g_schemas": f"WITH {_OBJECTS} SELECT DISTINCT schema FROM nodes",
    "g_render": f"""
        WITH {_OBJECTS}
        SELECT node_id, upper(left(kind, 1)) AS kind, 'output' AS role, schema || '.' || name AS object
        FROM nodes
        UNION ALL
        SELECT node_id, upper(left(kind, 1)), 'input', need_schema || '.' || need_name
        FROM nodes WHERE need_name IS NOT NULL""",
}
