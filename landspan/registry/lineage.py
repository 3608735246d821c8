"""Queries over script lineage: object events of orders, script texts of customers."""

from pyspark.sql import functions as F

from landspan.operators import script_events, script_text
from landspan.plans.derived import table
from landspan.plans.lineage import lineage

# What an order does in the script of its customer, by order key mod 14:
# (variant, offset, action, schema, temporary).
STEPS = [
    (0, 0, "create", "core", False),
    (1, 0, "begin", None, False), (1, 1, "create", "core", False), (1, 2, "commit", None, False),
    (2, 0, "begin", None, False), (2, 1, "create", "core", False), (2, 2, "drop", "core", False),
    (2, 3, "rollback", None, False),
    (3, 0, "drop", "core", False),
    (4, 0, "create", "temp", True), (4, 1, "reference", "temp", False),
    (5, 0, "insert", "core", False), (5, 0, "reference", "raw", False),
    (6, 0, "reference", "core", False), (6, 0, "reference", "raw", False),
    (7, 0, "analyze", "core", False),
    (8, 0, "begin", None, False), (8, 1, "insert", "core", False), (8, 2, "drop", "core", False),
    (8, 3, "commit", None, False),
    (9, 0, "begin", None, False), (9, 1, "create", "core", False), (9, 2, "drop", "core", False),
    (9, 3, "commit", None, False),
    (10, 0, "alter", "core", False),
    (11, 0, "update", "core", False), (11, 0, "reference", "raw", False),
    (12, 0, "begin", None, False), (12, 1, "create", "core", False), (12, 2, "update", "core", False),
    (12, 3, "rollback", None, False),
    (13, 0, "begin", None, False), (13, 1, "create", "core", False), (13, 2, "insert", "core", False),
    (13, 3, "commit", None, False),
]
STEPS_DDL = "variant int, off int, action string, schema string, temp boolean"


def _events(spark, folder):
    steps = spark.createDataFrame(STEPS, STEPS_DDL)
    k = F.col("o_orderkey")
    has_object = F.col("schema").isNotNull()
    return table(spark, folder, "orders").join(steps, k % 14 == F.col("variant")).select(
        F.col("o_custkey").alias("script_id"), (k * 10 + F.col("off")).alias("stmt"), "action", "schema",
        F.when(has_object, F.concat(F.lit("o"), F.expr("o_orderkey DIV 14 % 3"))).alias("name"),
        F.when(has_object, F.lit("relation")).alias("type"), "temp",
    )


def f_transactions(spark, folder):
    return script_events.transactions(_events(spark, folder)).select(
        "script_id", "stmt", "action", "tx", "outcome"
    ).distinct()


def f_created(spark, folder):
    return script_events.created(script_events.transactions(_events(spark, folder)))


def f_dependencies(spark, folder):
    return script_events.dependencies(script_events.transactions(_events(spark, folder)))


def f_rules(spark, folder):
    return script_events.rule_violations(script_events.transactions(_events(spark, folder)))


def f_transaction_errors(spark, folder):
    """Orders open or close at random: nested, unopened and unclosed transactions."""
    k = F.col("o_orderkey")
    action = F.when(k % 3 == 0, "begin").when(k % 3 == 1, "commit").otherwise("rollback")
    events = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("script_id"), k.alias("stmt"), action.alias("action")
    )
    return script_events.transaction_errors(events)


# Script of a customer by key mod 7; {k} its key, {r} key mod 5, {n} its nation.
TEXTS = [
    "-- drop table x;\ncreate table core.t{k} as\n  select * from raw.s{r} a join raw.n{n} using (id);",
    "begin; create view v{k} as with c as (select * from raw.s{r}) select * from c; rollback;",
    "create temp table tmp{k} as select count(*) as n from raw.s{r};"
    " create table core.t{k} as select lib.f{r}(n) as x, st_area(g) from tmp{k};",
    "alter table old{k} add column x int;",
    "insert into core.log (id, note) select id, 'from nowhere; x' from raw.s{r};",
    "create or replace function lib.fn{k}() returns int as $$ select max(id) from raw.s{r} $$ language sql;",
    "create table core.t{k} (id int); insert into core.t{k} (id) select id from s{r}, raw.n{n} x;"
    " create index on core.t{k} (id); drop table core.t{k};",
]


def _scripts(spark, folder):
    customer = table(spark, folder, "customer")
    text = F.get(F.array(*[F.lit(t) for t in TEXTS]), (F.col("c_custkey") % len(TEXTS)).cast("int"))
    for mark, value in (("{k}", F.col("c_custkey")), ("{r}", F.col("c_custkey") % 5),
                        ("{n}", F.col("c_nationkey"))):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return customer.select(F.col("c_custkey").cast("string").alias("script_id"), text.alias("sql"))


def f_statements(spark, folder):
    return script_text.statements(_scripts(spark, folder)).select("script_id", "stmt", "kind")


def f_relations(spark, folder):
    return script_text.relation_references(script_text.statements(_scripts(spark, folder)))


def f_functions(spark, folder):
    builtins = script_text.builtin_functions(spark)
    return script_text.function_references(script_text.statements(_scripts(spark, folder)), builtins)


def f_lineage(spark, folder):
    return lineage(_scripts(spark, folder))[0]


def f_lineage_errors(spark, folder):
    return lineage(_scripts(spark, folder))[1]


QUERIES = {f.__name__: f for f in (
    f_transactions, f_created, f_dependencies, f_rules, f_transaction_errors, f_statements,
    f_relations, f_functions, f_lineage, f_lineage_errors,
)}


def _values(rows) -> str:
    def spell(value):
        return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else str(value)

    return ", ".join(f"({', '.join(map(spell, row))})" for row in rows)


_EVENTS = f"""
    steps(variant, off, action, schema, temp) AS (VALUES {_values(STEPS)}),
    ev AS (SELECT o_custkey AS script_id, o_orderkey * 10 + off AS stmt, action, schema, temp,
        CASE WHEN schema IS NOT NULL THEN 'o' || (o_orderkey // 14 % 3) END AS name,
        CASE WHEN schema IS NOT NULL THEN 'relation' END AS type
        FROM orders JOIN steps ON o_orderkey % 14 = variant),
    ctl AS (SELECT script_id, stmt, action, lead(action) OVER w AS ends, lead(stmt) OVER w AS until
        FROM ev WHERE action IN ('begin', 'commit', 'rollback')
        WINDOW w AS (PARTITION BY script_id ORDER BY stmt)),
    txs AS (SELECT script_id, stmt AS tx, until, ends AS outcome FROM ctl WHERE action = 'begin'),
    sp AS (SELECT ev.*, tx, outcome FROM ev LEFT JOIN txs
        ON txs.script_id = ev.script_id AND ev.stmt BETWEEN tx AND until),
    made AS (SELECT * FROM sp WHERE action = 'create' AND NOT temp),
    kept AS (SELECT * FROM made WHERE tx IS NULL OR outcome = 'commit'),
    seen AS (SELECT s.*,
        EXISTS (FROM kept c WHERE c.script_id = s.script_id AND c.schema = s.schema
            AND c.name = s.name AND c.stmt < s.stmt) AS kept_before,
        EXISTS (FROM made c WHERE c.script_id = s.script_id AND c.schema = s.schema
            AND c.name = s.name AND c.stmt < s.stmt AND c.tx = s.tx) AS tx_before
        FROM sp s)"""
_SAME = "(script_id, schema, name)"
_SCRIPTS = """s AS (SELECT CAST(c_custkey AS VARCHAR) AS script_id, c_custkey % 7 AS v,
    CAST(c_custkey AS VARCHAR) AS k, 's' || (c_custkey % 5) AS r, 'f' || (c_custkey % 5) AS f,
    'n' || c_nationkey AS n FROM customer)"""
_KINDS = [
    (0, 0, "create_table"), (1, 0, "begin"), (1, 1, "create_view"), (1, 2, "rollback"),
    (2, 0, "create_temp"), (2, 1, "create_table"), (3, 0, "alter"), (4, 0, "insert"),
    (5, 0, "create_function"), (6, 0, "create_table"), (6, 1, "insert"), (6, 2, "create_index"),
    (6, 3, "drop"),
]
ORACLES = {
    "f_transactions": f"""WITH {_EVENTS} SELECT DISTINCT script_id, stmt, action, tx, outcome FROM sp""",
    "f_created": f"""WITH {_EVENTS} SELECT DISTINCT script_id, schema, name, type FROM kept
        WHERE {_SAME} NOT IN (SELECT {_SAME} FROM seen WHERE action = 'drop'
            AND ((tx IS NULL AND kept_before) OR (tx_before AND outcome = 'commit')))""",
    "f_dependencies": f"""WITH {_EVENTS} SELECT DISTINCT script_id, schema, name, type FROM seen
        WHERE (action IN ('reference', 'analyze')
            OR (action = 'insert' AND NOT kept_before AND NOT tx_before))
        AND {_SAME} NOT IN (SELECT {_SAME} FROM kept)
        AND {_SAME} NOT IN (SELECT {_SAME} FROM sp WHERE action = 'create' AND temp)""",
    "f_rules": f"""WITH {_EVENTS} SELECT script_id, stmt,
        action || ' of an object not created before' AS reason FROM seen
        WHERE action IN ('alter', 'update') AND NOT kept_before AND NOT tx_before""",
    "f_transaction_errors": """
        WITH ctl AS (SELECT o_custkey AS script_id, o_orderkey AS stmt,
            CASE o_orderkey % 3 WHEN 0 THEN 'begin' WHEN 1 THEN 'commit' ELSE 'rollback' END AS action
            FROM orders),
        near AS (SELECT *, lag(action) OVER w AS before, lead(action) OVER w AS after FROM ctl
            WINDOW w AS (PARTITION BY script_id ORDER BY stmt))
        SELECT script_id, stmt, 'begin inside a transaction' AS reason FROM near
            WHERE action = 'begin' AND before = 'begin'
        UNION ALL SELECT script_id, stmt, 'transaction is never closed' FROM near
            WHERE action = 'begin' AND after IS NULL
        UNION ALL SELECT script_id, stmt, action || ' outside a transaction' FROM near
            WHERE action <> 'begin' AND (before IS NULL OR before <> 'begin')""",
    "f_statements": f"""WITH {_SCRIPTS}, kinds(v, stmt, kind) AS (VALUES {_values(_KINDS)})
        SELECT script_id, CAST(stmt AS BIGINT) AS stmt, kind FROM s JOIN kinds USING (v)""",
    "f_relations": f"""WITH {_SCRIPTS},
        refs AS (
            SELECT script_id, 0 AS stmt, 'raw' AS schema, r AS name FROM s WHERE v IN (0, 2, 4, 5)
            UNION ALL SELECT script_id, 0, 'raw', n FROM s WHERE v = 0
            UNION ALL SELECT script_id, 1, 'raw', r FROM s WHERE v = 1
            UNION ALL SELECT script_id, 1, '', 'tmp' || k FROM s WHERE v = 2
            UNION ALL SELECT script_id, 1, '', r FROM s WHERE v = 6
            UNION ALL SELECT script_id, 1, 'raw', n FROM s WHERE v = 6)
        SELECT script_id, CAST(stmt AS BIGINT) AS stmt, schema, name, 'relation' AS type FROM refs""",
    "f_functions": f"""WITH {_SCRIPTS}
        SELECT script_id, 1::BIGINT AS stmt, 'lib' AS schema, f AS name, 'function' AS type
        FROM s WHERE v = 2""",
    "f_lineage": f"""WITH {_SCRIPTS},
        found AS (
            SELECT script_id, 'created' AS role, 'core' AS schema, 't' || k AS name FROM s WHERE v IN (0, 2)
            UNION ALL SELECT script_id, 'created', 'lib', 'fn' || k FROM s WHERE v = 5
            UNION ALL SELECT script_id, 'dependency', 'raw', r FROM s WHERE v IN (0, 1, 2, 4, 5)
            UNION ALL SELECT script_id, 'dependency', 'raw', n FROM s WHERE v IN (0, 6)
            UNION ALL SELECT script_id, 'dependency', 'lib', f FROM s WHERE v = 2
            UNION ALL SELECT script_id, 'dependency', 'core', 'log' FROM s WHERE v = 4
            UNION ALL SELECT script_id, 'dependency', '', r FROM s WHERE v = 6)
        SELECT *, CASE WHEN schema = 'lib' THEN 'function' ELSE 'relation' END AS type FROM found""",
    "f_lineage_errors": f"""WITH {_SCRIPTS} SELECT script_id, 0::BIGINT AS stmt,
        'alter of an object not created before' AS reason FROM s WHERE v = 3""",
}
