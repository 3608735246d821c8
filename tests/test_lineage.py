"""Created and required objects per script, one run over all scripts as a table."""

import pytest

from landspan.plans.lineage import lineage

R, FN = "relation", "function"

# script id -> (sql, created, dependencies); None stands for a script with a violation.
CASES = {
    # One case for each rule, in the order of the rules, then some that combine them.
    "f1_comments_and_quoted_marks": (
        """/* drop table orders; */ create table ops.parcels as select ';' as mark, a.* from ops.inbox a
        -- create table ops.never as select 1;
        ;;""",
        {("ops", "parcels", R)}, {("ops", "inbox", R)},
    ),
    "f2_joins_of_all_kinds": (
        """create view ops.late as select p.id from ops.parcels p left join ops.routes using (route)
        cross join lateral (select max(day) as day from ops.days) d where exists
        (select 1 from depot.shift s where s.id = p.shift)""",
        {("ops", "late", R)},
        {("ops", "parcels", R), ("ops", "routes", R), ("ops", "days", R), ("depot", "shift", R)},
    ),
    "f2_from_lists": (
        """create table ops.q as select * from (select 1 from depot.a) q, depot.b;
        create table ops.r as select * from depot.c join depot.d using (id), depot.e;
        create table ops.s as select * from depot.f join depot.g on f.x = (g.y + 1), depot.h;
        create table ops.t as select * from generate_series(1, 3) n, depot.i;
        create table ops.u as select * from depot.j as k (c1, c2), depot.l;
        create table ops.v as select * from (depot.m join depot.n using (id)) where m.x in (1, 2);
        create table ops.w as table depot.o;""",
        {("ops", n, R) for n in "qrstuvw"}, {("depot", n, R) for n in "abcdefghijlmno"},
    ),
    "f3_cte_hides_only_bare_names": (
        """create table ops.sums as with parcels as (select * from ops.parcels), k as (select 1)
        select * from parcels, k, depot.k""",
        {("ops", "sums", R)}, {("ops", "parcels", R), ("depot", "k", R)},
    ),
    "f4_calls": (
        """create table ops.cost as select tariff.price(weight, zone_of(to_depot)), round(x, 2),
        st_length(path), "ST_Odd"(path) from ops.parcels""",
        {("ops", "cost", R)},
        {("ops", "parcels", R), ("tariff", "price", FN), ("", "zone_of", FN), ("", "ST_Odd", FN)},
    ),
    "f5_two_transactions": (
        """begin; create table ops.kept as select 1 from depot.a; commit;
        start transaction; create table ops.lost as select 1 from depot.b; rollback""",
        {("ops", "kept", R)}, {("depot", "a", R), ("depot", "b", R)},
    ),
    "f6_drop_of_two": (
        """create table ops.x as select 1 from depot.a; create view ops.y as select 1 from depot.b;
        create view ops.z as select 1 from ops.y; drop view if exists ops.z, ops.y cascade""",
        {("ops", "x", R)}, {("depot", "a", R), ("depot", "b", R)},
    ),
    "f7_read_before_written": (
        """create temporary view recent as select * from ops.days; create table ops.b as select * from
        ops.a, recent; create table ops.a as select * from depot.c""",
        {("ops", "b", R), ("ops", "a", R)}, {("ops", "days", R), ("depot", "c", R)},
    ),
    "f8_statistics_and_settings": (
        "set work_mem to '1GB'; analyze ops.parcels; create unique index on ops.parcels (id)",
        set(), {("ops", "parcels", R)},
    ),
    "f8_alter_of_a_temporary": (
        "create temp table t as select 1 from depot.a; alter table t add column n int", None, None,
    ),
    "f8_update_of_another": ("update ops.parcels set day = null where id = 4", None, None),
    "function_over_own_table": (
        """create table ops.legs (parcel int, stop int);
        create function ops.stops(p int) returns bigint as $body$
          select count(*) from ops.legs join depot.stop on stop.id = legs.stop
          where parcel = p $body$ language sql;
        update ops.legs set stop = d.id from depot.alias d where d.old = stop""",
        {("ops", "legs", R), ("ops", "stops", FN)}, {("depot", "stop", R), ("depot", "alias", R)},
    ),
    "insert_foreign": (
        "insert into core.t (id) select id from d;", set(), {("core", "t", R), ("", "d", R)},
    ),
    "insert_no_columns": ("insert into core.t select id from d;", None, None),
    "own_function_call": (
        "create table t as select lib.score(x, my_fn(y)) as s from a, b as c, raw.e f;",
        {("", "t", R)},
        {("lib", "score", FN), ("", "my_fn", FN), ("", "a", R), ("", "b", R), ("raw", "e", R)},
    ),
    "noise": (
        """create table t as select extract(year from ts) as y, 'from fake; x' as s,
        cast(v as numeric(10, 2)) as w from d where a is distinct from b;
        /* create table u as select 1 from fake2; */ set search_path to x;""",
        {("", "t", R)}, {("", "d", R)},
    ),
    "quoted": (
        'create table "My Schema"."T 1" as select * from raw."Odd Name" o join "x" on true;',
        {("My Schema", "T 1", R)}, {("raw", "Odd Name", R), ("", "x", R)},
    ),
    "drop_then_again": (
        "create table t as select 1 from d; drop table t; create table t as select 1 from d;",
        set(), {("", "d", R)},
    ),
    "outer_create_inner_drop": (
        "create table t as select 1 from d; begin; drop table t; commit;",
        {("", "t", R)}, {("", "d", R)},
    ),
    "body_with_semicolon_text": (
        "create function f() returns int as $x$ select n from d where s = ';' $x$ language sql;"
        " create table u as select 1 from e;",
        {("", "f", FN), ("", "u", R)}, {("", "d", R), ("", "e", R)},
    ),
    "unclosed": ("begin; create table t as select 1 from d;", None, None),
    "nested": ("begin; begin; commit;", None, None),
    "commit_alone": ("commit;", None, None),
    "alter_temp": ("create temp table t as select 1 from d; alter table t add x int;", None, None),
    "foreign_key": (
        "create table t (id int references core.u(id), name varchar(20));",
        {("", "t", R)}, {("core", "u", R)},
    ),
    "subquery": (
        "create table t as select * from (select id from raw.a where id in (select id from b)) q;",
        {("", "t", R)}, {("raw", "a", R), ("", "b", R)},
    ),
    "empty": ("  ;; -- nothing\n", set(), set()),
}


@pytest.fixture(scope="module")
def result(spark):
    rows = [(name, case[0]) for name, case in CASES.items()]
    objects, errors = lineage(spark.createDataFrame(rows, "script_id string, sql string"))
    return objects.collect(), errors.collect()


@pytest.mark.parametrize("name", CASES)
def test_script(name, result):
    objects, errors = result
    _, made, needs = CASES[name]
    reasons = [row["reason"] for row in errors if row["script_id"] == name]
    if made is None:
        assert reasons
        assert not [row for row in objects if row["script_id"] == name]
        return
    assert not reasons
    found = {"created": set(), "dependency": set()}
    for row in objects:
        if row["script_id"] == name:
            found[row["role"]].add((row["schema"], row["name"], row["type"]))
    assert found["created"] == made
    assert found["dependency"] == needs


def test_very_long_scripts(spark):
    """Long literals, lists, parameters and many statements in one text."""
    many = " ".join(f"create table t{i} as select * from raw.s{i % 7};" for i in range(5000))
    listed = ", ".join(f"a{i} x{i}" for i in range(800))
    texts = {
        "many": many,
        "literal": "create table t as select '" + "it''s; " * 100_000 + "' as x from d;",
        "list": f"create table t as select * from {listed};",
        "in": "create table t as select * from d where k in (" + ", ".join(map(str, range(50_000))) + ");",
        "params": "create table t as select * from d where k in (" + ", ".join(["$1"] * 20_000) + ");",
        "comment": "/* " + "x; " * 200_000 + "*/ create table t as select 1 from d;",
    }
    objects, errors = lineage(spark.createDataFrame(list(texts.items()), "script_id string, sql string"))
    assert errors.isEmpty()
    counts = {(r["script_id"], r["role"]): r["count"] for r in objects.groupBy("script_id", "role").count().collect()}
    assert counts[("many", "created")] == 5000 and counts[("many", "dependency")] == 7
    assert counts[("list", "dependency")] == 800
    for name in ("literal", "in", "params", "comment"):
        assert counts[(name, "created")] == counts[(name, "dependency")] == 1
