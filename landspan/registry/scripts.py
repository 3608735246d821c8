"""Queries over SQL scripts and the statement forms they use."""

from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.functions.geometry import register_functions
from landspan.operators import transforms
from landspan.plans import derived
from landspan.plans.derived import table
from landspan.registry.common import scratch_schema


def _run(spark, folder, label, script):
    """Run a script with ``{s}`` as its schema and ``{orders}`` etc. as the given tables."""
    names = {n: f"parquet.`{folder}/{n}.parquet`" for n in
             ("region", "nation", "customer", "orders", "lineitem", "part", "events")}
    return transforms.run_script(spark, script.format(s=scratch_schema(spark, label), **names))


def e_script(spark, folder):
    return _run(spark, folder, "script", """
        -- several statements; the last one is the result
        create table {s}.big using parquet as select * from {orders} where o_totalprice > 200000;
        /* a snapshot; later changes of {s}.big do not show */
        create temp table big_snapshot as select o_custkey, count(*) as n from {s}.big group by 1;
        insert into {s}.big select * from {orders} where o_totalprice <= 1000;
        create table {s}.copy using parquet as select * from big_snapshot;
        create view {s}.report as
            select c_nationkey, 'a;b' as tag, sum(n) as orders
            from {s}.copy join {customer} on c_custkey = o_custkey group by 1;
        select c_nationkey, tag, orders from {s}.report;""")


def e_block(spark, folder):
    return _run(spark, folder, "block", """BEGIN
        DECLARE floor_price DOUBLE DEFAULT 300000;
        SELECT o_custkey, count(*) AS orders FROM {orders} WHERE o_totalprice > floor_price GROUP BY 1;
    END""")


def e_ctas(spark, folder):
    return _run(spark, folder, "ctas", """
        create table {s}.urgent using parquet as
            select o_orderkey, o_totalprice from {orders} where o_orderpriority = '1-URGENT';
        select * from {s}.urgent""")


def e_cte(spark, folder):
    return _run(spark, folder, "cte", """
        with totals as (select o_custkey, sum(o_totalprice) as total from {orders} group by 1),
        ranked as (select c_nationkey, count(*) as customers from totals
            join {customer} on c_custkey = o_custkey where total > 500000 group by 1)
        select n_name, customers from ranked join {nation} on n_nationkey = c_nationkey""")


def e_union_script(spark, folder):
    """The union and the box of the points of each nation, as a script asks for them."""
    points = derived.customer_points(table(spark, folder, "customer"))
    v = geo.first_vertex("geom")
    points.withColumn("geom", geo.point(F.floor(v["x"] / 4), F.floor(v["y"] / 4), srid=4326)).createOrReplaceTempView(
        "coarse_points")
    rows = _run(spark, folder, "union", """
        create temp table merged as
            select c_nationkey, ST_Union(geom) as geom, count(*) as members, -- not st_union(this)
                st_extent( geom ) as box, 'st_extent(x)' as note
            from coarse_points group by c_nationkey;
        select c_nationkey, geom, members, box, note from merged""")
    spots = F.transform(geo.vertices("geom"), lambda p: F.concat_ws(" ", p["x"].cast("int"), p["y"].cast("int")))
    return rows.select("c_nationkey", F.col("geom.kind").alias("kind"), F.col("geom.srid").alias("srid"), "members",
                       F.array_join(spots, ",").alias("spots"), "box.xmin", "box.ymin", "box.xmax", "box.ymax", "note")


def e_insert_select(spark, folder):
    return _run(spark, folder, "insert", """
        create table {s}.prices (id bigint, price double, note string) using parquet;
        insert into {s}.prices (id, price) select o_orderkey, o_totalprice from {orders};
        insert into {s}.prices (note, id) select c_name, c_custkey from {customer};
        select * from {s}.prices""")


def e_counts(spark, folder):
    return _run(spark, folder, "counts", """
        select o_orderstatus, count(nullif(o_orderpriority, '5-LOW')) as known, count(*) as every
        from {orders} group by 1""")


def e_functions(spark, folder):
    return _run(spark, folder, "functions", """
        create or replace temporary function net(price double, discount double)
            returns double return price * (1 - discount);
        create or replace temporary function customers_of(nation int)
            returns table (id bigint, name string)
            return select c_custkey, c_name from {customer} where c_nationkey = nation;
        select id, name, sum(net(l_extendedprice, l_discount)) > 100000 as large
        from customers_of(7) join {orders} on o_custkey = id
            join {lineitem} on l_orderkey = o_orderkey
        group by 1, 2""")


def e_spatial_functions(spark, folder):
    register_functions(spark)
    derived.part_rectangles(table(spark, folder, "part")).createOrReplaceTempView("rects")
    return _run(spark, folder, "spatial", """
        select p_partkey, st_area(geom) as area, st_get_srid(st_set_srid(geom, 3857)) as srid,
            st_multi(geom).kind as kind, st_x(geom) as x, st_y(st_point(1, p_partkey)) as y
        from rects""")


def e_update_from(spark, folder):
    """Add the balance of their customer to the orders of some nations."""
    customer = table(spark, folder, "customer")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return transforms.update_from(
        orders, customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"),
        {"o_custkey": "c_custkey"},
        {"o_totalprice": "t.o_totalprice + if(s.c_nationkey < 10, s.c_acctbal, 0)",
         "o_orderstatus": "if(s.c_nationkey < 10, s.c_mktsegment, t.o_orderstatus)"},
    )


def e_update_script(spark, folder):
    return _run(spark, folder, "update", """
        create table {s}.orders using parquet as
            select o_orderkey, o_custkey, o_totalprice, o_orderstatus from {orders};
        update {s}.orders o set o_totalprice = o.o_totalprice + coalesce(c.c_acctbal, 0),
            o_orderstatus = c_mktsegment
        from {customer} c where c.c_custkey = o.o_custkey and c_nationkey < 10;
        update {s}.orders set o_orderstatus = 'none; at all' where o_totalprice < 1000;
        select * from {s}.orders""")


def e_drop_alter(spark, folder):
    return _run(spark, folder, "alter", """
        create table {s}.t using parquet as select n_nationkey, n_regionkey from {nation};
        alter table {s}.t add column note string;
        insert into {s}.t select c_custkey, c_nationkey, c_name from {customer};
        analyze table {s}.t compute statistics;
        create table {s}.gone using parquet as select 1 as x;
        drop table {s}.gone;
        drop view if exists {s}.never;
        select n_regionkey, count(*) as every, count(note) as noted from {s}.t group by 1""")


QUERIES = {f.__name__: f for f in (
    e_script, e_block, e_ctas, e_cte, e_insert_select, e_union_script, e_counts, e_functions,
    e_spatial_functions, e_update_from, e_update_script, e_drop_alter,
)}

ORACLES = {
    "e_union_script": """WITH pts AS (SELECT c_nationkey,
            CAST(floor((-180.0::DOUBLE + (c_custkey * 37 % 36000) / 100.0::DOUBLE) / 4) AS INTEGER) AS x,
            CAST(floor((-80.0::DOUBLE + (c_custkey * 53 % 16000) / 100.0::DOUBLE) / 4) AS INTEGER) AS y FROM customer),
        spots AS (SELECT DISTINCT c_nationkey, x, y FROM pts),
        joined AS (SELECT c_nationkey, string_agg(x || ' ' || y, ',' ORDER BY x, y) AS spots FROM spots GROUP BY 1)
        SELECT c_nationkey, 'MultiPoint' AS kind, 4326 AS srid, count(*) AS members, any_value(spots) AS spots,
            min(x)::DOUBLE AS xmin, min(y)::DOUBLE AS ymin, max(x)::DOUBLE AS xmax, max(y)::DOUBLE AS ymax,
            'st_extent(x)' AS note FROM pts JOIN joined USING (c_nationkey) GROUP BY 1""",
    "e_script": """SELECT c_nationkey, 'a;b' AS tag, count(*) AS orders FROM orders
        JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 200000 GROUP BY 1""",
    "e_block": "SELECT o_custkey, count(*) AS orders FROM orders WHERE o_totalprice > 300000 GROUP BY 1",
    "e_ctas": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'",
    "e_cte": """SELECT n_name, count(*) AS customers FROM (SELECT o_custkey FROM orders GROUP BY 1
            HAVING sum(o_totalprice) > 500000)
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
    "e_insert_select": """SELECT o_orderkey AS id, o_totalprice AS price, NULL AS note FROM orders
        UNION ALL SELECT c_custkey, NULL, c_name FROM customer""",
    "e_counts": """SELECT o_orderstatus, count(*) FILTER (o_orderpriority <> '5-LOW') AS known,
        count(*) AS every FROM orders GROUP BY 1""",
    "e_functions": """SELECT c_custkey AS id, c_name AS name,
            sum(l_extendedprice * (1 - l_discount)) > 100000 AS large
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_nationkey = 7 GROUP BY 1, 2""",
    "e_spatial_functions": """SELECT p_partkey,
            p_size::DOUBLE * (p_partkey % 7 + 1) - CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END AS area,
            3857 AS srid, 'MultiPolygon' AS kind, (p_partkey % 1000) * 100.0::DOUBLE AS x,
            p_partkey::DOUBLE AS y FROM part""",
    "e_update_from": """SELECT o_orderkey, o_custkey,
            CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice + c_acctbal END AS o_totalprice,
            coalesce(c_mktsegment, o_orderstatus) AS o_orderstatus
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 10""",
    "e_update_script": """SELECT o_orderkey, o_custkey, price AS o_totalprice,
            CASE WHEN price < 1000 THEN 'none; at all' ELSE status END AS o_orderstatus
        FROM (SELECT o_orderkey, o_custkey,
                CASE WHEN c_custkey IS NULL THEN o_totalprice ELSE o_totalprice + c_acctbal END AS price,
                coalesce(c_mktsegment, o_orderstatus) AS status
            FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey < 10)""",
    "e_drop_alter": """SELECT n_regionkey, count(*) AS every, count(note) AS noted FROM (
            SELECT n_regionkey, NULL AS note FROM nation
            UNION ALL SELECT c_nationkey, c_name FROM customer) GROUP BY 1""",
}
