"""Splitting scripts and UPDATE as people write them."""

import uuid

import pytest
from pyspark.sql import functions as F

from landspan.operators import transforms


@pytest.mark.parametrize("sql, want", [
    ('select "a;b"; select `c;d` as x', ['select "a;b"', "select `c;d` as x"]),
    ('select "a -- b", \'/*\' -- gone\n; ;', ['select "a -- b", \'/*\'']),
    ("select 'it''s;' /* ; */ as x", ["select 'it''s;'   as x"]),
])
def test_split(sql, want):
    assert transforms.split_statements(sql) == want


def test_clauses():
    assert transforms.parse_update(
        "update only a.b as x set c = extract(year from d), e = 'from where', f = g is distinct from h"
        " from (select 1 from z where 1 = 1) s where x.c = (select max(q) from w)"
    ) == ("a.b", "x", "c = extract(year from d), e = 'from where', f = g is distinct from h",
          "(select 1 from z where 1 = 1) s", "x.c = (select max(q) from w)")
    assert transforms.parse_update("select 1") is None


@pytest.fixture
def stock(spark):
    schema = f"update_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {schema}")
    spark.sql(f"CREATE TABLE {schema}.stock USING parquet AS SELECT id, CAST(id AS DOUBLE) AS Price,"
              " date'2020-05-01' AS day, 'old' AS `some note` FROM range(4)")
    return f"{schema}.stock"


@pytest.mark.parametrize("clauses, want", [
    ("set PRICE = 9 where id = 1", {1: (9.0, "old")}),
    ("x set x.price = x.price + 1 where x.id < 2", {0: (1.0, "old"), 1: (2.0, "old")}),
    ("set stock.`Price` = extract(year from day) where id = 3", {3: (2020.0, "old")}),
    ("set `some note` = 'moved from A, where = b' where id = 2", {2: (2.0, "moved from A, where = b")}),
    ("set price = (select max(id) from range(9) r where r.id < 8) where id = 0", {0: (7.0, "old")}),
    ("set price = if(stock.id in (1, 2), 5, 6), `some note` = concat('a', ',', r.id) from range(2) r where r.id = stock.id",
     {0: (6.0, "a,0"), 1: (5.0, "a,1")}),
])
def test_update(spark, stock, clauses, want):
    transforms.run_script(spark, f"update {stock} {clauses}")
    before = {i: (float(i), "old") for i in range(4)}
    assert {r["id"]: (r["Price"], r["some note"]) for r in spark.table(stock).collect()} == before | want


@pytest.mark.parametrize("clauses", ["set cost = 1", "x set y.price = 1", "set price"])
def test_unknown_column(spark, stock, clauses):
    with pytest.raises(ValueError):
        transforms.run_script(spark, f"update {stock} {clauses}")


def test_aggregates_are_written_out_only_where_they_are_called():
    body = transforms.expand_aggregates("select ST_Extent( f(a, ')') ) from t -- st_extent(b)\nwhere x = 'st_union(c)'")
    assert body.count("st_extent(") == 1 and "'st_union(c)'" in body and "(f(a, ')')).parts" in body
    assert transforms.expand_aggregates("select my_st_union(a), st_union from t") == "select my_st_union(a), st_union from t"
    twice = transforms.expand_aggregates("select st_union(a), st_extent(a) from t")
    assert "st_union(" not in twice and "st_extent(" not in twice and twice.endswith("from t")


def test_union_in_a_script(spark):
    from landspan.functions import geometry as geo

    rows = [(1, 1.0, 2.0, 4326), (1, 1.0, 2.0, 4326), (1, 0.0, 5.0, 4326), (2, None, None, 4326)]
    spots = spark.createDataFrame(rows, "k int, x double, y double, srid int")
    shape = F.when(F.col("x").isNotNull(), geo.point(F.col("x"), F.col("y"), srid=F.col("srid")))
    spots.withColumn("g", shape).createOrReplaceTempView("spots")
    got = {r.k: r for r in transforms.run_script(
        spark, "select k, st_union(g) as u, st_extent(g) as box from spots group by k").collect()}
    assert [tuple(p[0][0])[:2] for p in got[1].u.parts] == [(0.0, 5.0), (1.0, 2.0)]
    assert got[1].u.kind == "MultiPoint" and tuple(got[1].box) == (0.0, 2.0, 1.0, 5.0)
    assert got[2].u is None and got[2].box.xmin is None
    spark.sql("select 1 as k, named_struct('srid', 0, 'kind', 'Polygon', 'parts', g.parts) as g from spots"
              ).createOrReplaceTempView("areas")
    with pytest.raises(Exception, match="a union of points holds a Polygon"):
        transforms.run_script(spark, "select st_union(g) from areas").collect()
    spots.withColumn("g", geo.point(F.col("k"), F.col("k"), srid=F.col("k"))).createOrReplaceTempView("mixed")
    with pytest.raises(Exception, match="several SRIDs"):
        transforms.run_script(spark, "select st_union(g) from mixed").collect()
