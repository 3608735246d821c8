import datetime as dt
import uuid

import duckdb as ddb
import numpy as np
import pytest
from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.operators import checks, columns, layout, tables, transforms
from landspan.registry.fixtures import shapefile as shp_bytes
from landspan.registry.fixtures import tiff
from landspan.plans.load import (
    CSVSource, Destination, DuckDBSource, EsriSource, FileSource, RasterSource, WFSSource, load, read,
)


@pytest.fixture
def schema(spark):
    return f"t_{uuid.uuid4().hex}"


def test_csv_with_composite_key(spark, schema, tmp_path):
    (tmp_path / "a.csv").write_text("Id,part,v\n1,1,x\n1,2,y\n")
    source = CSVSource(str(tmp_path / "a.csv"), pk="Id, part")
    assert load(spark, source, Destination(f"{schema}.a")).count() == 2
    # A violation leaves the published table as it was.
    (tmp_path / "a.csv").write_text("Id,part,v\n1,1,x\n1,1,y\n")
    with pytest.raises(checks.ConstraintViolation):
        load(spark, source, Destination(f"{schema}.a"))
    assert spark.table(f"{schema}.a").count() == 2
    with pytest.raises(ValueError):
        load(spark, source, Destination(f"{schema}.a", geom_index=True))


def test_duckdb_load_carries_constraints_and_defaults(spark, schema, tmp_path):
    path = str(tmp_path / "s.duckdb")
    with ddb.connect(path) as con:
        con.execute("""CREATE TABLE s ("S Key" BIGINT PRIMARY KEY, name VARCHAR NOT NULL,
            state VARCHAR DEFAULT 'new', shape GEOMETRY)""")
        con.execute("INSERT INTO s SELECT i, 'n' || i, 'old', 'POINT(' || i || ' 1)' FROM range(30) r(i)")
    dest = Destination(f"{schema}.s", geom_column="geom", geom_index=True)
    out = load(spark, DuckDBSource(path, "s", epsg=2193), dest)
    assert out.columns == ["s_key", "name", "state", "geom", *layout.BOX, "morton"]
    assert {r["geom"]["srid"] for r in out.collect()} == {2193}
    assert layout.layout_of(spark, tables.sql_name(f"{schema}.s")) == "geom:morton"
    assert tables.index_geometry(spark, f"{schema}.s", "geom") is False
    spark.sql(f"INSERT INTO {schema}.s (s_key, name) VALUES (99, 'late')")
    assert spark.table(f"{schema}.s").where("s_key = 99").first()["state"] == "new"
    plain = load(spark, DuckDBSource(path, "s"), Destination(f"{schema}.p", attributes_only=True))
    assert plain.columns == ["s_key", "name", "state"]
    with pytest.raises(NotImplementedError):
        read(spark, DuckDBSource(path, "s", pk="name"), dest)


def test_shapefile_load_promotes_and_numbers(spark, schema, tmp_path):
    ring = np.array([[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], float)
    files = shp_bytes(5, [[ring + i] for i in range(6)], [("NAME", "C", 5, 0)], [[f"n{i}"] for i in range(6)])
    for suffix, data in files.items():
        (tmp_path / f"a.{suffix}").write_bytes(data)
    out = load(spark, FileSource(str(tmp_path / "a.shp"), epsg="3857:4326", pk="fid"), Destination(f"{schema}.a"))
    rows = out.orderBy("fid").collect()
    assert [r["fid"] for r in rows] == [1, 2, 3, 4, 5, 6] and rows[0]["name"] == "n0"
    assert {r["geom"]["kind"] for r in rows} == {"MultiPolygon"} and {r["geom"]["srid"] for r in rows} == {4326}
    with pytest.raises(NotImplementedError):
        load(spark, FileSource(str(tmp_path / "a.gpkg")), Destination(f"{schema}.b"))
    with pytest.raises(ValueError):
        load(spark, FileSource(str(tmp_path / "a.shp")), Destination("no_dot"))


def test_saved_pages_load(spark, schema, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"features":[{"properties":{"A b":1},"geometry":{"type":"Point","coordinates":[10,20]}}]}')
    row = load(spark, EsriSource(str(tmp_path), epsg=3857), Destination(f"{schema}.f")).first()
    assert (row["gid"], row["a_b"], row["geom"]["kind"], row["geom"]["srid"]) == (1, 1, "MultiPoint", 3857)
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "p.xml").write_text(
        '<c xmlns:gml="g" xmlns:a="a"><a:r><a:N>5</a:N><a:g><gml:Point srsName="EPSG:2193">'
        "<gml:pos>1 2</gml:pos></gml:Point></a:g></a:r></c>")
    row = load(spark, WFSSource(str(tmp_path / "x"), "a:r"), Destination(f"{schema}.w", geom_column="pt")).first()
    assert (row["gid"], row["n"], row["pt"]["kind"]) == (1, 5, "Point")


def test_feature_id_from_an_attribute(spark, schema, tmp_path):
    page = '{"features":[%s]}'
    one = '{"properties":{"OBJECTID":%d,"t":"x"},"geometry":{"type":"Point","coordinates":[1,2]}}'
    (tmp_path / "p.json").write_text(page % ",".join(one % i for i in (40, 7)))
    out = load(spark, EsriSource(str(tmp_path), pk="OBJECTID"), Destination(f"{schema}.f"))
    assert out.columns == ["objectid", "t", "geom"] and {r["objectid"] for r in out.collect()} == {40, 7}
    (tmp_path / "p.json").write_text(page % ",".join(one % i for i in (7, 7)))
    with pytest.raises(checks.ConstraintViolation):
        load(spark, EsriSource(str(tmp_path), pk="OBJECTID"), Destination(f"{schema}.f"))
    with pytest.raises(ValueError, match="no integer"):
        read(spark, EsriSource(str(tmp_path), pk="t"), Destination(f"{schema}.g"))


def test_raster_load(spark, schema, tmp_path):
    (tmp_path / "a.tif").write_bytes(tiff(np.ones((1, 20, 30), "u1"), 0, 0, 1, 2193))
    out = load(spark, RasterSource(str(tmp_path), "4326:2193"), Destination(
        f"{schema}.r", tile_size=16, raster_column="img", raster_constraints=True))
    assert out.columns == ["rid", "img"] and out.count() == 4
    (tmp_path / "b.tif").write_bytes(tiff(np.ones((2, 20, 30), "u1"), 0, 0, 1, 2193))
    with pytest.raises(checks.ConstraintViolation, match="num_bands"):
        load(spark, RasterSource(str(tmp_path)), Destination(f"{schema}.r", tile_size=16, raster_constraints=True))
    with pytest.raises(ValueError):
        read(spark, RasterSource(str(tmp_path)), Destination(f"{schema}.r"))


def test_raster_constraints_find_mixed_tables(spark, tmp_path):
    from landspan.sources.raster import read_raster

    (tmp_path / "a.tif").write_bytes(tiff(np.ones((1, 16, 16), "u1"), 0, 0, 2, 2193))
    (tmp_path / "b.tif").write_bytes(tiff(np.ones((1, 16, 16), "u1"), 33, 0, 2, 4326))
    (tmp_path / "c.tif").write_bytes(tiff(np.ones((1, 16, 16), "u1"), 0, 0, 5, 2193))
    got = {r["name"]: r["holds"] for r in checks.raster_constraints(read_raster(spark, str(tmp_path), 8)).collect()}
    assert not got["srid"] and not got["scale_x"] and not got["alignment_x"] and got["num_bands"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, None), (2, "c")], "k int, v string")
    assert {tuple(r) for r in checks.null_counts(df, ["k", "v"]).collect()} == {("k", 1), ("v", 1)}
    assert {tuple(r) for r in checks.key_violations(df, ["k"]).collect()} == {(1, 2), (None, 1)}
    checks.require_key(df.where("v > 'b'"), ["k"])
    checks.require_not_null(df, [])
    with pytest.raises(checks.ConstraintViolation, match="k: 1"):
        checks.require_not_null(df, ["k", "v"])


def test_journal_append(spark, schema):
    now = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("n", now, now, "u", "h", "1", None)], tables.JOURNAL_SCHEMA)
    for _ in range(2):
        tables.append_journal(rows, f"{schema}.runs")
    assert spark.table(f"{schema}.runs").count() == 2
    assert spark.table(f"{schema}.runs").columns == tables.JOURNAL_SCHEMA.names
    assert tables.split_name("a.b.c") == ("a", "b.c")


def test_layout_lets_a_box_filter_skip_files(spark, tmp_path):
    """Row groups whose statistics meet a small box, before and after clustering."""
    import pyarrow.dataset as ds

    df = spark.range(20_000).select("id", geo.point(F.col("id") * 7919 % 20_011, F.col("id") * 104_729 % 20_021).alias("g"))
    boxed = layout.add_bounds(df, "g")
    box = (5_000.0, 5_000.0, 6_000.0, 6_000.0)

    def touched(frame, name):
        frame.write.option("parquet.block.size", str(32 << 10)).parquet(str(tmp_path / name))
        hits = total = 0
        for piece in ds.dataset(str(tmp_path / name), format="parquet").get_fragments():
            for group in piece.row_groups:
                total += 1
                s = group.statistics
                hits += not (s["xmin"]["min"] > box[2] or s["xmax"]["max"] < box[0]
                             or s["ymin"]["min"] > box[3] or s["ymax"]["max"] < box[1])
        assert layout.in_box(spark.read.parquet(str(tmp_path / name)), box).count() == layout.in_box(boxed, box).count()
        return hits, total

    before, total_before = touched(boxed.repartition(8), "plain")
    after, total_after = touched(layout.cluster(boxed, layout.frame_of(boxed)).repartitionByRange(8, "morton")
                                 .sortWithinPartitions("morton"), "laid_out")
    assert before == total_before and after * 2 <= total_after


def test_layout_of_copies_spreads(spark):
    same = spark.range(1000).select(geo.point(F.lit(1), F.lit(1)).alias("g"))
    boxed = layout.add_bounds(same, "g")
    spread = layout.cluster(boxed, layout.frame_of(boxed))
    assert spread.count() == 1000
    assert {r["morton"] for r in spread.collect()} == {0}
    none = layout.add_bounds(same.limit(0), "g")
    assert layout.cluster(none, layout.frame_of(none)).count() == 0


def test_script_stops_at_the_first_error(spark, schema):
    tables.ensure_schemas(spark, [schema])
    with pytest.raises(Exception, match="missing_table"):
        transforms.run_script(spark, f"create table {schema}.a using parquet as select 1 as x;"
                              f" select * from missing_table; drop table {schema}.a;")
    assert spark.table(f"{schema}.a").count() == 1
    for text in ("begin; select 1; rollback;",):
        with pytest.raises(NotImplementedError):
            transforms.run_script(spark, text)
    assert transforms.run_script(spark, "begin; select 'a;b' as x; commit;").first()["x"] == "a;b"
    assert transforms.run_script(spark, " -- nothing\n;") is None


def test_temp_table_is_a_snapshot(spark, schema):
    tables.ensure_schemas(spark, [schema])
    out = transforms.run_script(spark, f"""
        create table {schema}.live (x int) using parquet;
        insert into {schema}.live values (1);
        create temp table frozen as select * from {schema}.live;
        insert into {schema}.live values (2);
        select * from frozen""")
    assert [r["x"] for r in out.collect()] == [1]


def test_update_from(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)], "k int, t string, v double")
    source = spark.createDataFrame([(1, 10.0), (1, 10.0), (7, 5.0), (None, 3.0)], "id int, w double")
    out = transforms.update_from(target, source, {"k": "id"}, {"v": "t.v + s.w"})
    assert {(r["k"], r["v"]) for r in out.collect()} == {(1, 11.0), (2, 2.0), (None, 0.0)}
    clash = source.union(spark.createDataFrame([(1, 11.0)], "id int, w double"))
    with pytest.raises(Exception, match="several different source rows"):
        transforms.update_from(target, clash, {"k": "id"}, {"v": "s.w"}).collect()


def test_update_statement(spark, schema):
    name = f"{schema}.u"
    tables.replace_table(spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, t string, v int"), name)
    spark.createDataFrame([(1, 5), (1, 5), (9, 9)], "id int, w int").createOrReplaceTempView("src")
    out = transforms.run_script(spark, f"update {name} set v = greatest(v, w, (1 + (2))), t = 'x, y' "
                                       f"from src where src.id = u.id")
    assert {tuple(r) for r in out.collect()} == {(1, "x, y", 5), (2, "b", 2)}
    transforms.run_script(spark, f"update {name} set v = 0")
    assert {r["v"] for r in spark.table(name).collect()} == {0}
    spark.createDataFrame([(1, 5), (1, 6)], "id int, w int").createOrReplaceTempView("src")
    with pytest.raises(Exception, match="several different source rows"):
        transforms.run_script(spark, f"update {name} set v = w from src where src.id = u.id")
    assert {r["v"] for r in spark.table(name).collect()} == {0}


def test_default_applies_to_later_rows_only(spark, schema):
    name = f"{schema}.d"
    tables.replace_table(spark.createDataFrame([(1, None)], "k int, v string"), name)
    columns.set_default(spark, name, "v", "'x'")
    spark.sql(f"INSERT INTO {name} (k) VALUES (2)")
    assert sorted((r["k"], r["v"] or "") for r in spark.table(name).collect()) == [(1, ""), (2, "x")]


def test_rename_and_drop_geometry(spark):
    df = spark.range(1).select("id", geo.point(F.col("id"), F.col("id")).alias("g"))
    assert columns.rename_geometry(df, None).columns == ["id", "g"]
    assert columns.rename_geometry(df, "shape").columns == ["id", "shape"]
    assert columns.attributes_only(df).columns == ["id"]
    with pytest.raises(ValueError):
        columns.rename_geometry(df.withColumn("h", F.col("g")), "shape")
