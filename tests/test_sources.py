import datetime as dt
import json
import re
from urllib.parse import parse_qs, urlparse

import duckdb as ddb
import numpy as np
import pytest
from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.operators import columns
from landspan.registry.fixtures import shapefile as shp_bytes
from landspan.registry.fixtures import tiff
from landspan.sources import csv, duckdb, features, raster, shapefile, wfs


def _xy(row):
    return [[[(p["x"], p["y"]) for p in ring] for ring in part] for part in row["parts"]]


def test_csv_variants(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,day\n1,"Lake, big",2024-01-02\n2,,2024-01-03\n3,"say ""x""",\n')
    rows = csv.read_csv(spark, str(tmp_path / "a.csv")).orderBy("id").collect()
    assert [r["name"] for r in rows] == ["Lake, big", None, 'say "x"']
    assert rows[0]["day"] == dt.date(2024, 1, 2) and rows[2]["day"] is None
    (tmp_path / "b.csv").write_text("id;v\n1;2.5\n")
    assert csv.read_csv(spark, str(tmp_path / "b.csv"), separator=";").first()["v"] == 2.5
    fixed = csv.read_csv(spark, str(tmp_path / "b.csv"), "id long, v string", ";")
    assert fixed.schema.simpleString() == "struct<id:bigint,v:string>" and fixed.first()["v"] == "2.5"


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ddb") / "one.duckdb")
    with ddb.connect(path) as con:
        con.execute("""CREATE TABLE t ("My Col" INTEGER, b VARCHAR NOT NULL, h HUGEINT DEFAULT 5,
            l INTEGER[], s STRUCT(a INTEGER, b VARCHAR), m MAP(VARCHAR, INTEGER), u UUID,
            g GEOMETRY, ts TIMESTAMP, e DECIMAL(10, 2), ti TIME, d DATE, bl BLOB, ok BOOLEAN,
            PRIMARY KEY ("My Col", b))""")
        con.execute("""INSERT INTO t SELECT i, 'x' || i, 3, [1, i], {'a': i, 'b': 'q'}, map(['k'], [i]),
            '00000000-0000-0000-0000-000000000001', CASE WHEN i % 2 = 0 THEN 'POINT(1 2)'
            ELSE 'LINESTRING(0 0, 1 1)' END, '2024-01-01', 1.5, '10:00', '2020-01-01', 'ab', i % 2 = 0
            FROM range(25) r(i)""")
        con.execute("DELETE FROM t WHERE \"My Col\" = 7")
        con.execute("CREATE VIEW v AS SELECT b, g FROM t")
        con.execute("CREATE TABLE empty (x INTEGER)")
    return path


def test_duckdb_types_and_flags(spark, database):
    rows = duckdb.read_duckdb(spark, database, "t", rows_per_task=10)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    assert kinds["h"] == "decimal(38,0)" and kinds["u"] == "string" and kinds["ti"] == "string"
    assert kinds["l"] == "array<int>" and kinds["m"] == "map<string,int>" and kinds["ts"] == "timestamp_ntz"
    assert kinds["g"] == geo.GEOMETRY_DDL and kinds["bl"] == "binary"
    got = {r["My Col"]: r for r in rows.collect()}
    assert sorted(got) == [i for i in range(25) if i != 7]
    assert got[3]["g"]["kind"] == "LineString" and got[4]["g"]["kind"] == "Point"
    assert got[5]["s"].asDict() == {"a": 5, "b": "q"} and got[5]["m"] == {"k": 5}
    laundered = columns.launder(rows)
    assert list(duckdb.declared(laundered, duckdb.KEY)) == ["my_col", "b"]
    assert duckdb.declared(laundered, duckdb.DEFAULT) == {"h": "5"}


def test_duckdb_view_columns_and_empty(spark, database):
    view = duckdb.read_duckdb(spark, database, "v")
    assert view.count() == 24
    some = duckdb.read_duckdb(spark, database, "t", columns=["b"])
    assert some.columns == ["b"] and some.distinct().count() == 24
    assert duckdb.read_duckdb(spark, database, "empty").count() == 0


def test_launder_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`A b` int, `a-b` int")
    with pytest.raises(ValueError, match="collide"):
        columns.launder(df)
    assert columns.launder(df, keep_names=True).columns == ["A b", "a-b"]
    assert columns.launder(spark.createDataFrame([(1,)], "`Größe.m` int")).columns == ["gr__e_m"]


SQUARE = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]
HOLE = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
FAR = [[9, 9], [9, 10], [10, 10], [10, 9], [9, 9]]


def test_esri_json_shapes(spark):
    page = {
        "spatialReference": {"wkid": 102100},
        "fields": [{"name": "ID", "type": "esriFieldTypeOID"}, {"name": "T", "type": "esriFieldTypeString"},
                   {"name": "D", "type": "esriFieldTypeDate"}],
        "features": [
            {"attributes": {"ID": 1, "T": "a", "D": 86400000}, "geometry": {"rings": [SQUARE, HOLE, FAR]}},
            {"attributes": {"ID": 2, "T": None, "D": None}, "geometry": {"paths": [[[0, 0], [1, 1]]]}},
            {"attributes": {"ID": 3, "T": "7"}, "geometry": {"points": [[1, 2], [3, 4]]}},
            {"attributes": {"ID": 4, "T": "x"}},
            {"attributes": {"ID": 5, "T": "z"}, "geometry": {"x": 1, "y": 2, "z": 3}},
        ],
    }
    df = spark.createDataFrame([(json.dumps(page, indent=1),)], "text string")
    got = {r["ID"]: r for r in features.parse_pages(df, "pjson").collect()}
    assert got[1]["geom"]["kind"] == "MultiPolygon" and got[1]["geom"]["srid"] == 3857
    assert sorted(len(part) for part in got[1]["geom"]["parts"]) == [1, 2]
    assert got[1]["D"] == dt.datetime(1970, 1, 2) and got[2]["T"] is None
    assert got[2]["geom"]["kind"] == "LineString" and got[3]["geom"]["kind"] == "MultiPoint"
    assert got[4]["geom"] is None and got[5]["geom"]["parts"][0][0][0]["z"] == 3.0 and got[3]["T"] == "7"


def test_geojson_shapes_and_types(spark):
    shapes = [
        ("Point", [1, 2]), ("MultiPoint", [[1, 2], [3, 4]]), ("LineString", [[0, 0], [1, 1]]),
        ("MultiLineString", [[[0, 0], [1, 1]]]), ("Polygon", [SQUARE, HOLE]),
        ("MultiPolygon", [[SQUARE, HOLE], [FAR]]),
    ]
    rows = [{"type": "Feature", "properties": {"n": i, "w": i / 2, "odd name": "s", "o": {"x": 1}},
             "geometry": {"type": kind, "coordinates": c}} for i, (kind, c) in enumerate(shapes)]
    rows.append({"type": "Feature", "properties": {"n": 99, "w": None}, "geometry": None})
    pages = [(json.dumps({"type": "FeatureCollection", "features": part}),) for part in (rows[:3], rows[3:])]
    got = {r["n"]: r for r in features.parse_pages(spark.createDataFrame(pages, "text string"), "pgeojson").collect()}
    for i, (kind, _) in enumerate(shapes):
        assert got[i]["geom"]["kind"] == kind and got[i]["geom"]["srid"] == 4326
    assert [len(part) for part in got[5]["geom"]["parts"]] == [2, 1]
    assert got[3]["w"] == 1.5 and got[3]["odd name"] == "s" and got[99]["geom"] is None
    with pytest.raises(ValueError):
        features.parse_pages(spark.createDataFrame(pages, "text string"), "html")


def test_live_feature_service_is_paged(spark):
    def fetch(url):
        query = parse_qs(urlparse(url).query)
        if "returnCountOnly" in query:
            return json.dumps({"count": 25})
        low = int(query["resultOffset"][0])
        rows = [{"type": "Feature", "properties": {"n": n},
                 "geometry": {"type": "Point", "coordinates": [n, 0]}} for n in range(low, min(low + 10, 25))]
        return json.dumps({"features": rows})

    got = features.fetch_features(spark, "https://example.org/layer/0", fetch, page_size=10)
    assert sorted(r["n"] for r in got.collect()) == list(range(25))


def _gml(body, number):
    return (f'<wfs:member><a:plot gml:id="plot.{number}"><a:code>{number}</a:code><a:shape>{body}</a:shape>'
            "</a:plot></wfs:member>")


def _collection(members, extra=""):
    return ('<?xml version="1.0"?>\n<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0" '
            'xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:a="http://example.org/a"' + extra + ">\n"
            + "\n".join(members) + "\n</wfs:FeatureCollection>")


URN = 'srsName="urn:ogc:def:crs:EPSG::4326"'
RING = "<gml:LinearRing><gml:posList>{}</gml:posList></gml:LinearRing>"
AREA = ('<gml:Polygon {}><gml:exterior>' + RING.format("0 0 0 4 4 4 4 0 0 0") + "</gml:exterior>"
        "<gml:interior>" + RING.format("1 1 2 1 2 2 1 1") + "</gml:interior></gml:Polygon>")


def test_wfs_shapes_and_axis_order(spark, tmp_path):
    members = [
        _gml(f"<gml:Point {URN}><gml:pos>-41 174</gml:pos></gml:Point>", 1),
        _gml('<gml:Point srsName="EPSG:2193"><gml:pos>5 6</gml:pos></gml:Point>', 2),
        _gml(AREA.format('srsName="EPSG:2193"'), 3),
        _gml('<gml:LineString srsName="EPSG:2193"><gml:posList>0 0 1 1 2 0</gml:posList></gml:LineString>', 4),
        _gml('<gml:MultiSurface srsName="EPSG:2193"><gml:surfaceMember>' + AREA.format("")
             + "</gml:surfaceMember></gml:MultiSurface>", 5),
    ]
    (tmp_path / "p1.xml").write_text(_collection(members[:2]))
    (tmp_path / "p2.xml").write_text(_collection(members[2:]))
    got = {r["code"]: r for r in wfs.read_wfs(spark, str(tmp_path), "a:plot").collect()}
    assert got[1]["gml_id"] == "plot.1" and _xy(got[1]["shape"]) == [[[(174.0, -41.0)]]]
    assert got[1]["shape"]["srid"] == 4326 and _xy(got[2]["shape"]) == [[[(5.0, 6.0)]]]
    assert [len(ring) for ring in got[3]["shape"]["parts"][0]] == [5, 4]
    assert len(got[4]["shape"]["parts"][0][0]) == 3
    assert got[5]["shape"]["kind"] == "MultiPolygon" and len(got[5]["shape"]["parts"][0]) == 2


def test_live_wfs_is_paged(spark):
    def fetch(url):
        query = parse_qs(urlparse(url).query)
        if query.get("resultType") == ["hits"]:
            return _collection([], ' numberMatched="7"')
        low = int(query["startIndex"][0])
        point = '<gml:Point srsName="EPSG:2193"><gml:pos>{0} {0}</gml:pos></gml:Point>'
        return _collection([_gml(point.format(n), n) for n in range(low, min(low + 3, 7))])

    got = wfs.fetch_wfs(spark, "https://example.org/wfs?token=1", "a:plot", fetch, page_size=3)
    assert sorted((r["code"], r["shape"]["parts"][0][0][0]["x"]) for r in got.collect()) == [
        (n, float(n)) for n in range(7)]


def _save(folder, name, files):
    for suffix, data in files.items():
        (folder / f"{name}.{suffix}").write_bytes(data)
    return str(folder / f"{name}.shp")


FIELDS = [("id", "N", 5, 0), ("name", "C", 10, 0), ("day", "D", 8, 0), ("ok", "L", 1, 0), ("w", "F", 8, 3)]


def test_shapefile_points_deleted_and_null(spark, tmp_path):
    rows = [["1", "é", "20240102", "T", "1.5"], ["2", "", "", "?", ""], ["3", "gone", "", "F", "1"],
            ["4", "null", "", "n", "2"]]
    shapes = [[np.array([[1.0, 2.0]])], [np.array([[3.0, 4.0]])], [np.array([[5.0, 6.0]])], None]
    path = _save(tmp_path, "p", shp_bytes(1, shapes, FIELDS, rows, deleted=(2,)))
    (tmp_path / "p.prj").write_text('PROJCS["x",AUTHORITY["EPSG","2193"]]')
    got = {r["id"]: r for r in shapefile.read_shapefile(spark, path, rows_per_task=1).collect()}
    assert sorted(got) == [1, 2, 4]
    assert got[1]["name"] == "é" and got[1]["day"] == dt.date(2024, 1, 2) and got[1]["ok"] is True
    assert (got[2]["name"], got[2]["day"], got[2]["ok"], got[2]["w"]) == (None, None, None, None)
    assert _xy(got[1]["geom"]) == [[[(1.0, 2.0)]]] and got[1]["geom"]["srid"] == 2193
    assert got[4]["geom"] is None and got[4]["ok"] is False


@pytest.mark.parametrize("text, srid", [
    ('GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984"]]', 4326),
    ('PROJCS["WGS_1984_UTM_Zone_33N",GEOGCS["GCS_WGS_1984"]]', 32633),
    ('PROJCS["WGS_1984_UTM_Zone_7S",GEOGCS["GCS_WGS_1984"]]', 32707),
    ('PROJCS["Somewhere",GEOGCS["GCS_WGS_1984"]]', 0),
])
def test_shapefile_system_by_name(tmp_path, text, srid):
    (tmp_path / "p.prj").write_text(text)
    assert shapefile._declared_srid(str(tmp_path / "p.shx")) == srid


@pytest.mark.parametrize("size", [1, 100, 1 << 20])
def test_shapefile_in_batches_of_bytes(tmp_path, monkeypatch, size):
    monkeypatch.setattr(shapefile, "BATCH_BYTES", size)
    rows = [[str(i), "n", "", "T", "1"] for i in range(20)]
    shapes = [[np.full((1 + i % 3, 2), float(i))] for i in range(20)]
    path = _save(tmp_path, "b", shp_bytes(3, shapes, FIELDS, rows, deleted=(4, 19)))
    fields = shapefile._table_header(path[:-3] + "dbf")[2]
    import pyarrow as pa
    piece = pa.RecordBatch.from_pylist([{"index": path[:-3] + "shx", "low": 2, "high": 19}])
    got = list(shapefile._reader(fields, "utf-8")([piece]))
    want = [i for i in range(2, 20) if i not in (4, 19)]
    assert [int(f[0]) for b in got for f in b.column("fields").to_pylist()] == want
    assert [r for b in got for r in b.column("record").to_pylist()] == want
    assert [s[0][0]["x"] for b in got for s in b.column("lines").to_pylist()] == [float(i) for i in want]


@pytest.mark.parametrize("code, lines, kind, parts", [
    (3, [[[0, 0], [1, 1]], [[5, 5], [6, 6], [7, 5]]], "MultiLineString", [[2], [3]]),
    (3, [[[0, 0], [1, 1]]], "LineString", [[2]]),
    (13, [[[0, 0, 1], [1, 1, 2]]], "LineString", [[2]]),
    (8, [[[0, 0], [1, 1], [2, 2]]], "MultiPoint", [[1], [1], [1]]),
    (11, [[[1, 2, 3]]], "Point", [[1]]),
    (5, [SQUARE, HOLE, FAR], "MultiPolygon", [[5, 5], [5]]),
    (15, [[[*p, 7] for p in SQUARE]], "Polygon", [[5]]),
])
def test_shapefile_kinds(spark, tmp_path, code, lines, kind, parts):
    shape = [np.array(line, float) for line in lines]
    path = _save(tmp_path, "k", shp_bytes(code, [shape] * 3, [("id", "N", 3, 0)], [["1"], ["2"], ["3"]]))
    rows = shapefile.read_shapefile(spark, path).collect()
    assert len(rows) == 3
    for row in rows:
        assert row["geom"]["kind"] == kind
        assert [[len(r) for r in part] for part in row["geom"]["parts"]] == parts
        z = row["geom"]["parts"][0][0][0]["z"]
        assert z == ({11: 3.0, 13: 1.0, 15: 7.0}.get(code))


@pytest.mark.parametrize("options", [
    {}, {"deflate": True}, {"order": ">"}, {"block": 16}, {"block": 16, "deflate": True, "order": ">"},
    {"strip_rows": 50, "deflate": True, "predictor": 2}, {"strip_rows": 7},
])
@pytest.mark.parametrize("kind, bands", [("u1", 1), ("f4", 2), ("i2", 3)])
def test_raster_layouts(spark, tmp_path, options, kind, bands):
    if options.get("predictor") == 2 and kind == "f4":
        pytest.skip("horizontal differencing is for integers")
    height, width, tile = 37, 45, 16
    grid = (np.arange(bands * height * width) * 31 % 120).astype(kind).reshape(bands, height, width)
    (tmp_path / "g.tif").write_bytes(tiff(grid, 100.0, 900.0, 2.0, 2193, nodata="0", **options))
    rows = raster.read_raster(spark, str(tmp_path / "g.tif"), tile, pixels_per_piece=32).collect()
    assert sorted(r["rid"] for r in rows) == list(range(1, 10))
    for r in rows:
        y, x = r["tile_row"] * tile, r["tile_col"] * tile
        want = grid[:, y : y + tile, x : x + tile]
        assert (r["height"], r["width"]) == want.shape[1:]
        assert np.array_equal(np.array(r["bands"]).reshape(want.shape), want.astype(float))
        assert (r["xmin"], r["ymax"]) == (100.0 + 2 * x, 900.0 - 2 * y)
        assert (r["xmax"], r["ymin"]) == (r["xmin"] + 2 * r["width"], r["ymax"] - 2 * r["height"])
        assert (r["srid"], r["nodata"], r["scale_y"]) == (2193, 0.0, -2.0)


def test_small_pieces_of_rasters_share_tasks_and_frames(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    grids = {}
    for name in range(30):
        grids[name] = rng.integers(0, 200, (1, 9, 13)).astype("u1")
        (tmp_path / f"{name}.tif").write_bytes(tiff(
            grids[name], 0.0, 0.0, 1.0, 2193, deflate=bool(name % 2), nodata="7" if name % 3 else None))
    tiles = raster.read_raster(spark, str(tmp_path), 4, pixels_per_piece=4)
    # 12 pieces a raster.
    assert tiles.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    rows = tiles.collect()
    assert sorted(r.rid for r in rows) == list(range(min(r.rid for r in rows), min(r.rid for r in rows) + 360))
    for r in rows:
        name, y, x = int(r.path.split("/")[-1].removesuffix(".tif")), r.tile_row * 4, r.tile_col * 4
        assert r.bands == [grids[name][0, y:y + 4, x:x + 4].ravel().astype("f8").tolist()]
        assert r.nodata == (7.0 if name % 3 else None)


def test_raster_exact_multiple_and_assigned_srid(spark, tmp_path):
    (tmp_path / "m.tif").write_bytes(tiff(np.ones((1, 32, 32), "u1"), 0, 0, 1, 4326))
    rows = raster.read_raster(spark, str(tmp_path), 16, epsg=2193).collect()
    assert len(rows) == 4 and {r["srid"] for r in rows} == {2193} and {r["width"] for r in rows} == {16}
    with pytest.raises(ValueError):
        raster.read_raster(spark, str(tmp_path), 0)


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        shapefile.read_shapefile(spark, str(tmp_path))


def test_ids_in_file_order_are_dense(spark, table):
    rows = columns.add_feature_id(table("orders").select("o_orderkey").repartition(7))
    assert sorted(r["gid"] for r in rows.collect()) == list(range(1, rows.count() + 1))
    hot = table("orders").select((F.col("o_orderkey") % 2).alias("k"))
    ordered = columns.add_feature_id(hot, "id", ["k"]).orderBy("id").collect()
    assert [r["k"] for r in ordered] == sorted(r["k"] for r in ordered)
    with pytest.raises(ValueError):
        columns.add_feature_id(hot, "k")
    assert columns.add_feature_id(hot.limit(0)).count() == 0
    assert re.match("gid", columns.add_feature_id(hot.limit(1)).columns[0])
