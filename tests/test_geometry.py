import math
import struct

import pytest
from pyspark.sql import functions as F

from landspan.functions import crs, wkb
from landspan.functions import geometry as geo
from landspan.operators import georef

Z = None


def v(x, y, z=None):
    return {"x": float(x), "y": float(y), "z": z}


SHAPES = {
    "point": ("Point", [[[v(1, 2)]]]),
    "point_z": ("Point", [[[v(1, 2, 3.0)]]]),
    "point_empty": ("Point", []),
    "line": ("LineString", [[[v(0, 0), v(1, 1), v(2, 0)]]]),
    "polygon_hole": ("Polygon", [[[v(0, 0), v(0, 9), v(9, 9), v(9, 0), v(0, 0)],
                                  [v(1, 1), v(2, 1), v(2, 2), v(1, 2), v(1, 1)]]]),
    "multipoint": ("MultiPoint", [[[v(1, 1)]], [[v(2, 2)]]]),
    "multiline": ("MultiLineString", [[[v(0, 0), v(1, 1)]], [[v(5, 5), v(6, 6), v(7, 5)]]]),
    "multipolygon": ("MultiPolygon", [[[v(0, 0), v(0, 1), v(1, 1), v(0, 0)]],
                                      [[v(5, 5), v(5, 7), v(7, 7), v(5, 5)]]]),
    "polygon_z": ("Polygon", [[[v(0, 0, 1.0), v(0, 1, 2.0), v(1, 1, 3.0), v(0, 0, 1.0)]]]),
    "line_empty": ("LineString", []),
}


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(name, (0, kind, parts)) for name, (kind, parts) in SHAPES.items()]
    return spark.createDataFrame([*rows, ("nothing", None)], f"name string, geom {geo.GEOMETRY_DDL}")


def test_wkb_round_trip_of_every_kind(shapes):
    for hexed in (False, True):
        back = wkb.decode(wkb.encode(shapes, "geom", hexed), "geom", hexed)
        got = {r["name"]: r["geom"] and r["geom"].asDict(recursive=True) for r in back.collect()}
        assert got.pop("nothing") is None
        for name, (kind, parts) in SHAPES.items():
            assert got[name] == {"srid": 0, "kind": kind, "parts": parts}, name


def test_wkb_byte_orders_and_extended_form(spark):
    big = struct.pack(">BI2d", 0, 1, 5, 6)
    ewkb = struct.pack("<BII3d", 1, 1 | 0x80000000 | 0x20000000, 2193, 5, 6, 7)
    iso_m = struct.pack("<BI3d", 1, 2001, 5, 6, 99)
    df = spark.createDataFrame([(1, big), (2, ewkb), (3, iso_m), (4, None)], "id int, geom binary")
    got = {r["id"]: r["geom"] for r in wkb.decode(df, "geom").collect()}
    assert got[1]["parts"][0][0][0].asDict() == v(5, 6)
    assert (got[2]["srid"], got[2]["parts"][0][0][0]["z"]) == (2193, 7.0)
    assert got[3]["parts"][0][0][0].asDict() == v(5, 6)
    assert got[4] is None


def test_wkb_all_null_and_empty_input(spark):
    df = spark.createDataFrame([(None,), (None,)], f"geom {geo.GEOMETRY_DDL}")
    assert [r[0] for r in wkb.encode(df, "geom").collect()] == [None, None]
    assert wkb.encode(df.limit(0), "geom").count() == 0


def test_area_bounds_promote(shapes):
    boxes = geo.bounds("geom")
    rows = geo.promote_to_multi(shapes, "geom").select(
        "name", F.col("geom.kind").alias("kind"), geo.area("geom").alias("area"),
        *[c.alias(n) for n, c in boxes.items()]).collect()
    got = {r["name"]: r for r in rows}
    assert got["polygon_hole"]["area"] == 80.0
    assert got["multipolygon"]["area"] == 2.5
    assert got["line"]["area"] == 0.0 and got["nothing"]["area"] is None
    assert got["multiline"]["xmax"] == 7.0 and got["point_empty"]["xmin"] is None
    assert got["point"]["kind"] == "MultiPoint" and got["multiline"]["kind"] == "MultiLineString"
    assert got["nothing"]["kind"] is None


def _meridian_arc(lat: float, a: float, inv_f: float) -> float:
    """Length from the equator by Simpson's rule on the radius of curvature."""
    f = 1 / inv_f
    e2 = f * (2 - f)
    n = 20_000
    h = math.radians(lat) / n
    rho = lambda p: a * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    return h / 3 * sum(rho(i * h) * (1 if i in (0, n) else 4 if i % 2 else 2) for i in range(n + 1))


def test_central_meridian_equals_integrated_arc(spark):
    lats = [-47.0, -41.5, -34.25]
    df = spark.createDataFrame([(173.0, lat) for lat in lats], "lon double, lat double")
    df = df.withColumn("geom", geo.point(F.col("lon"), F.col("lat"), srid=4326))
    for row in geo.reproject(df, "geom", 2193, 4326).collect():
        spot = row["geom"]["parts"][0][0][0]
        want = 10_000_000 + 0.9996 * _meridian_arc(row["lat"], *crs.GRS80)
        assert abs(spot["x"] - 1_600_000) < 1e-6 and abs(spot["y"] - want) < 1e-4


@pytest.mark.parametrize("epsg", [3857, 2193, 32759, 32601])
def test_there_and_back_for_points_and_lines(spark, epsg):
    lon0 = -177 if epsg == 32601 else 172
    lat0 = 40 if epsg == 32601 else -40
    df = spark.range(40).select("id", *[
        F.expr(f"{lon0} + id % 7 / 3D").alias("x"), F.expr(f"{lat0} + id % 5 / 4D").alias("y")])
    one = geo.point(F.col("x"), F.col("y"), srid=4326)
    line = geo.geometry("LineString", F.array(F.array(F.array(
        geo.vertex(F.col("x"), F.col("y")), geo.vertex(F.col("x") + 1, F.col("y"), F.lit(7.0))))), 4326)
    df = df.withColumn("geom", F.when(F.col("id") % 2 == 0, one).otherwise(line))
    there = geo.reproject(df, "geom", epsg)
    # Rows that declare their system: no source is named on the way back.
    for row in geo.reproject(there, "geom", 4326).collect():
        first = row["geom"]["parts"][0][0][0]
        assert abs(first["x"] - row["x"]) < 1e-9 and abs(first["y"] - row["y"]) < 1e-9
        assert row["geom"]["srid"] == 4326
        if row["id"] % 2:
            second = row["geom"]["parts"][0][0][1]
            assert abs(second["x"] - row["x"] - 1) < 1e-9 and second["z"] == 7.0


def test_points_and_arrow_path_agree(spark):
    df = spark.range(50).select(F.expr("166 + id / 5D").alias("x"), F.expr("-46 + id / 6D").alias("y"))
    as_point = geo.reproject(df.withColumn("geom", geo.point(F.col("x"), F.col("y"), srid=4326)), "geom", 2193)
    as_multi = df.withColumn("geom", geo.geometry(
        "MultiPoint", F.array(F.array(F.array(geo.vertex(F.col("x"), F.col("y"))))), 4326))
    got = [tuple(r["geom"]["parts"][0][0][0])[:2] for r in as_point.orderBy("x").collect()]
    want = [tuple(r["geom"]["parts"][0][0][0])[:2]
            for r in geo.reproject(as_multi, "geom", 2193).orderBy("x").collect()]
    assert all(abs(a - b) < 1e-6 for p, q in zip(got, want) for a, b in zip(p, q))


def test_outside_mercator_and_null_and_empty(spark):
    rows = [("polar", (4326, "Point", [[[v(0, 89)]]])), ("none", None), ("empty", (4326, "Point", [])),
            ("line", (4326, "LineString", [[[v(0, 0), v(0, 89)]]])), ("ok", (4326, "Point", [[[v(0, 0)]]]))]
    df = spark.createDataFrame(rows, f"name string, geom {geo.GEOMETRY_DDL}")
    points = geo.reproject(df.where("name <> 'line'"), "geom", 3857, points_only=True)
    for row in points.collect():
        assert (row["geom"] is None) == (row["name"] in ("polar", "none"))
    got = {r["name"]: r["geom"] for r in geo.reproject(df, "geom", 3857).collect()}
    assert got["polar"] is None and got["line"] is None and got["none"] is None
    assert got["empty"]["parts"] == [] and got["empty"]["srid"] == 3857
    assert got["ok"]["parts"][0][0][0].asDict() == v(0, 0)


def test_unsupported_codes_raise(spark):
    df = spark.createDataFrame([((27700, "Point", [[[v(1, 1)]]]),)], f"geom {geo.GEOMETRY_DDL}")
    with pytest.raises(ValueError):
        geo.reproject(df, "geom", 27700)
    with pytest.raises(Exception, match="27700"):
        geo.reproject(df, "geom", 4326).collect()
    line = spark.createDataFrame([((4326, "LineString", [[[v(1, 1)]]]),)], f"geom {geo.GEOMETRY_DDL}")
    with pytest.raises(Exception, match="points_only"):
        geo.reproject(line, "geom", 3857, points_only=True).collect()


@pytest.mark.parametrize("option, parsed", [
    (None, (None, None)), (4326, (None, 4326)), ("2193", (None, 2193)), ("4326:2193", (4326, 2193))])
def test_parse_epsg(option, parsed):
    assert georef.parse_epsg(option) == parsed


@pytest.mark.parametrize("option", ["1:2:3", "x", 1.5])
def test_parse_epsg_rejects(option):
    with pytest.raises(ValueError):
        georef.parse_epsg(option)


def test_epsg_pair_rejects_other_srid(spark):
    df = spark.createDataFrame([((3857, "Point", [[[v(1, 1)]]]),)], f"geom {geo.GEOMETRY_DDL}")
    with pytest.raises(Exception, match="declares SRID 3857"):
        georef.apply_epsg(df, "geom", "4326:2193").collect()
    assert georef.apply_epsg(df, "geom", None) is df
    same = georef.apply_epsg(df, "geom", "3857:3857").first()["geom"]
    assert same["srid"] == 3857 and same["parts"][0][0][0].asDict() == v(1, 1)


def _square(x, y, size, clockwise=True):
    ring = [v(x, y), v(x, y + size), v(x + size, y + size), v(x + size, y), v(x, y)]
    return ring if clockwise else ring[::-1]


def test_ring_parts_nest_holes_and_islands(spark):
    lake, island, pond = _square(1, 1, 8, False), _square(2, 2, 5), _square(3, 3, 1, False)
    far, loose = _square(50, 50, 2), _square(90, 90, 1, False)
    rings = [pond, island, far, lake, _square(0, 0, 10), loose]
    df = spark.createDataFrame([(rings,), ([far],)], "rings array<array<struct<x:double,y:double,z:double>>>")
    many, single = [r[0] for r in df.select(geo.ring_parts(F.col("rings"))).collect()]
    starts = sorted(tuple(ring[0]["x"] for ring in part) for part in many)
    assert starts == [(0.0, lake[0]["x"]), (2.0, pond[0]["x"]), (50.0,), (90.0,)]
    assert len(single) == 1


def test_union_points_keeps_every_vertex(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3 == 0).cast("int").alias("k"),
        geo.point(F.col("id") % 700, F.col("id") % 11).alias("geom"))
    whole = {r["k"]: r["geom"]["parts"] for r in geo.union_points(df, ["k"], "geom").collect()}
    rows = geo.distinct_points(df, ["k"], "geom").collect()
    for key in (0, 1):
        want = {(float(i % 700), float(i % 11), None) for i in range(5000) if (i % 3 == 0) == bool(key)}
        assert sorted(tuple(p[0][0]) for p in whole[key]) == sorted(want)
        assert sorted((r["x"], r["y"], r["z"]) for r in rows if r["k"] == key) == sorted(want)


def test_union_of_other_kinds_raises(spark):
    line = geo.geometry("LineString", F.array(F.array(F.array(geo.vertex(F.lit(0.0), F.lit(0.0), F.lit(None))))), 0)
    df = spark.range(1).select(F.lit(1).alias("k"), line.alias("geom"))
    with pytest.raises(Exception, match="union of points holds a LineString"):
        geo.union_points(df, ["k"], "geom").collect()