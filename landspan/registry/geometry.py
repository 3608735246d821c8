"""Queries over geometry columns: georeference, bytes, area, union, layout."""

from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.functions import wkb
from landspan.operators import columns, georef, layout
from landspan.plans import derived
from landspan.plans.derived import table


def _places(df, key: str, digits: int, column: str = "geom"):
    """Key, SRID and rounded position of point geometries."""
    v = geo.first_vertex(column)
    return df.select(
        key, F.col(column)["srid"].alias("srid"), F.col(column)["kind"].alias("kind"),
        F.round(v["x"], digits).alias("x"), F.round(v["y"], digits).alias("y"),
    )


def b_set_srid(spark, folder):
    points = derived.customer_points(table(spark, folder, "customer"), srid=0)
    return _places(geo.set_srid(points, "geom", 2193), "c_custkey", 6)


def b_reproject_3857(spark, folder):
    points = derived.customer_points(table(spark, folder, "customer"))
    return _places(geo.reproject(points, "geom", 3857, 4326, points_only=True), "c_custkey", 3)


def b_reproject_2193(spark, folder):
    points = derived.zone_points(table(spark, folder, "customer"))
    return _places(geo.reproject(points, "geom", 2193, 4326, points_only=True), "c_custkey", 3)


def b_reproject_utm(spark, folder):
    """To UTM zone 59 south and back: the inverse series."""
    points = derived.zone_points(table(spark, folder, "customer"))
    there = geo.reproject(points, "geom", 32759, 4326, points_only=True)
    return _places(geo.reproject(there, "geom", 4326, points_only=True), "c_custkey", 6)


def b_reproject_polygons(spark, folder):
    """Part rectangles as offsets in metres around a place, to longitude/latitude."""
    rects = derived.part_rectangles(table(spark, folder, "part"))
    rects = geo.set_srid(rects, "geom", 3857)
    moved = geo.reproject(rects, "geom", 4326)
    box = {n: F.round(c, 9).alias(n) for n, c in geo.bounds("geom").items()}
    return moved.select("p_partkey", F.col("geom.srid").alias("srid"), *box.values())


def b_crs_rule(spark, folder):
    """One target for rows that declare 4326, 3857 or nothing."""
    points = derived.customer_points(table(spark, folder, "customer"))
    k = F.col("c_custkey") % 3
    metres = geo.reproject(points.where(k == 2), "geom", 3857, 4326, points_only=True)
    bare = geo.set_srid(points.where(k == 0), "geom", 0)
    mixed = metres.unionByName(bare).unionByName(points.where(k == 1))
    return _places(georef.apply_epsg(mixed, "geom", 3857, points_only=True), "c_custkey", 3)


def b_crs_rule_pair(spark, folder):
    """a:b on rows that declare a or nothing."""
    points = derived.zone_points(table(spark, folder, "customer"))
    srid = F.when(F.col("c_custkey") % 2 == 0, 4326).otherwise(0)
    points = points.withColumn("geom", F.col("geom").withField("srid", srid))
    moved = georef.apply_epsg(points, "geom", "4326:2193", points_only=True)
    return _places(moved, "c_custkey", 3)


def b_wkb_roundtrip(spark, folder):
    points = derived.customer_points(table(spark, folder, "customer"), srid=0)
    coded = wkb.encode(points, "geom", hex_text=True).select("c_custkey", F.col("geom").alias("hex"))
    back = wkb.decode(coded.withColumn("geom", F.col("hex")), "geom", hex_text=True)
    v = geo.first_vertex("geom")
    return back.select("c_custkey", "hex", v["x"].alias("x"), v["y"].alias("y"))


def b_wkb_polygons(spark, folder):
    rects = derived.part_rectangles(table(spark, folder, "part"))
    coded = wkb.encode(rects.select("p_partkey", "geom"), "geom")
    back = wkb.decode(coded.withColumn("hex", F.hex("geom")), "geom")
    return back.select("p_partkey", "hex", F.col("geom.kind").alias("kind"),
                       F.size(F.col("geom.parts")[0]).alias("rings"))


def b_attributes_only(spark, folder):
    points = derived.customer_points(table(spark, folder, "customer"))
    return columns.attributes_only(points)


def b_rename_geom(spark, folder):
    points = derived.customer_points(table(spark, folder, "customer"))
    return _places(columns.rename_geometry(points, "the_geom"), "c_custkey", 6, "the_geom")


def b_promote_multi(spark, folder):
    points = derived.customer_points(table(spark, folder, "customer"))
    return _places(geo.promote_to_multi(points, "geom"), "c_custkey", 6)


def d_bbox_morton(spark, folder):
    boxed = layout.add_bounds(derived.part_rectangles(table(spark, folder, "part")), "geom")
    frame = layout.frame_of(boxed)
    return layout.cluster(boxed.drop("geom"), frame).select("p_partkey", *layout.BOX, "morton")


def d_box_filter(spark, folder):
    boxed = layout.add_bounds(derived.part_rectangles(table(spark, folder, "part")), "geom")
    return layout.in_box(boxed, (100.0, 0.0, 20_000.0, 150.0)).select("p_partkey", *layout.BOX)


def e_sum_area(spark, folder):
    rects = derived.part_rectangles(table(spark, folder, "part"))
    return rects.groupBy("p_brand").agg(F.round(F.sum(geo.area("geom")), 4).alias("area"))


def e_union_points(spark, folder):
    """Distinct whole-degree positions of the customers of each nation."""
    points = derived.customer_points(table(spark, folder, "customer"))
    v = geo.first_vertex("geom")
    coarse = points.withColumn("geom", geo.point(F.floor(v["x"] / 4), F.floor(v["y"] / 4), srid=4326))
    merged = geo.union_points(coarse, ["c_nationkey"], "geom")
    spots = F.transform(geo.vertices("geom"), lambda p: F.concat_ws(
        " ", p["x"].cast("int"), p["y"].cast("int")))
    return merged.select("c_nationkey", F.col("geom.kind").alias("kind"),
                         F.array_join(spots, ",").alias("spots"))


def e_extent(spark, folder):
    rects = derived.part_rectangles(table(spark, folder, "part"))
    return geo.extent(rects, ["p_brand"], "geom")


QUERIES = {f.__name__: f for f in (
    b_set_srid, b_reproject_3857, b_reproject_2193, b_reproject_utm, b_reproject_polygons,
    b_crs_rule, b_crs_rule_pair, b_wkb_roundtrip, b_wkb_polygons, b_attributes_only,
    b_rename_geom, b_promote_multi, d_bbox_morton, d_box_filter, e_sum_area, e_union_points,
    e_extent,
)}

_POINTS = """pts AS (SELECT c_custkey, c_nationkey,
    -180.0::DOUBLE + (c_custkey * 37 % 36000) / 100.0::DOUBLE AS lon,
    -80.0::DOUBLE + (c_custkey * 53 % 16000) / 100.0::DOUBLE AS lat FROM customer)"""
_ZONE = """pts AS (SELECT c_custkey, 166.0::DOUBLE + (c_custkey * 37 % 1300) / 100.0::DOUBLE AS lon,
    -47.0::DOUBLE + (c_custkey * 53 % 1300) / 100.0::DOUBLE AS lat FROM customer)"""
_MX, _MY = "6378137.0 * radians(lon)", "6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2))"
_RECTS = """rects AS (SELECT p_partkey, p_brand, p_partkey % 2 = 0 AS holed,
    (p_partkey % 1000) * 100.0::DOUBLE AS x, (p_partkey // 1000) * 100.0::DOUBLE AS y,
    p_size::DOUBLE AS w, (p_partkey % 7 + 1)::DOUBLE AS h FROM part)"""
# Transverse Mercator forward, by the Krueger series to the fourth order.
_TM = """
    ell AS (SELECT 1 / 298.257222101::DOUBLE AS f),
    con AS (SELECT f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM ell),
    coef AS (SELECT n, e, 6378137.0::DOUBLE / (1 + n) * (1 + n**2 / 4 + n**4 / 64) AS r,
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180 AS a1,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440 AS a2,
        61 * n**3 / 240 - 103 * n**4 / 140 AS a3, 49561 * n**4 / 161280 AS a4 FROM con),
    conf AS (SELECT c_custkey, coef.*, radians(lon - 173) AS lam,
        sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM pts, coef),
    ang AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM conf),
    nztm AS (SELECT c_custkey,
        1600000 + 0.9996::DOUBLE * r * (eta + a1 * cos(2 * xi) * sinh(2 * eta)
            + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)
            + a4 * cos(8 * xi) * sinh(8 * eta)) AS x,
        10000000 + 0.9996::DOUBLE * r * (xi + a1 * sin(2 * xi) * cosh(2 * eta)
            + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)
            + a4 * sin(8 * xi) * cosh(8 * eta)) AS y FROM ang)"""


def _spread_sql(cell: str) -> str:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        cell = f"(((({cell}) << {shift}) | ({cell})) & {mask})"
    return cell


def _rect_text(kind: str) -> str:
    """WKT of a rectangle with its hole, spelled by SQL."""
    outer = ("'(' || x || ' ' || y || ', ' || x || ' ' || (y + h) || ', ' || (x + w) || ' ' || (y + h)"
             " || ', ' || (x + w) || ' ' || y || ', ' || x || ' ' || y || ')'")
    hole = ("', (' || (x+0.25) || ' ' || (y+0.25) || ', ' || (x+0.75) || ' ' || (y+0.25) || ', ' ||"
            " (x+0.75) || ' ' || (y+0.75) || ', ' || (x+0.25) || ' ' || (y+0.75) || ', ' ||"
            " (x+0.25) || ' ' || (y+0.25) || ')'")
    return f"'{kind}(' || {outer} || CASE WHEN holed THEN {hole} ELSE '' END || ')'"


ORACLES = {
    "b_set_srid": f"""WITH {_POINTS} SELECT c_custkey, 2193 AS srid, 'Point' AS kind,
        round(lon, 6) AS x, round(lat, 6) AS y FROM pts""",
    "b_reproject_3857": f"""WITH {_POINTS} SELECT c_custkey, 3857 AS srid, 'Point' AS kind,
        round({_MX}, 3) AS x, round({_MY}, 3) AS y FROM pts""",
    "b_reproject_2193": f"""WITH {_ZONE}, {_TM} SELECT c_custkey, 2193 AS srid, 'Point' AS kind,
        round(x, 3) AS x, round(y, 3) AS y FROM nztm""",
    "b_reproject_utm": f"""WITH {_ZONE} SELECT c_custkey, 4326 AS srid, 'Point' AS kind,
        round(lon, 6) AS x, round(lat, 6) AS y FROM pts""",
    "b_reproject_polygons": f"""WITH {_RECTS} SELECT p_partkey, 4326 AS srid,
        round(degrees(x / 6378137.0), 9) AS xmin,
        round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 9) AS ymin,
        round(degrees((x + w) / 6378137.0), 9) AS xmax,
        round(degrees(2 * atan(exp((y + h) / 6378137.0)) - pi() / 2), 9) AS ymax FROM rects""",
    "b_crs_rule": f"""WITH {_POINTS} SELECT c_custkey, 3857 AS srid, 'Point' AS kind,
        round(CASE WHEN c_custkey % 3 = 0 THEN lon ELSE {_MX} END, 3) AS x,
        round(CASE WHEN c_custkey % 3 = 0 THEN lat ELSE {_MY} END, 3) AS y FROM pts""",
    "b_crs_rule_pair": f"""WITH {_ZONE}, {_TM} SELECT c_custkey, 2193 AS srid, 'Point' AS kind,
        round(x, 3) AS x, round(y, 3) AS y FROM nztm""",
    "b_wkb_roundtrip": f"""WITH {_POINTS} SELECT c_custkey,
        hex(st_aswkb(CAST('POINT(' || lon || ' ' || lat || ')' AS GEOMETRY))) AS hex,
        lon AS x, lat AS y FROM pts""",
    "b_wkb_polygons": f"""WITH {_RECTS} SELECT p_partkey,
        hex(st_aswkb(CAST({_rect_text("POLYGON")} AS GEOMETRY))) AS hex, 'Polygon' AS kind,
        CASE WHEN holed THEN 2 ELSE 1 END AS rings FROM rects""",
    "b_attributes_only": "SELECT c_custkey, c_nationkey FROM customer",
    "b_rename_geom": f"""WITH {_POINTS} SELECT c_custkey, 4326 AS srid, 'Point' AS kind,
        round(lon, 6) AS x, round(lat, 6) AS y FROM pts""",
    "b_promote_multi": f"""WITH {_POINTS} SELECT c_custkey, 4326 AS srid, 'MultiPoint' AS kind,
        round(lon, 6) AS x, round(lat, 6) AS y FROM pts""",
    "d_bbox_morton": f"""WITH {_RECTS},
        frame AS (SELECT min(x) AS x0, max(x + w) AS x1, min(y) AS y0, max(y + h) AS y1 FROM rects),
        cells AS (SELECT *,
            CAST(floor(((x + (x + w)) / 2 - x0) / (x1 - x0) * 65535) AS BIGINT) AS cx,
            CAST(floor(((y + (y + h)) / 2 - y0) / (y1 - y0) * 65535) AS BIGINT) AS cy
            FROM rects, frame)
        SELECT p_partkey, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax,
            {_spread_sql("cx")} | ({_spread_sql("cy")} << 1) AS morton FROM cells""",
    "d_box_filter": f"""WITH {_RECTS}
        SELECT p_partkey, x AS xmin, y AS ymin, x + w AS xmax, y + h AS ymax FROM rects
        WHERE x <= 20000 AND x + w >= 100 AND y <= 150 AND y + h >= 0""",
    "e_sum_area": f"""WITH {_RECTS} SELECT p_brand,
        round(sum(w * h - CASE WHEN holed THEN 0.25 ELSE 0 END), 4) AS area FROM rects GROUP BY 1""",
    "e_union_points": f"""WITH {_POINTS},
        spots AS (SELECT DISTINCT c_nationkey, CAST(floor(lon / 4) AS INTEGER) AS x,
            CAST(floor(lat / 4) AS INTEGER) AS y FROM pts)
        SELECT c_nationkey, 'MultiPoint' AS kind,
            string_agg(x || ' ' || y, ',' ORDER BY x, y) AS spots FROM spots GROUP BY 1""",
    "e_extent": f"""WITH {_RECTS} SELECT p_brand, min(x) AS xmin, min(y) AS ymin,
        max(x + w) AS xmax, max(y + h) AS ymax FROM rects GROUP BY 1""",
}
