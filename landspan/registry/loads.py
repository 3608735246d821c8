"""Queries over the dataset readers and the load."""

from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.operators import checks, columns, layout
from landspan.registry import fixtures as files
from landspan.plans.derived import table
from landspan.plans.load import DuckDBSource, Destination, RasterSource, load
from landspan.registry.common import scratch_schema
from landspan.sources import csv, duckdb, features, raster, shapefile, wfs
from landspan.workspace import materialize, scratch_path

TILE = 16


def a_csv(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "customer").write.option("header", "true").csv(path)
    return csv.read_csv(
        spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    )


def a_csv_inferred(spark, folder):
    path = scratch_path(spark, "csv")
    customer = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    customer.write.option("header", "true").csv(path)
    rows = csv.read_csv(spark, path)
    kinds = ",".join(f.dataType.simpleString() for f in rows.schema.fields)
    return rows.withColumn("kinds", F.lit(kinds))


def a_csv_dialects(spark, folder):
    """Customers in three dialects, with quoted line breaks, read as found in small ranges."""
    note = F.concat(F.lit("of "), "c_mktsegment", F.lit('\n"'), "c_name", F.lit('";\t'), F.col("c_custkey") % 7)
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), note.alias("note"), F.col("c_acctbal").alias("balance"),
        F.expr("DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT)").alias("since"))
    found = None
    for separator, header in ((";", True), ("\t", True), ("|", False)):
        path = scratch_path(spark, "csv")
        customer.write.option("header", header).option("sep", separator).option("escape", '"').csv(path)
        rows = csv.read_csv_as_found(spark, path, range_bytes=8192)
        kinds = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        rows = rows.toDF(*customer.columns).select(
            F.lit(separator).alias("separator"), "*", F.lit(kinds).alias("kinds"))
        found = rows if found is None else found.unionByName(rows)
    return found


def a_duckdb(spark, folder):
    path = files.customer_duckdb(spark, table(spark, folder, "customer"))
    rows = duckdb.read_duckdb(spark, path, "sales.customers", rows_per_task=200)
    v = geo.first_vertex("geom")
    return columns.launder(rows).select(
        "cust_key", "full_name", "balance_", F.col("big").cast("long").alias("big"),
        v["x"].alias("x"), v["y"].alias("y"),
    )


def b_launder(spark, folder):
    path = files.customer_duckdb(spark, table(spark, folder, "customer"))
    rows = columns.launder(duckdb.read_duckdb(spark, path, "sales.customers"))
    flags = {f: sorted(duckdb.declared(rows, f)) for f in (duckdb.KEY, duckdb.NOT_NULL, duckdb.DEFAULT)}
    text = ";".join(f"{name}={','.join(found)}" for name, found in sorted(flags.items()))
    return rows.agg(
        F.count("*").alias("customers"), F.lit(",".join(rows.columns)).alias("names"),
    ).withColumn("flags", F.lit(text))


def _features(spark, folder, kind):
    rows = features.parse_pages(files.feature_pages(table(spark, folder, "customer"), kind), kind)
    v = geo.first_vertex("geom")
    return rows.select(
        "OBJECTID", "Name", "Balance", "Edited", F.col("geom.srid").alias("srid"),
        v["x"].alias("x"), v["y"].alias("y"),
    )


def a_esri_json(spark, folder):
    return _features(spark, folder, features.ESRI_JSON)


def a_geojson(spark, folder):
    return _features(spark, folder, features.GEOJSON)


def a_wfs(spark, folder):
    path = files.wfs_files(spark, table(spark, folder, "customer"))
    rows = wfs.read_wfs(spark, path, "shop:customer")
    v = geo.first_vertex("place")
    return rows.select("gml_id", "key", "name", F.col("place.srid").alias("srid"),
                       v["x"].alias("x"), v["y"].alias("y"))


def a_wfs_shapes(spark, folder):
    """Curves with arcs, composite curves and surfaces: kind, parts, vertices, box and length."""
    path = files.wfs_shape_files(spark, table(spark, folder, "customer"))
    rows = wfs.read_wfs(spark, path, "shop:area")
    lines = F.flatten(F.col("shape.parts"))
    length = F.aggregate(F.transform(lines, lambda line: F.aggregate(
        F.sequence(F.lit(1), F.size(line) - 1), F.lit(0.0),
        lambda s, i: s + F.hypot(F.get(line, i)["x"] - F.get(line, i - 1)["x"],
                                 F.get(line, i)["y"] - F.get(line, i - 1)["y"]))), F.lit(0.0), lambda s, v: s + v)
    box = {n: F.round(c, 6).alias(n) for n, c in geo.bounds("shape").items()}
    return rows.select("key", F.col("shape.kind").alias("kind"), F.size("shape.parts").alias("parts"),
                       F.size(geo.vertices("shape")).alias("vertices"), F.round(length, 5).alias("length"), *box.values())


def a_shapefile(spark, folder):
    path = files.rectangle_shapefiles(spark, table(spark, folder, "part"))
    rows = shapefile.read_shapefile(spark, path, rows_per_task=150)
    box = {n: c.alias(n) for n, c in geo.bounds("geom").items()}
    return rows.select(
        F.col("PARTKEY").alias("partkey"), F.col("Brand").alias("brand"),
        F.col("QUARTER").alias("quarter"), F.col("geom.kind").alias("kind"),
        geo.area("geom").alias("area"), *box.values(),
    )


def _tiles(spark, folder):
    path = files.raster_files(spark, table(spark, folder, "orders"), turned=True)
    return raster.read_raster(spark, path, TILE, pixels_per_piece=32)


def _number():
    return F.regexp_extract("path", r"raster-(\d+)\.tif$", 1).cast("long")


def a_raster_tiles(spark, folder):
    """Tile windows with a checksum of their pixels, each weighted by its place."""
    band = F.col("bands")[0]
    total = F.aggregate(band, F.lit(0.0), lambda s, v: s + v)
    weighted = F.aggregate(
        F.transform(band, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v
    )
    return _tiles(spark, folder).select(
        _number().alias("raster"), "tile_col", "tile_row", "srid", "width", "height", "left", "top",
        "xmin", "ymin", "xmax", "ymax", "skew_x", "skew_y", "pixel_type",
        total.alias("total"), weighted.alias("weighted"),
    )


def c_raster_constraints(spark, folder):
    """The constraints over a whole table and over tables each of which breaks one."""
    # Only the number of bands matters.
    tiles = materialize(_tiles(spark, folder).withColumn(
        "bands", F.transform("bands", lambda b: F.array().cast("array<double>"))), "tiles")
    straight = tiles.where(_number() % 5 != 3)
    here = {name: F.expr(where) for name, where in (
        ("narrow", "tile_col = 1 AND tile_row = 0"), ("row", "tile_row = 1"),
        ("middle", "tile_col = 1 AND tile_row = 1"), ("later", "tile_col = 2 AND tile_row = 2"))}

    def changed(column, where, value):
        return straight.withColumn(column, F.when(here[where], value).otherwise(F.col(column)))

    variants = {
        "whole": straight, "turned": tiles.where(_number() % 5 == 3), "mixed": tiles,
        "narrow": changed("width", "narrow", F.lit(3)), "type": changed("pixel_type", "row", F.lit("16BSI")),
        "nodata": changed("nodata", "row", F.lit(0.0)), "moved": changed("left", "middle", F.col("left") + 5),
        "gap": straight.where(~here["middle"]), "twice": straight.unionByName(straight.where(here["later"])),
    }
    found = None
    for name, some in variants.items():
        rows = checks.raster_constraints(some).select(F.lit(name).alias("variant"), "name", "holds", "value")
        found = rows if found is None else found.unionByName(rows)
    return found


def c_raster_bounds(spark, folder):
    """All tiles, laid out by their boxes, and whether they meet a box."""
    schema = scratch_schema(spark, "raster")
    path = files.raster_files(spark, table(spark, folder, "orders"))
    tiles = load(spark, RasterSource(path, 2193), Destination(
        f"{schema}.tiles", tile_size=TILE, raster_index=True, raster_constraints=True))
    found = layout.in_box(tiles, (700.0, 600.0, 1500.0, 700.0)).select("rid", F.lit(True).alias("meets"))
    return tiles.join(found, "rid", "left").select(
        "rast.tile_col", "rast.tile_row", "xmin", "ymin", "xmax", "ymax",
        F.coalesce("meets", F.lit(False)).alias("meets"))


def a_load(spark, folder):
    """DuckDB files to a checked, clustered table in another coordinate system."""
    schema = scratch_schema(spark, "load")
    path = files.customer_duckdb(spark, table(spark, folder, "customer"))
    rows = load(spark, DuckDBSource(path, "sales.customers", epsg="4326:3857"),
                Destination(f"{schema}.customers", geom_column="place", geom_index=True))
    v = geo.first_vertex("place")
    return rows.select("cust_key", "full_name", F.col("place.srid").alias("srid"),
                       F.round(v["x"], 3).alias("x"), F.round(v["y"], 3).alias("y"))


QUERIES = {f.__name__: f for f in (
    a_csv, a_csv_inferred, a_csv_dialects, a_duckdb, b_launder, a_esri_json, a_geojson, a_wfs, a_wfs_shapes, a_shapefile,
    a_raster_tiles, c_raster_constraints, c_raster_bounds, a_load,
)}

_POINTS = """pts AS (SELECT *, -180.0::DOUBLE + (c_custkey * 37 % 36000) / 100.0::DOUBLE AS lon,
    -80.0::DOUBLE + (c_custkey * 53 % 16000) / 100.0::DOUBLE AS lat FROM customer)"""
_TILES = f"""
    pix AS (SELECT o_orderkey // 3000 AS raster, o_orderkey % 3000 AS pos,
        max(o_orderkey * 31 % 251) AS value FROM orders GROUP BY 1, 2),
    slots AS (SELECT raster, c AS tile_col, r AS tile_row,
        CASE WHEN c = 3 THEN 12 ELSE 16 END AS width, CASE WHEN r = 3 THEN 2 ELSE 16 END AS height
        FROM (SELECT DISTINCT raster FROM pix), range(4) cs(c), range(4) rs(r)),
    filled AS (SELECT s.*,
        coalesce(sum(value), 0)::DOUBLE AS total,
        coalesce(sum(value * ((pos // 60 - tile_row * {TILE}) * width + pos % 60 - tile_col * {TILE} + 1)),
            0)::DOUBLE AS weighted
        FROM slots s LEFT JOIN pix p ON p.raster = s.raster AND pos % 60 // {TILE} = tile_col
            AND pos // 60 // {TILE} = tile_row
        GROUP BY ALL),
    tiles AS (SELECT *, CASE WHEN {{TURNED}} THEN 2.0::DOUBLE ELSE 0 END AS skew_x,
        CASE WHEN {{TURNED}} THEN 1.0::DOUBLE ELSE 0 END AS skew_y, tile_col * 16 AS c, tile_row * 16 AS r FROM filled),
    boxes AS (SELECT *, raster * 600.0::DOUBLE + c * 10 + r * skew_x AS "left",
        1000.0::DOUBLE - r * 10 + c * skew_y AS top,
        raster * 600.0::DOUBLE + c * 10 + r * skew_x AS xmin,
        raster * 600.0::DOUBLE + (c + width) * 10 + (r + height) * skew_x AS xmax,
        1000.0::DOUBLE - (r + height) * 10 + c * skew_y AS ymin,
        1000.0::DOUBLE - r * 10 + (c + width) * skew_y AS ymax, '8BUI' AS pixel_type FROM tiles)"""
_STRAIGHT = _TILES.replace("{TURNED}", "false")
_TILES = _TILES.replace("{TURNED}", "raster % 5 = 3")
ORACLES = {
    "a_csv": "SELECT * FROM customer",
    "a_csv_inferred": """SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_acctbal,
        'int,string,double' AS kinds FROM customer""",
    "a_csv_dialects": """SELECT separator, c_custkey AS key,
        'of ' || c_mktsegment || chr(10) || '"' || c_name || '";' || chr(9) || c_custkey % 7 AS note,
        c_acctbal AS balance, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS since, kinds
        FROM customer, (VALUES (';', 'key bigint,note string,balance double,since date'),
            (chr(9), 'key bigint,note string,balance double,since date'),
            ('|', 'column0 bigint,column1 string,column2 double,column3 date')) d(separator, kinds)""",
    "a_duckdb": f"""WITH {_POINTS} SELECT c_custkey AS cust_key, c_name AS full_name,
        c_acctbal AS balance_, c_custkey AS big, lon AS x, lat AS y FROM pts""",
    "b_launder": """SELECT count(*) AS customers, 'cust_key,full_name,balance_,big,geom' AS names,
        'default=balance_;not_null=cust_key,full_name;primary_key=cust_key' AS flags FROM customer""",
    "a_esri_json": f"""WITH {_POINTS} SELECT c_custkey AS "OBJECTID", c_name AS "Name",
        c_acctbal AS "Balance", TIMESTAMP '1970-01-01' + to_days(CAST(c_custkey AS INTEGER)) AS "Edited",
        4326 AS srid, lon AS x, lat AS y FROM pts""",
    "a_geojson": f"""WITH {_POINTS} SELECT c_custkey AS "OBJECTID", c_name AS "Name",
        c_acctbal AS "Balance", c_custkey * 86400000 AS "Edited",
        4326 AS srid, lon AS x, lat AS y FROM pts""",
    "a_wfs": f"""WITH {_POINTS} SELECT 'customer.' || c_custkey AS gml_id, c_custkey AS key,
        c_name AS name, 4326 AS srid, lon AS x, lat AS y FROM pts""",
    "a_wfs_shapes": """WITH shapes AS (
            SELECT c_custkey AS key, c_custkey::DOUBLE AS x, (1 + c_custkey % 9) * 10.0::DOUBLE AS y,
                (1 + c_custkey % 9)::DOUBLE AS r, c_custkey % 5 AS k,
                -- Two quarters of 23 chords.
                46 * 2 * (1 + c_custkey % 9) * sin(pi() / 4 / 23) AS arc FROM customer)
        SELECT key, CASE WHEN k < 3 THEN 'LineString' ELSE 'MultiPolygon' END AS kind,
            CASE WHEN k < 3 THEN 1 ELSE 2 END AS parts,
            [48, 93, 48, 10, 10][k + 1] AS vertices,
            round([arc + 3 * r, 2 * arc, arc + r, 8 * r, 8 * r][k + 1], 5) AS length,
            x + r * [-1, -1, -2, 0, 0][k + 1] AS xmin, y + r * [0, -1, 0, 0, 0][k + 1] AS ymin,
            x + r * [4, 3, 1, 3, 3][k + 1] AS xmax, y + r AS ymax FROM shapes""",
    "a_shapefile": """SELECT p_partkey AS partkey, p_brand AS brand, p_size / 4.0::DOUBLE AS quarter,
        'Polygon' AS kind,
        p_size::DOUBLE * (p_partkey % 7 + 1) - CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0 END AS area,
        (p_partkey % 1000) * 100.0::DOUBLE AS xmin, (p_partkey // 1000) * 100.0::DOUBLE AS ymin,
        (p_partkey % 1000) * 100.0::DOUBLE + p_size AS xmax,
        (p_partkey // 1000) * 100.0::DOUBLE + p_partkey % 7 + 1 AS ymax FROM part""",
    "a_raster_tiles": f"""WITH {_TILES} SELECT raster, CAST(tile_col AS INTEGER) AS tile_col,
        CAST(tile_row AS INTEGER) AS tile_row, 2193 AS srid, width, height, "left", top,
        xmin, ymin, xmax, ymax, skew_x, skew_y, pixel_type, total, weighted FROM boxes""",
    "c_raster_constraints": f"""WITH {_TILES},
        plain AS (SELECT raster, tile_col, tile_row, width, height, "left", top, xmin, ymin, xmax, ymax, skew_x,
            skew_y, pixel_type, NULL::DOUBLE AS nodata FROM boxes),
        straight AS (FROM plain WHERE raster % 5 <> 3),
        variants AS (
            SELECT 'whole' AS variant, * FROM straight
            UNION ALL SELECT 'turned', * FROM plain WHERE raster % 5 = 3
            UNION ALL SELECT 'mixed', * FROM plain
            UNION ALL SELECT 'narrow', * REPLACE (CASE WHEN tile_col = 1 AND tile_row = 0 THEN 3 ELSE width END AS width)
                FROM straight
            UNION ALL SELECT 'type', * REPLACE (CASE WHEN tile_row = 1 THEN '16BSI' ELSE pixel_type END AS pixel_type)
                FROM straight
            UNION ALL SELECT 'nodata', * REPLACE (CASE WHEN tile_row = 1 THEN 0 ELSE nodata END AS nodata) FROM straight
            UNION ALL SELECT 'moved', * REPLACE ("left" + CASE WHEN tile_col = 1 AND tile_row = 1 THEN 5 ELSE 0 END
                AS "left") FROM straight
            UNION ALL SELECT 'gap', * FROM straight WHERE NOT (tile_col = 1 AND tile_row = 1)
            UNION ALL SELECT 'twice', * FROM straight
            UNION ALL SELECT 'twice', * FROM straight WHERE tile_col = 2 AND tile_row = 2),
        placed AS (SELECT *, (-10 * "left" - skew_x * top) / (-100 - skew_x * skew_y) AS px,
            (10 * top - skew_y * "left") / (-100 - skew_x * skew_y) AS py FROM variants),
        spots AS (SELECT variant, raster, px, py, count(*) AS copies FROM placed GROUP BY ALL),
        hulls AS (SELECT variant, raster, min(px) AS x0, max(px + width) AS x1, min(py) AS y0, max(py + height) AS y1,
            max(width) OVER v AS w, max(height) OVER v AS h
            FROM (SELECT variant, raster, px, py, max(width) AS width, max(height) AS height
                  FROM placed GROUP BY ALL) GROUP BY variant, raster, width, height WINDOW v AS (PARTITION BY variant)),
        hull AS (SELECT variant, raster, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1, max(w) AS w,
            max(h) AS h FROM hulls GROUP BY ALL),
        rasters AS (SELECT s.variant, s.raster, any_value(ceil((x1 - x0) / w) * ceil((y1 - y0) / h)) AS slots,
            count(*) AS spots, sum(copies) AS copies,
            bool_and((px - x0) % w = 0 AND (py - y0) % h = 0) AS regular
            FROM spots s JOIN hull USING (variant, raster) GROUP BY ALL),
        small AS (SELECT variant, bool_and(width = w OR px + width = x1) AS width_holds, max(w) AS width,
            bool_and(height = h OR py + height = y1) AS height_holds, max(h) AS height
            FROM placed JOIN hull USING (variant, raster) GROUP BY variant),
        summed AS (SELECT variant, count(*) FILTER (NOT regular) AS irregular,
            sum(CASE WHEN regular THEN slots - spots ELSE 0 END) AS gaps, sum(copies - spots) AS doubled
            FROM rasters GROUP BY variant),
        agreed AS (SELECT variant, min(skew_x) = max(skew_x) AS skew_x_holds, min(skew_x) AS skew_x,
            min(skew_y) = max(skew_y) AS skew_y_holds, min(skew_y) AS skew_y,
            min(pixel_type) = max(pixel_type) AS type_holds, min(pixel_type) AS pixel_type,
            CASE WHEN count(*) > count(nodata) THEN count(nodata) = 0 ELSE min(nodata) = max(nodata) END AS nodata_holds,
            min(nodata) AS nodata,
            count(DISTINCT px - floor(px)) = 1 AS x_holds, round(min(px - floor(px)) * 1000) AS x,
            count(DISTINCT py - floor(py)) = 1 AS y_holds, round(min(py - floor(py)) * 1000) AS y,
            min(xmin) || ' ' || min(ymin) || ' ' || max(xmax) || ' ' || max(ymax) AS box
            FROM placed GROUP BY variant),
        facts AS (FROM agreed JOIN summed USING (variant) JOIN small USING (variant))
        SELECT variant, f.name, f.holds, f.value FROM (SELECT variant, unnest([
            {{'name': 'srid', 'holds': true, 'value': '2193.0'}},
            {{'name': 'scale_x', 'holds': true, 'value': '10.0'}},
            {{'name': 'scale_y', 'holds': true, 'value': '-10.0'}},
            {{'name': 'num_bands', 'holds': true, 'value': '1.0'}},
            {{'name': 'skew_x', 'holds': skew_x_holds, 'value': skew_x::VARCHAR}},
            {{'name': 'skew_y', 'holds': skew_y_holds, 'value': skew_y::VARCHAR}},
            {{'name': 'pixel_type', 'holds': type_holds, 'value': pixel_type}},
            {{'name': 'nodata', 'holds': nodata_holds, 'value': nodata::VARCHAR}},
            {{'name': 'alignment_x', 'holds': x_holds, 'value': x::VARCHAR}},
            {{'name': 'alignment_y', 'holds': y_holds, 'value': y::VARCHAR}},
            {{'name': 'width', 'holds': width_holds, 'value': width::DOUBLE::VARCHAR}},
            {{'name': 'height', 'holds': height_holds, 'value': height::DOUBLE::VARCHAR}},
            {{'name': 'regular_blocking', 'holds': (irregular = 0), 'value': irregular::DOUBLE::VARCHAR}},
            {{'name': 'gaps', 'holds': (gaps = 0), 'value': gaps::DOUBLE::VARCHAR}},
            {{'name': 'overlaps', 'holds': (doubled = 0), 'value': doubled::DOUBLE::VARCHAR}},
            {{'name': 'extent', 'holds': true, 'value': box}}]) AS f FROM facts)""",
    "c_raster_bounds": f"""WITH {_STRAIGHT} SELECT CAST(tile_col AS INTEGER) AS tile_col,
        CAST(tile_row AS INTEGER) AS tile_row, xmin, ymin, xmax, ymax,
        xmin <= 1500 AND xmax >= 700 AND ymin <= 700 AND ymax >= 600 AS meets FROM boxes""",
    "a_load": f"""WITH {_POINTS} SELECT c_custkey AS cust_key, c_name AS full_name, 3857 AS srid,
        round(6378137.0 * radians(lon), 3) AS x,
        round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM pts""",
}
