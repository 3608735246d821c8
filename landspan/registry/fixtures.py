"""Datasets in foreign formats, written by tasks from the given tables.

Small writers of the formats the readers understand.  A file holds a bounded run of rows,
whatever keys they have, so the number of files grows with the data and none gets large.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.sources.files import write_files
from landspan.workspace import scratch_path

# Pixels of one derived raster: 60 across, 50 down.
RASTER_WIDTH, RASTER_HEIGHT = 60, 50


def tiff(
    pixels: np.ndarray, left: float, top: float, scale: float, srid: int, deflate: bool = False,
    order: str = "<", strip_rows: int = 16, block: int | None = None, nodata: str | None = None,
    predictor: int = 1, skew: tuple[float, float] | None = None, centered: bool = False,
) -> bytes:
    """Classic TIFF of ``(bands, height, width)`` pixels, in strips or square blocks.

    With a skew, its place is a matrix. ``centered``: coordinates name the centers of pixels.
    """
    bands, height, width = pixels.shape
    chunky = pixels.transpose(1, 2, 0).astype(pixels.dtype.newbyteorder(order))
    if predictor == 2:
        chunky = np.concatenate([chunky[:, :1], chunky[:, 1:] - chunky[:, :-1]], axis=1)
        chunky = chunky.astype(pixels.dtype.newbyteorder(order))
    if block:
        down, across = -(-height // block), -(-width // block)
        padded = np.zeros((down * block, across * block, bands), chunky.dtype)
        padded[:height, :width] = chunky
        pieces = [padded[r * block : (r + 1) * block, c * block : (c + 1) * block]
                  for r in range(down) for c in range(across)]
    else:
        pieces = [chunky[r : r + strip_rows] for r in range(0, height, strip_rows)]
    data = [zlib.compress(p.tobytes()) if deflate else p.tobytes() for p in pieces]
    starts = np.cumsum([8, *(len(d) for d in data)])
    kind = {"u": 1, "i": 2, "f": 3}[pixels.dtype.kind]
    key = 3072 if srid != 4326 else 2048
    tags = {
        256: ("I", [width]), 257: ("I", [height]), 258: ("H", [pixels.dtype.itemsize * 8] * bands),
        259: ("H", [8 if deflate else 1]), 262: ("H", [1]), 277: ("H", [bands]), 284: ("H", [1]),
        317: ("H", [predictor]), 339: ("H", [kind] * bands),
        34735: ("H", [1, 1, 0, 2, 1025, 0, 1, 2 if centered else 1, key, 0, 1, srid]),
    }
    if skew:
        tags[34264] = ("d", [scale, skew[0], 0.0, left, skew[1], -scale, 0.0, top, *[0.0] * 7, 1.0])
    else:
        tags |= {33550: ("d", [scale, scale, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, left, top, 0.0])}
    sizes = [len(d) for d in data]
    if block:
        tags |= {322: ("I", [block]), 323: ("I", [block]), 324: ("I", starts[:-1]), 325: ("I", sizes)}
    else:
        tags |= {273: ("I", starts[:-1]), 278: ("I", [strip_rows]), 279: ("I", sizes)}
    if nodata is not None:
        tags[42113] = ("s", nodata)
    codes = {"s": 2, "H": 3, "I": 4, "d": 12}
    at, extra, entries = int(starts[-1]), b"", b""
    for tag in sorted(tags):
        code, values = tags[tag]
        raw = (values.encode() + b"\0" if code == "s"
               else struct.pack(f"{order}{len(values)}{code}", *(v for v in values)))
        count = len(raw) if code == "s" else len(values)
        if len(raw) > 4:
            place = struct.pack(order + "I", at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack(order + "HHI", tag, codes[code], count) + place
    directory = struct.pack(order + "H", len(tags)) + entries + b"\0" * 4
    mark = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at + len(extra))
    return mark + b"".join(data) + extra + directory


def shapefile(code: int, shapes: list, fields: list[tuple], rows: list[list[str]],
              deleted: tuple[int, ...] = ()) -> dict[str, bytes]:
    """The .shp, .shx and .dbf content; a shape is a list of (n, 2 or 3) vertex arrays."""
    records, index, at = b"", b"", 100
    for number, lines in enumerate(shapes, start=1):
        if lines is None:
            body = struct.pack("<i", 0)
        else:
            xyz = np.concatenate(lines).astype("<f8")
            box = struct.pack("<4d", *xyz[:, :2].min(0), *xyz[:, :2].max(0))
            xy = np.ascontiguousarray(xyz[:, :2]).tobytes()
            body = struct.pack("<i", code)
            if code % 10 == 1:
                body += xyz[0].tobytes() + (struct.pack("<d", 0.0) if code == 11 else b"")
            elif code % 10 == 8:
                body += box + struct.pack("<i", len(xyz)) + xy
            else:
                starts = np.cumsum([0, *(len(line) for line in lines)])[:-1]
                body += box + struct.pack("<2i", len(lines), len(xyz))
                body += starts.astype("<i4").tobytes() + xy
            if 10 < code < 20 and code != 11:
                body += struct.pack("<2d", xyz[:, 2].min(), xyz[:, 2].max()) + xyz[:, 2].tobytes()
        index += struct.pack(">2i", at // 2, len(body) // 2)
        records += struct.pack(">2i", number, len(body) // 2) + body
        at += 8 + len(body)

    def head(size: int) -> bytes:
        return struct.pack(">i20xi", 9994, size // 2) + struct.pack("<2i8d", 1000, code, *[0.0] * 8)

    width = 1 + sum(size for _, _, size, _ in fields)
    table = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), width)
    for name, kind, size, decimals in fields:
        table += struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), size, decimals)
    table += b"\r"
    for i, row in enumerate(rows):
        cells = b"".join(t.encode().ljust(f[2])[: f[2]] for t, f in zip(row, fields))
        table += (b"*" if i in deleted else b" ") + cells
    return {"shp": head(at) + records, "shx": head(100 + len(index)) + index, "dbf": table + b"\x1a"}


def duckdb_files(
    groups: DataFrame, folder: str, statements: list[str], target: str,
    rows: Callable[[dict], list[tuple]],
) -> None:
    """A DuckDB file per row of ``groups(file, ...)``, built in place in the shared folder.

    ``folder`` must be mounted, as DuckDB opens no remote files.  Each attempt has a name
    of its own and is renamed at the end, so a retried task replaces what it left.
    """
    base = re.sub(r"^file:/*", "/", folder)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import duckdb

        os.makedirs(base, exist_ok=True)
        for frame in frames:
            for row in frame.to_dict("records"):
                path = f"{base}/part-{int(row['file'])}.duckdb"
                attempt = f"{path}.{uuid.uuid4().hex}"
                with duckdb.connect(attempt) as connection:
                    for statement in statements:
                        connection.execute(statement)
                    connection.register("new_rows", pd.DataFrame(rows(row)))
                    connection.execute(f"INSERT INTO {target} SELECT * FROM new_rows")
                os.replace(attempt, path)
            yield pd.DataFrame({"written": [len(frame)]})

    groups.mapInPandas(build, "written long").agg(F.sum("written")).collect()


# Derived datasets ------------------------------------------------------------------


def runs_of(df: DataFrame, name: str, rows: int) -> DataFrame:
    """Add a number shared by up to ``rows`` neighbouring rows of one partition.

    Unlike a key range, such a run stays bounded when one key fills much of the table.
    """
    return df.withColumn(name, F.floor(F.monotonically_increasing_id() / rows))


def raster_pixels(orders: DataFrame) -> DataFrame:
    """``(raster, pos, value)``: order k is pixel k mod 3000 of raster k div 3000."""
    size = RASTER_WIDTH * RASTER_HEIGHT
    k = F.col("o_orderkey")
    return orders.groupBy(k.alias("k")).agg(F.max(k * 31 % 251).alias("value")).select(
        F.expr(f"k DIV {size}").alias("raster"), (F.col("k") % size).cast("int").alias("pos"),
        F.col("value").cast("int").alias("value"),
    )


def raster_files(spark: SparkSession, orders: DataFrame, turned: bool = False) -> str:
    """A folder with one GeoTIFF per raster; odd ones are deflated.

    Each fifth one names the centers of its pixels, and, if asked for, another fifth is turned.
    """
    folder = scratch_path(spark, "rasters")
    groups = raster_pixels(orders).groupBy("raster").agg(
        F.collect_list("pos").alias("pos"), F.collect_list("value").alias("value")
    )

    def content(row: dict) -> dict[str, bytes]:
        pixels = np.zeros(RASTER_WIDTH * RASTER_HEIGHT, "u1")
        pixels[np.asarray(row["pos"])] = np.asarray(row["value"])
        grid = pixels.reshape(1, RASTER_HEIGHT, RASTER_WIDTH)
        number = int(row["raster"])
        centered = number % 5 == 4
        image = tiff(
            grid, number * 600.0 + 5 * centered, 1000.0 - 5 * centered, 10.0, 2193, deflate=bool(number % 2),
            skew=(2.0, 1.0) if turned and number % 5 == 3 else None, centered=centered)
        return {f"raster-{number}.tif": image}

    write_files(groups, folder, content)
    return folder


def rectangle_shapefiles(spark: SparkSession, part: DataFrame) -> str:
    """A folder of polygon shapefiles, up to 500 parts each."""
    folder = scratch_path(spark, "shapes")
    k = F.col("p_partkey")
    groups = runs_of(part, "file", 500).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct(k.alias("k"), "p_brand", "p_size"))).alias("rows")
    )

    def ring(x0, y0, x1, y1, clockwise):
        corners = [(x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)]
        return np.array(corners if clockwise else corners[::-1])

    def content(row: dict) -> dict[str, bytes]:
        shapes, texts = [], []
        for item in row["rows"]:
            k, size = int(item["k"]), float(item["p_size"])
            x, y = k % 1000 * 100.0, k // 1000 * 100.0
            lines = [ring(x, y, x + size, y + k % 7 + 1, True)]
            if k % 2 == 0:
                lines.append(ring(x + 0.25, y + 0.25, x + 0.75, y + 0.75, False))
            shapes.append(lines)
            texts.append([str(k), item["p_brand"], f"{size / 4:.2f}"])
        fields = [("PARTKEY", "N", 12, 0), ("Brand", "C", 20, 0), ("QUARTER", "N", 10, 2)]
        files = shapefile(5, shapes, fields, texts)
        return {f"parts-{int(row['file'])}.{suffix}": data for suffix, data in files.items()}

    write_files(groups, folder, content)
    return folder


def customer_duckdb(spark: SparkSession, customer: DataFrame) -> str:
    """A folder of DuckDB files with a table ``sales.customers``, up to 500 rows each."""
    folder = scratch_path(spark, "duckdb")
    groups = runs_of(customer, "file", 500).groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal"))).alias("rows")
    )

    def rows(row: dict) -> list[tuple]:
        out = []
        for item in row["rows"]:
            k = int(item["c_custkey"])
            place = f"POINT({-180 + k * 37 % 36000 / 100} {-80 + k * 53 % 16000 / 100})"
            out.append((k, item["c_name"], float(item["c_acctbal"]), k, place))
        return out

    statements = [
        "CREATE SCHEMA sales",
        'CREATE TABLE sales.customers ("Cust Key" BIGINT PRIMARY KEY, "Full Name" VARCHAR NOT NULL,'
        ' "Balance$" DOUBLE DEFAULT 0, big HUGEINT, geom GEOMETRY)',
    ]
    duckdb_files(groups, folder, statements, "sales.customers", rows)
    return folder


def feature_pages(customer: DataFrame, kind: str) -> DataFrame:
    """``(page, text)``: up to 100 customers per page of a feature service."""
    k = F.col("c_custkey")
    lon = F.lit(-180.0) + (k * 37 % 36000) / 100.0
    lat = F.lit(-80.0) + (k * 53 % 16000) / 100.0
    attributes = F.struct(
        k.alias("OBJECTID"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("Balance"),
        (k * 86_400_000).alias("Edited"),
    )
    if kind == "pjson":
        shape = F.struct(lon.alias("x"), lat.alias("y"))
        feature = F.struct(attributes.alias("attributes"), shape.alias("geometry"))
        head = ('{"spatialReference":{"wkid":4326},"fields":['
                '{"name":"OBJECTID","type":"esriFieldTypeOID"},'
                '{"name":"Name","type":"esriFieldTypeString"},'
                '{"name":"Balance","type":"esriFieldTypeDouble"},'
                '{"name":"Edited","type":"esriFieldTypeDate"}],"features":[')
    else:
        shape = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
        feature = F.struct(F.lit("Feature").alias("type"), attributes.alias("properties"),
                           shape.alias("geometry"))
        head = '{"type":"FeatureCollection","features":['
    return runs_of(customer, "page", 100).groupBy("page").agg(
        F.concat(F.lit(head), F.concat_ws(",", F.collect_list(F.to_json(feature))), F.lit("]}")).alias("text")
    )


def wfs_files(spark: SparkSession, customer: DataFrame) -> str:
    """A folder of GetFeature responses, up to 100 customers each."""
    folder = scratch_path(spark, "wfs")
    k = F.col("c_custkey")
    place = F.concat_ws(" ", F.lit(-180.0) + (k * 37 % 36000) / 100.0,
                        F.lit(-80.0) + (k * 53 % 16000) / 100.0)
    member = F.concat(
        F.lit('<wfs:member><shop:customer gml:id="customer.'), k, F.lit('"><shop:key>'), k,
        F.lit("</shop:key><shop:name>"), F.col("c_name"), F.lit("</shop:name><shop:place>"),
        F.lit('<gml:Point srsName="EPSG:4326"><gml:pos>'), place,
        F.lit("</gml:pos></gml:Point></shop:place></shop:customer></wfs:member>"),
    )
    head = ('<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0"'
            ' xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:shop="http://example.org/shop">')
    pages = runs_of(customer, "page", 100).groupBy("page").agg(
        F.concat(F.lit(head), F.concat_ws("", F.collect_list(member)),
                 F.lit("</wfs:FeatureCollection>")).alias("text")
    )
    write_files(pages, folder, lambda row: {f"page-{row['page']}.xml": row["text"].encode()})
    return folder


def wfs_shape_files(spark: SparkSession, customer: DataFrame) -> str:
    """A folder of responses whose geometries are, in turn, a curve of a straight and a bent segment, an arc
    string, a composite curve, a surface of two patches and a multi-surface of surfaces.

    Each has a size r = 1 + k mod 9 and stands at (k, 10 r).
    """
    folder = scratch_path(spark, "wfs")
    k = F.col("c_custkey")
    x, y, r = k.cast("double"), (1 + k % 9) * 10.0, (1 + k % 9).cast("double")

    def places(*pairs):
        return F.concat(F.lit("<gml:posList>"), F.concat_ws(" ", *[c for a, b in pairs for c in (x + r * a, y + r * b)]),
                        F.lit("</gml:posList>"))

    def within(*names_and_body):
        *names, body = names_and_body
        return F.concat(*[F.lit(f"<gml:{n}>") for n in names], body, *[F.lit(f"</gml:{n}>") for n in names[::-1]])

    arc, two_arcs = places((-1, 0), (0, 1), (1, 0)), places((-1, 0), (0, 1), (1, 0), (2, -1), (3, 0))
    tail = within("LineStringSegment", places((1, 0), (4, 0)))
    square = within("PolygonPatch", "exterior", "LinearRing", places((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))
    beside = within("PolygonPatch", "exterior", "LinearRing", places((2, 0), (3, 0), (3, 1), (2, 1), (2, 0)))
    both = within("Surface", "patches", F.concat(square, beside))
    shapes = [
        within("Curve", "segments", F.concat(within("Arc", arc), tail)),
        within("Curve", "segments", within("ArcString", two_arcs)),
        within("CompositeCurve", F.concat(
            within("curveMember", "LineString", places((-2, 0), (-1, 0))),
            within("curveMember", "Curve", "segments", within("Arc", arc)))),
        both,
        within("MultiSurface", "surfaceMember", within("CompositeSurface", "surfaceMember", both)),
    ]
    shape = F.element_at(F.array(*shapes), (k % 5 + 1).cast("int"))
    member = F.concat(F.lit('<wfs:member><shop:area gml:id="area.'), k, F.lit('"><shop:key>'), k,
                      F.lit("</shop:key><shop:shape>"), shape, F.lit("</shop:shape></shop:area></wfs:member>"))
    head = ('<wfs:FeatureCollection xmlns:wfs="http://www.opengis.net/wfs/2.0"'
            ' xmlns:gml="http://www.opengis.net/gml/3.2" xmlns:shop="http://example.org/shop">')
    pages = runs_of(customer, "page", 100).groupBy("page").agg(
        F.concat(F.lit(head), F.concat_ws("", F.collect_list(member)), F.lit("</wfs:FeatureCollection>")).alias("text"))
    write_files(pages, folder, lambda row: {f"page-{row['page']}.xml": row["text"].encode()})
    return folder
