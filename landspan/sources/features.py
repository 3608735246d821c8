"""Feature services: Esri JSON and GeoJSON pages, live or saved."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.sources.files import MAX_TASKS
from landspan.workspace import materialize

# Response formats of a feature service.
ESRI_JSON, GEOJSON = "pjson", "pgeojson"
# Field types of a feature service and the Spark types they become.
ESRI_TYPES = {
    "esriFieldTypeOID": "bigint", "esriFieldTypeInteger": "bigint",
    "esriFieldTypeSmallInteger": "int", "esriFieldTypeBigInteger": "bigint",
    "esriFieldTypeSingle": "double", "esriFieldTypeDouble": "double",
    "esriFieldTypeDate": "bigint",
}
# Legacy service codes of well-known EPSG codes.
LEGACY_SRID = {102100: 3857, 102113: 3857}
PAGE = """struct<features:array<struct<attributes:string,properties:string,geometry:string>>,
    fields:array<struct<name:string,type:string>>,
    spatialReference:struct<wkid:int,latestWkid:int>>"""


def fetch_pages(
    spark: SparkSession, urls: Callable[[int], str], pages: int, fetch: Callable[[str], str]
) -> DataFrame:
    """Fetch ``pages`` pages, one task each, and land the raw text in the shared folder.

    Landing first means a lost executor or a second pass never asks the service again.
    """
    def pull(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [fetch(urls(int(page))) for page in frame["id"]]
            yield pd.DataFrame({"page": frame["id"], "text": texts})

    numbers = spark.range(0, pages, 1, max(1, min(pages, MAX_TASKS)))
    return materialize(numbers.mapInPandas(pull, "page long, text string"), "pages")


def require_complete(pages: DataFrame, got: Column, total: int, url: str) -> None:
    """Raise unless the landed pages hold as many features as the service has counted."""
    found = pages.agg(F.sum(got)).first()[0] or 0
    if found != total:
        raise ValueError(f"{url} counts {total} features but its pages hold {found}")


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages, one per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def fetch_features(
    spark: SparkSession, url: str, fetch: Callable[[str], str], kind: str = GEOJSON,
    page_size: int = 1000, id_field: str | None = None,
) -> DataFrame:
    """All rows and fields of a service layer, page by page.

    With ``id_field``, pages are ranges of object ids instead of offsets: rows that come or go while pages
    are read move no other row to another page.
    """
    if id_field:
        return parse_pages(_pages_by_id(spark, url, fetch, kind, page_size, id_field), kind)
    query = f"{url}/query?where=1=1"
    total = int(json.loads(fetch(f"{query}&returnCountOnly=true&f=json"))["count"])

    def page_url(page: int, size: int) -> str:
        return f"{query}&outFields=*&f={kind}&resultOffset={page * size}&resultRecordCount={size}"

    # A service may give less than it is asked for: pages follow the size of the first one.
    served = len(json.loads(fetch(page_url(0, page_size)))["features"]) if total else 0
    size = min(page_size, served) or page_size
    pages = fetch_pages(spark, lambda page: page_url(page, size), -(-total // size), fetch)
    got = F.size(F.from_json("text", "struct<features:array<string>>")["features"])
    require_complete(pages, got, total, url)
    return parse_pages(pages, kind)


def _pages_by_id(
    spark: SparkSession, url: str, fetch: Callable[[str], str], kind: str, page_size: int, field: str
) -> DataFrame:
    """Landed pages of all rows that had an id when the reading began.

    The ids from the least to the greatest are dealt in ranges, about a page of rows each. A task reads its
    range from one id to the next until nothing follows, whatever the service gives at once and however
    ids are spread. Rows that were there before and after must have been read.
    """
    def asked(where: str, rest: str) -> str:
        return fetch(f"{url}/query?where={quote(where)}&{rest}")

    def counted(where: str) -> int:
        return int(json.loads(asked(where, "returnCountOnly=true&f=json"))["count"])

    total = counted("1=1")
    ends = json.dumps([{"statisticType": s, "onStatisticField": field, "outStatisticFieldName": s} for s in ("min", "max")])
    found = json.loads(asked("1=1", f"outStatistics={quote(ends)}&f=json"))["features"] if total else []
    if not found:
        return spark.createDataFrame([], "text string")
    low, high = (int(found[0]["attributes"][s]) for s in ("min", "max"))
    ranges = min(-(-total // page_size), high - low + 1)
    width = -(-(high - low + 1) // ranges)

    def pull(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"]:
                last, stop = low + int(number) * width - 1, min(low + (int(number) + 1) * width - 1, high)
                while last < stop:
                    text = asked(f"{field} > {last} AND {field} <= {stop}",
                                 f"outFields=*&orderByFields={quote(field + ' ASC')}&resultRecordCount={page_size}&f={kind}")
                    rows = json.loads(text)["features"]
                    if not rows:
                        break
                    yield pd.DataFrame({"text": [text], "got": [len(rows)]})
                    last = max(int((row.get("attributes") or row["properties"])[field]) for row in rows)

    numbers = spark.range(0, ranges, 1, max(1, min(ranges, MAX_TASKS)))
    pages = materialize(numbers.mapInPandas(pull, "text string, got long"), "pages")
    got, after = pages.agg(F.sum("got")).first()[0] or 0, counted(f"{field} <= {high}")
    if got < min(total, after):
        raise ValueError(f"{url} counts {min(total, after)} features but its pages hold {got}")
    return pages.select("text")


def _spark_type(variant_type: str) -> str:
    """DDL of a schema found in variant values; decimals become doubles."""
    ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", variant_type)
    ddl = re.sub(r"\b(?:VOID|VARIANT)\b", "STRING", ddl)
    return re.sub(r"\bOBJECT<", "STRUCT<", ddl)


def _position(coordinates: Column) -> Column:
    return geo.vertex(F.get(coordinates, 0), F.get(coordinates, 1), F.get(coordinates, 2))


def _positions(line: Column) -> Column:
    return F.transform(line, _position)


def _geojson_geometry(text: Column) -> Column:
    """Geometry struct from GeoJSON geometry text (always longitude/latitude)."""
    head = F.from_json(text, "struct<type:string,coordinates:string>")
    kind, coordinates = head["type"], head["coordinates"]

    def nested(depth: int) -> Column:
        return F.from_json(coordinates, "array<" * depth + "double" + ">" * depth)

    parts = (
        F.when(kind == "Point", F.when(
            F.size(nested(1)) > 0, F.array(F.array(F.array(_position(nested(1)))))
        ).otherwise(F.array()))
        .when(kind == "MultiPoint",
              F.transform(nested(2), lambda p: F.array(F.array(_position(p)))))
        .when(kind == "LineString", F.array(F.array(_positions(nested(2)))))
        .when(kind == "MultiLineString",
              F.transform(nested(3), lambda line: F.array(_positions(line))))
        .when(kind == "Polygon", F.array(F.transform(nested(3), _positions)))
        .when(kind == "MultiPolygon",
              F.transform(nested(4), lambda part: F.transform(part, _positions)))
    )
    return F.when(parts.isNotNull(), geo.geometry(kind, parts, 4326))


def _esri_geometry(text: Column, srid: Column) -> Column:
    """Geometry struct from Esri JSON geometry text."""
    shape = F.from_json(text, """struct<x:double,y:double,z:double,points:array<array<double>>,
        paths:array<array<array<double>>>,rings:array<array<array<double>>>>""")
    rings = geo.ring_parts(F.transform(shape["rings"], _positions))
    paths = F.transform(shape["paths"], lambda line: F.array(_positions(line)))
    points = F.transform(shape["points"], lambda p: F.array(F.array(_position(p))))
    many = F.lit("Multi")
    return (
        F.when(shape["rings"].isNotNull(), geo.geometry(
            F.concat(F.when(F.size(rings) > 1, many).otherwise(""), F.lit("Polygon")), rings, srid))
        .when(shape["paths"].isNotNull(), geo.geometry(
            F.concat(F.when(F.size(paths) > 1, many).otherwise(""), F.lit("LineString")), paths, srid))
        .when(shape["points"].isNotNull(), geo.geometry("MultiPoint", points, srid))
        .when(shape["x"].isNotNull(), geo.point(shape["x"], shape["y"], shape["z"], srid))
    )


def parse_pages(
    pages: DataFrame, kind: str, fields: str | None = None, geometry_name: str = "geom"
) -> DataFrame:
    """Attributes and geometry of every feature of ``pages(text)``.

    ``fields`` is the DDL of the attributes.  Without it, Esri JSON takes the types the
    pages declare, and GeoJSON the types found in one aggregation over all features.
    """
    page = pages.select(F.from_json("text", PAGE).alias("page"))
    if kind == ESRI_JSON:
        reference = F.coalesce("page.spatialReference.latestWkid", "page.spatialReference.wkid")
        srid = reference
        for old, new in LEGACY_SRID.items():
            srid = F.when(reference == old, new).otherwise(srid)
        rows = page.select(
            F.coalesce(srid, F.lit(0)).alias("srid"), F.explode("page.features").alias("f")
        )
        attributes, shape = F.col("f.attributes"), _esri_geometry(F.col("f.geometry"), F.col("srid"))
        listed = [] if fields else (
            page.select(F.posexplode("page.fields").alias("place", "field"))
            .groupBy("field.name", "field.type").agg(F.min("place").alias("place"))
            .orderBy("place", "name").collect()
        )
        dates = [row["name"] for row in listed if row["type"] == "esriFieldTypeDate"]
        fields = fields or ", ".join(
            f"`{row['name']}` {ESRI_TYPES.get(row['type'], 'string')}" for row in listed
        )
    elif kind == GEOJSON:
        rows = page.select(F.explode("page.features").alias("f"))
        attributes, shape = F.col("f.properties"), _geojson_geometry(F.col("f.geometry"))
        dates = []
    else:
        raise ValueError(f"unknown feature format {kind!r}")
    if not fields:
        found = rows.agg(F.schema_of_variant_agg(F.parse_json(attributes))).first()[0]
        ddl = _spark_type(found)
        fields = ddl if ddl.startswith("STRUCT<") else "STRUCT<>"
    else:
        fields = f"struct<{fields}>"
    parsed = rows.select(
        F.from_json(attributes, fields).alias("a"), shape.alias(geometry_name)
    ).select("a.*", geometry_name)
    # Services write dates as milliseconds since 1970.
    return parsed.withColumns({name: F.timestamp_millis(F.col(f"`{name}`")) for name in dates})
