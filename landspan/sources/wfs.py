"""WFS layers: GetFeature responses in GML, live or saved."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landspan.functions import geometry as geo
from landspan.sources import gml
from landspan.sources.features import fetch_pages, require_complete
from landspan.sources.files import write_files
from landspan.workspace import scratch_path

# Codes of systems whose official axis order is latitude or northing first.
NORTH_FIRST = (4326, 2193)

_RING = "struct<`gml:LinearRing`:struct<`gml:posList`:string>>"
_POLYGON = f"struct<_srsName:string,_srsDimension:int,`gml:exterior`:{_RING},`gml:interior`:array<{_RING}>>"
_LINE = "struct<_srsName:string,_srsDimension:int,`gml:posList`:string>"
_POINT = "struct<_srsName:string,_srsDimension:int,`gml:pos`:string>"
# The GML geometry kinds that are read; all optional.
GML = f"""struct<
    `gml:Point`:{_POINT}, `gml:LineString`:{_LINE}, `gml:Polygon`:{_POLYGON},
    `gml:MultiPoint`:struct<_srsName:string,_srsDimension:int,
        `gml:pointMember`:array<struct<`gml:Point`:{_POINT}>>>,
    `gml:MultiCurve`:struct<_srsName:string,_srsDimension:int,
        `gml:curveMember`:array<struct<`gml:LineString`:{_LINE}>>>,
    `gml:MultiSurface`:struct<_srsName:string,_srsDimension:int,
        `gml:surfaceMember`:array<struct<`gml:Polygon`:{_POLYGON}>>>>"""


_MEMBER = r"<wfs:member[\s>]"


def fetch_wfs(
    spark: SparkSession, url: str, layer: str, fetch: Callable[[str], str], page_size: int = 1000
) -> DataFrame:
    """All features of a layer, page by page; pages are landed before they are parsed."""
    query = f"{url}{'&' if '?' in url else '?'}service=WFS&version=2.0.0&request=GetFeature"
    query += f"&typeNames={layer}"
    hits = re.search(r'numberMatched="(\d+)"', fetch(f"{query}&resultType=hits"))
    if hits is None:
        raise ValueError(f"{url} does not tell how many features match")

    total = int(hits.group(1))

    def page_url(page: int, size: int) -> str:
        return f"{query}&startIndex={page * size}&count={size}"

    # A service may give less than it is asked for: pages follow the size of the first one.
    served = len(re.findall(_MEMBER, fetch(page_url(0, page_size)))) if total else 0
    size = min(page_size, served) or page_size
    pages = fetch_pages(spark, lambda page: page_url(page, size), -(-total // size), fetch)
    require_complete(pages, F.regexp_count("text", F.lit(_MEMBER)), total, url)
    # The XML reader expects one document per file.
    path = scratch_path(spark, "wfs")
    write_files(pages, path, lambda row: {f"page-{row['page']}.xml": row["text"].encode()})
    return read_wfs(spark, path, layer)


def _numbers(text: Column) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.transform(words, lambda t: t.cast("double"))


def _vertices(text: Column, swap: Column, size: Column) -> Column:
    """Vertices of a list of ``size`` numbers each; ``swap`` where northing comes first."""
    values = _numbers(text)
    places = F.when(F.size(values) >= size, F.sequence(
        F.lit(0), F.floor(F.size(values) / size).cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        a, b = F.get(values, size * i), F.get(values, size * i + 1)
        return geo.vertex(F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b),
                          F.when(size > 2, F.get(values, size * i + 2)))

    return F.transform(places, at)


def _polygon_rings(shape: Column, swap: Column, size: Column) -> Column:
    def ring(node: Column) -> Column:
        return _vertices(node["gml:LinearRing"]["gml:posList"], swap, size)

    holes = F.coalesce(F.transform(shape["gml:interior"], ring), F.array())
    return F.concat(F.array(ring(shape["gml:exterior"])), holes)


def _geometry(node: Column) -> Column:
    """Geometry struct of one GML element; axis order follows the srsName form."""
    kinds = ("Point", "LineString", "Polygon", "MultiPoint", "MultiCurve", "MultiSurface")
    srs = F.coalesce(*[node[f"gml:{k}"]["_srsName"] for k in kinds])
    size = F.coalesce(*[node[f"gml:{k}"]["_srsDimension"] for k in kinds], F.lit(2))
    srid = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(srs, r"(\d+)$", 1), F.lit("")),
                                      F.lit("999999")).cast("int"), F.lit(0))
    # urn: and http: names promise the official axis order.
    swap = F.coalesce(srs.rlike("^(urn:|http)") & srid.isin(*NORTH_FIRST), F.lit(False))
    point, line, area = node["gml:Point"], node["gml:LineString"], node["gml:Polygon"]
    points, lines = node["gml:MultiPoint"], node["gml:MultiCurve"]
    areas = node["gml:MultiSurface"]

    def one(text: Column) -> Column:
        return F.array(_vertices(text, swap, size))

    return (
        F.when(point["gml:pos"].isNotNull(),
               geo.geometry("Point", F.array(one(point["gml:pos"])), srid))
        .when(line["gml:posList"].isNotNull(),
              geo.geometry("LineString", F.array(one(line["gml:posList"])), srid))
        .when(area["gml:exterior"].isNotNull(),
              geo.geometry("Polygon", F.array(_polygon_rings(area, swap, size)), srid))
        .when(points.isNotNull(), geo.geometry("MultiPoint", F.transform(
            points["gml:pointMember"], lambda m: one(m["gml:Point"]["gml:pos"])), srid))
        .when(lines.isNotNull(), geo.geometry("MultiLineString", F.transform(
            lines["gml:curveMember"], lambda m: one(m["gml:LineString"]["gml:posList"])), srid))
        .when(areas.isNotNull(), geo.geometry("MultiPolygon", F.transform(
            areas["gml:surfaceMember"], lambda m: _polygon_rings(m["gml:Polygon"], swap, size)), srid))
    )


# Elements that the struct above holds; any other needs the text of the geometry.
_PLAIN = {"Point", "LineString", "Polygon", "MultiPoint", "MultiCurve", "MultiSurface", "pos", "posList", "exterior",
          "interior", "LinearRing", "pointMember", "curveMember", "surfaceMember"}
_SHAPES = {"Point"} | gml._LINES | gml._AREAS | gml._MULTI


def _names(kind: T.DataType) -> set[str]:
    """Elements of a type, all the way down, without prefixes; attributes and values left out."""
    if isinstance(kind, T.ArrayType):
        return _names(kind.elementType)
    if not isinstance(kind, T.StructType):
        return set()
    out = set()
    for f in kind.fields:
        if not f.name.startswith("_"):
            out |= {f.name.rpartition(":")[2]} | _names(f.dataType)
    return out


def _repeated(kind: T.DataType, name: str) -> bool:
    """Whether an element stands more than once in the one above it."""
    if isinstance(kind, T.ArrayType):
        return _repeated(kind.elementType, name)
    return isinstance(kind, T.StructType) and any(
        (f.name.rpartition(":")[2] == name and isinstance(f.dataType, T.ArrayType)) or _repeated(f.dataType, name)
        for f in kind.fields)


def _from_text(arc_step: float):
    """Geometry struct of the text of any GML geometry."""
    arrow = pa.struct([
        ("srid", pa.int32()), ("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.struct(
            [(axis, pa.float64()) for axis in ("x", "y", "z")])))))])

    @F.arrow_udf(geo.GEOMETRY)
    def read(texts: pa.Array) -> pa.Array:
        return pa.array([gml.decode(t, NORTH_FIRST, arc_step) if t and t.strip() else None
                         for t in texts.to_pylist()], arrow)

    return read


def read_wfs(
    spark: SparkSession, path: str, layer: str, schema: T.StructType | None = None, arc_step: float = gml.ARC_STEP,
) -> DataFrame:
    """Features of saved GetFeature responses; ``layer`` is the feature element's name.

    Attribute types are inferred from all features unless ``schema`` names them (with the
    geometry element as a struct).  Columns lose their namespace prefix.  Points, lines and polygons
    and their collections are read by columns; a geometry column with anything else (curves of
    segments, composite curves, surfaces of patches) is read from its text, arcs as chords that
    turn by at most ``arc_step`` degrees.  An element that is not known raises.
    """
    reader = spark.read.format("xml").option("rowTag", layer)
    if schema is None:
        schema = reader.load(path).schema
    shapes = [
        f.name for f in schema.fields
        if isinstance(f.dataType, T.StructType) and f.name != "gml:boundedBy" and any(
            name.rpartition(":")[2] in _SHAPES and isinstance(_element(kind), T.StructType)
            for name, kind in ((x.name, x.dataType) for x in f.dataType.fields))
    ]
    plain = {f.name for f in schema.fields if f.name in shapes and _names(f.dataType) <= _PLAIN
             and all(x.name.startswith(("gml:", "_")) for x in f.dataType.fields)
             and not _repeated(f.dataType, "pos") and not _repeated(f.dataType, "posList")}
    simple = T.DataType.fromDDL(GML)
    fields = [
        T.StructField(f.name, f.dataType if f.name not in shapes else simple if f.name in plain else T.StringType())
        for f in schema.fields if f.name != "gml:boundedBy"
    ]
    rows = reader.schema(T.StructType(fields)).load(path)
    columns, from_text = [], _from_text(arc_step)
    for field in fields:
        short = re.sub(r"^_|^[^:]*:", "", field.name)
        short = "gml_id" if field.name == "_gml:id" else short
        if field.name in plain:
            shape = F.transform(F.array(F.col(f"`{field.name}`")), _geometry)[0]
            columns.append(shape.alias(short))
        elif field.name in shapes:
            columns.append(from_text(F.col(f"`{field.name}`")).alias(short))
        else:
            columns.append(F.col(f"`{field.name}`").alias(short))
    return rows.select(columns)


def _element(kind: T.DataType) -> T.DataType:
    return kind.elementType if isinstance(kind, T.ArrayType) else kind
