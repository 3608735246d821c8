"""Geometry as a plain struct column.

``struct<srid, kind, parts: array<array<array<struct<x, y, z>>>>>`` nests
part -> ring or line -> vertex: Point ``[[[p]]]``, LineString ``[[[v...]]]``,
Polygon ``[[outer, hole...]]``; Multi kinds hold several parts.  ``z`` is NULL for
2-D data, ``srid`` 0 means not declared.  Operators address columns by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landspan.functions import crs

VERTEX = T.StructType([T.StructField(axis, T.DoubleType()) for axis in ("x", "y", "z")])
GEOMETRY = T.StructType(
    [
        T.StructField("srid", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))),
    ]
)
GEOMETRY_DDL = GEOMETRY.simpleString()


def is_geometry(data_type: T.DataType) -> bool:
    """Whether a column type is the geometry struct."""
    return data_type.simpleString() == GEOMETRY_DDL


def geometry_columns(df: DataFrame) -> list[str]:
    """Names of the geometry columns of a frame."""
    return [field.name for field in df.schema.fields if is_geometry(field.dataType)]


def vertex(x: Column, y: Column, z: Column | None = None) -> Column:
    """One vertex struct."""
    z = F.lit(None) if z is None else z
    return F.struct(
        x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z")
    )


def geometry(kind: str | Column, parts: Column, srid: int | Column = 0) -> Column:
    """Geometry struct from a kind and nested vertex arrays."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    srid = F.lit(srid) if isinstance(srid, int) else srid
    return F.struct(srid.cast("int").alias("srid"), kind.alias("kind"), parts.alias("parts"))


def point(x: Column, y: Column, z: Column | None = None, srid: int | Column = 0) -> Column:
    """Point geometry from coordinate columns."""
    return geometry("Point", F.array(F.array(F.array(vertex(x, y, z)))), srid)


def polygon(rings: Column, srid: int | Column = 0) -> Column:
    """Polygon geometry from an array of closed rings (outer ring first)."""
    return geometry("Polygon", F.array(rings), srid)


def first_vertex(column: str) -> Column:
    """First vertex of a geometry, NULL when it is empty."""
    return F.get(F.get(F.get(F.col(column)["parts"], 0), 0), 0)


def vertices(column: str) -> Column:
    """All vertices of a geometry in one array."""
    return F.flatten(F.flatten(F.col(column)["parts"]))


def set_srid(df: DataFrame, column: str, epsg: int) -> DataFrame:
    """Assign a coordinate system; coordinates stay as they are."""
    return df.withColumn(column, F.col(column).withField("srid", F.lit(epsg)))


def promote_to_multi(df: DataFrame, column: str) -> DataFrame:
    """Turn single-part kinds into their multi-part kinds."""
    kind = F.col(column)["kind"]
    multi = F.when(kind.startswith("Multi"), kind).otherwise(F.concat(F.lit("Multi"), kind))
    return df.withColumn(column, F.col(column).withField("kind", multi))


def offsets(lists: pa.ListArray) -> np.ndarray:
    """Offsets of a list array; one zero when it is empty, as its buffer may be unset."""
    return lists.offsets.to_numpy() if len(lists) else np.zeros(1, "i4")


def _move_batch(source: int | None, target: int):
    """Arrow function that projects the coordinate buffers of one batch."""

    def move(geoms: pa.Array) -> pa.Array:
        if geoms.null_count == len(geoms):
            return pa.nulls(len(geoms), geoms.type)
        parts = geoms.field("parts")
        rings = parts.values
        lines = rings.values
        points = lines.values
        x = points.field("x").to_numpy(zero_copy_only=False)
        y = points.field("y").to_numpy(zero_copy_only=False)
        # Row -> vertex range, by following the three offset buffers.
        bounds = offsets(lines)[offsets(rings)[offsets(parts)]]
        if source is None:
            declared = geoms.field("srid").fill_null(0).to_numpy(zero_copy_only=False)
            code = np.repeat(np.where(declared == 0, target, declared), np.diff(bounds))
            new_x, new_y = np.empty_like(x), np.empty_like(y)
            for epsg in np.unique(code):
                at = np.flatnonzero(code == epsg) + bounds[0]
                new_x[at], new_y[at] = crs.project_arrays(x[at], y[at], int(epsg), target)
        else:
            new_x, new_y = crs.project_arrays(x, y, source, target)
        undefined = np.concatenate(([0], np.cumsum(np.isnan(new_x) | np.isnan(new_y))))
        bad = undefined[bounds[1:]] > undefined[bounds[:-1]]
        moved = pa.StructArray.from_arrays(
            [pa.array(new_x), pa.array(new_y), points.field("z")], names=["x", "y", "z"]
        )
        for level in (lines, rings, parts):
            moved = pa.ListArray.from_arrays(pa.array(offsets(level)), moved)
        gone = pa.array(bad | geoms.is_null().to_numpy(zero_copy_only=False))
        srid = pa.array(np.full(len(geoms), target, dtype="int32"))
        return pa.StructArray.from_arrays(
            [srid, geoms.field("kind"), moved], names=["srid", "kind", "parts"], mask=gone
        )

    return move


def reproject(
    df: DataFrame, column: str, target: int, source: int | None = None, points_only: bool = False
) -> DataFrame:
    """Coordinates and SRID of ``column`` in ``target``.

    ``source`` None takes the SRID each row declares (0 means: assign only).  Geometries
    are moved by numpy on the flattened coordinates of each Arrow batch; rows that are in
    ``target`` already stay in the JVM.  ``points_only`` promises points: they are moved by
    Catalyst expressions inside whole-stage codegen, and another kind raises.  A geometry
    with a vertex outside the projection becomes NULL.
    """
    crs.check_supported(target)
    if source is not None:
        crs.check_supported(source)
    geom, first = F.col(column), first_vertex(column)
    declared = F.coalesce(geom["srid"], F.lit(0))
    assigned = geom.withField("srid", F.lit(target))
    stays = declared.isin(0, target) if source is None else F.lit(source == target)
    if not points_only:
        mover = F.arrow_udf(_move_batch(source, target), GEOMETRY)
        return df.withColumn(
            column, F.when(stays, assigned).otherwise(mover(F.when(~stays, geom)))
        )
    other = F.raise_error(F.lit(f"{column}: points_only, but another kind was found"))
    code = source if source is not None else F.when(stays, F.lit(target)).otherwise(declared)
    px, py = f"__{column}_x", f"__{column}_y"
    placed = df.withColumns({px: first["x"], py: first["y"]})
    return (
        crs.project_columns(placed, px, py, code, target)
        .withColumn(
            column,
            F.when(geom.isNull(), None)
            .when(geom["kind"] != "Point", other.cast(GEOMETRY))
            .when(first.isNull(), assigned)
            .when(F.isnan(px) | F.isnan(py), None)
            .otherwise(point(F.col(px), F.col(py), first["z"], target)),
        )
        .drop(px, py)
    )


def bounds(column: str) -> dict[str, Column]:
    """Bounding box columns xmin, ymin, xmax, ymax of a geometry."""
    first, every = first_vertex(column), vertices(column)
    is_point = F.col(column)["kind"] == "Point"

    def side(axis: str, pick) -> Column:
        values = F.transform(every, lambda v: v[axis])
        return F.when(is_point, first[axis]).otherwise(pick(values))

    return {
        "xmin": side("x", F.array_min),
        "ymin": side("y", F.array_min),
        "xmax": side("x", F.array_max),
        "ymax": side("y", F.array_max),
    }


# Twice the enclosed area of a ring, by the shoelace rule about its first vertex.
_RING = """abs(aggregate(
    zip_with({r}, slice({r}, 2, size({r})), (a, b) -> coalesce(
        (a.x - {r}[0].x) * (b.y - {r}[0].y) - (b.x - {r}[0].x) * (a.y - {r}[0].y), 0D)),
    0D, (s, t) -> s + t))"""
# Outer ring minus holes, summed over the parts.
_AREA = f"""CASE
    WHEN {{g}}.kind LIKE '%Polygon' THEN aggregate({{g}}.parts, 0D, (total, part) -> total
        + coalesce({_RING.format(r="part[0]")}, 0D)
        - aggregate(part, 0D, (s, ring) -> s + {_RING.format(r="ring")}) / 2)
    WHEN {{g}} IS NOT NULL THEN 0D END"""
_FIRST = "get(get(get({g}.parts, 0), 0), 0)"


def area(column: str) -> Column:
    """Planar area: 0 for points and lines, NULL for a NULL geometry."""
    return F.expr(_AREA.format(g=f"`{column}`"))


def _edges(ring: Column, value) -> Column:
    """``value(a, b)`` of each pair of neighbouring vertices of a closed ring."""
    return F.zip_with(ring, F.slice(ring, 2, F.size(ring)), value)


def _turn(ring: Column) -> Column:
    """Signed shoelace sum of a ring, negative when it runs clockwise."""
    o = ring[0]

    def term(a: Column, b: Column) -> Column:
        cross = (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
        return F.coalesce(cross, F.lit(0.0))

    return F.aggregate(_edges(ring, term), F.lit(0.0), lambda s, t: s + t)


def _is_inside(p: Column, ring: Column) -> Column:
    """Whether a vertex lies inside a ring: parity of the edges a ray to the right crosses."""

    def crossed(a: Column, b: Column) -> Column:
        meets = (a["y"] > p["y"]) != (b["y"] > p["y"])
        share = F.try_divide(p["y"] - a["y"], b["y"] - a["y"])
        return F.coalesce(meets & (p["x"] < a["x"] + (b["x"] - a["x"]) * share), F.lit(False))

    return F.aggregate(_edges(ring, crossed), F.lit(False), lambda odd, hit: odd != hit)


def ring_parts(rings: Column) -> Column:
    """Polygon parts from loose rings: clockwise rings are outer, the others holes.

    A hole joins the smallest outer ring around its first vertex; one that lies in none
    becomes a part of its own.
    """
    sized = F.transform(rings, lambda r: F.struct(r.alias("ring"), _turn(r).alias("turn")))
    outers = F.filter(sized, lambda s: s["turn"] <= 0)
    holes = F.filter(sized, lambda s: s["turn"] > 0)

    def owner(hole: Column) -> Column:
        around = F.transform(outers, lambda o, i: F.when(
            _is_inside(hole["ring"][0], o["ring"]),
            F.struct((-o["turn"]).alias("size"), i.alias("of")),
        ))
        return F.array_min(around)["of"]

    owned = F.transform(holes, lambda h: F.struct(h["ring"].alias("ring"), owner(h).alias("of")))
    parts = F.transform(outers, lambda o, i: F.concat(
        F.array(o["ring"]),
        F.transform(F.filter(owned, lambda h: h["of"] == i), lambda h: h["ring"]),
    ))
    loose = F.transform(F.filter(owned, lambda h: h["of"].isNull()), lambda h: F.array(h["ring"]))
    return F.when(F.size(rings) == 1, F.array(rings)).otherwise(F.concat(parts, loose))


def register_functions(spark: SparkSession) -> None:
    """Expose the scalar geometry functions to SQL scripts as inlined SQL functions.

    Spark reserves the names ``st_srid`` and ``st_setsrid`` for its own geometry type,
    hence ``st_get_srid`` and ``st_set_srid``.
    """
    bodies = {
        "st_area(g {t}) RETURNS DOUBLE": _AREA.format(g="g"),
        "st_x(g {t}) RETURNS DOUBLE": _FIRST.format(g="g") + ".x",
        "st_y(g {t}) RETURNS DOUBLE": _FIRST.format(g="g") + ".y",
        "st_set_srid(g {t}, epsg INT) RETURNS {t}": (
            "if(g IS NULL, NULL, named_struct('srid', epsg, 'kind', g.kind, 'parts', g.parts))"
        ),
        "st_get_srid(g {t}) RETURNS INT": "g.srid",
        "st_multi(g {t}) RETURNS {t}": (
            "if(g IS NULL, NULL, named_struct('srid', g.srid, 'kind',"
            " if(g.kind LIKE 'Multi%', g.kind, concat('Multi', g.kind)), 'parts', g.parts))"
        ),
        "st_point(x DOUBLE, y DOUBLE) RETURNS {t}": (
            "named_struct('srid', 0, 'kind', 'Point', 'parts', array(array(array("
            "named_struct('x', x, 'y', y, 'z', CAST(NULL AS DOUBLE))))))"
        ),
    }
    for head, body in bodies.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {head.format(t=GEOMETRY_DDL)} RETURN {body}"
        )


def distinct_points(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Union of point geometries per group, one row per distinct vertex: keys, srid, x, y, z.

    NULL geometries add nothing; any kind but points is an error.
    """
    kind = F.col(column)["kind"]
    spots = F.when(kind.isin("Point", "MultiPoint") | kind.isNull(), vertices(column)).otherwise(
        F.raise_error(F.concat(F.lit("a union of points holds a "), kind)))
    return (
        df.select(*keys, F.col(column)["srid"].alias("srid"), F.explode(spots).alias("v"))
        .select(*keys, "srid", "v.x", "v.y", "v.z").distinct()
    )


def union_points(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Union of point geometries per group, one MultiPoint of distinct, sorted vertices each.

    A MultiPoint is one value in one row; ``distinct_points`` has no such bound.
    """
    return distinct_points(df, keys, column).groupBy(*keys, "srid").agg(
        F.array_sort(F.collect_list(F.struct("x", "y", "z"))).alias("__points")
    ).select(
        *keys,
        geometry("MultiPoint", F.transform("__points", lambda v: F.array(F.array(v))),
                 F.col("srid")).alias(column),
    )


def extent(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Bounding box of all geometries of a group, of any kind."""
    box = bounds(column)
    return df.groupBy(*keys).agg(
        F.min(box["xmin"]).alias("xmin"), F.min(box["ymin"]).alias("ymin"),
        F.max(box["xmax"]).alias("xmax"), F.max(box["ymax"]).alias("ymax"),
    )
