"""One call from a dataset to a checked, published table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landspan.functions import geometry as geo
from landspan.operators import checks, columns, georef, layout, tables
from landspan.sources import csv, duckdb, features, raster, shapefile, wfs
from landspan.workspace import materialize


@dataclass(frozen=True)
class CSVSource:
    """CSV file or folder; ``pk`` declares existing columns, comma separated.

    Separator, quote and header are found out unless they are given.
    """

    path: str
    pk: str | None = None
    schema: T.StructType | str | None = None
    separator: str | None = None
    quote: str | None = None
    header: bool | None = None
    encoding: str = "UTF-8"


@dataclass(frozen=True)
class DuckDBSource:
    """Table of a DuckDB file or of a folder of files."""

    path: str
    table: str
    epsg: int | str | None = None
    pk: str | None = None


@dataclass(frozen=True)
class EsriSource:
    """Layer of an Esri feature service, or a folder of saved pages."""

    url: str
    f: str = features.GEOJSON
    epsg: int | str | None = None
    pk: str | None = None
    fetch: Callable[[str], str] | None = None
    # Attribute with the service's object ids; pages are then ranges of it.
    id_field: str | None = None


@dataclass(frozen=True)
class WFSSource:
    """Layer of a web feature service, or a folder of saved responses."""

    url: str
    layer: str
    epsg: int | str | None = None
    pk: str | None = None
    fetch: Callable[[str], str] | None = None


@dataclass(frozen=True)
class FileSource:
    """Shapefile, or a folder of them."""

    path: str
    epsg: int | str | None = None
    pk: str | None = None
    encoding: str = "utf-8"


@dataclass(frozen=True)
class RasterSource:
    """GeoTIFF file or folder; ``epsg`` only assigns."""

    path: str
    epsg: int | str | None = None


@dataclass(frozen=True)
class Destination:
    """Where and how a dataset is published."""

    table: str
    geom_column: str | None = None
    geom_index: bool = False
    attributes_only: bool = False
    raster_column: str = "rast"
    raster_index: bool = False
    raster_constraints: bool = False
    tile_size: int | None = None


Source = CSVSource | DuckDBSource | EsriSource | WFSSource | FileSource | RasterSource


def _vector(df: DataFrame, source, dest: Destination, multi: bool) -> DataFrame:
    """Geometry options and the feature id of a loaded layer."""
    if dest.attributes_only:
        df = columns.attributes_only(df)
    for column in geo.geometry_columns(df):
        df = georef.apply_epsg(df, column, source.epsg)
        if multi:
            df = geo.promote_to_multi(df, column)
    df = columns.launder(columns.rename_geometry(df, dest.geom_column))
    return _identified(df, columns.laundered(source.pk or "gid"))


def _identified(df: DataFrame, key: str) -> DataFrame:
    """A feature id named ``key``: an integer attribute of that name, else a new one."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if key not in kinds:
        return columns.add_feature_id(df, key)
    if not isinstance(kinds[key], T.IntegralType):
        raise ValueError(f"{key} exists and is no integer, so it cannot be the feature id")
    flagged = F.col(key).alias(key, metadata={duckdb.KEY: True})
    return df.select(flagged, *[F.col(columns.quoted(c)) for c in df.columns if c != key])


def read(spark: SparkSession, source: Source, dest: Destination) -> DataFrame:
    """The rows of a load, lazily: reader, column operators, georeference."""
    match source:
        case CSVSource():
            if dest.geom_column or dest.geom_index or dest.attributes_only:
                raise ValueError("a CSV has no geometry to name, index or leave out")
            return csv.read_csv_as_found(spark, source.path, source.schema, source.separator, source.quote,
                                         source.header, source.encoding)
        case DuckDBSource():
            if source.pk is not None:
                raise NotImplementedError("a DuckDB source brings its own primary key")
            df = duckdb.read_duckdb(spark, source.path, source.table,
                                    with_geometry=not dest.attributes_only)
            for column in geo.geometry_columns(df):
                df = georef.apply_epsg(df, column, source.epsg)
            return columns.launder(columns.rename_geometry(df, dest.geom_column))
        case EsriSource():
            if source.fetch is not None:
                df = features.fetch_features(spark, source.url, source.fetch, source.f, id_field=source.id_field)
            else:
                df = features.parse_pages(features.saved_pages(spark, source.url), source.f)
            return _vector(df, source, dest, multi=True)
        case WFSSource():
            if source.fetch is not None:
                df = wfs.fetch_wfs(spark, source.url, source.layer, source.fetch)
            else:
                df = wfs.read_wfs(spark, source.url, source.layer)
            return _vector(df, source, dest, multi=False)
        case FileSource():
            if PurePosixPath(source.path).suffix.lower() not in (".shp", ""):
                raise NotImplementedError(f"no reader for {source.path}")
            return _vector(shapefile.read_shapefile(spark, source.path, source.encoding), source, dest, multi=True)
        case RasterSource():
            if dest.tile_size is None:
                raise ValueError("a raster load needs a tile size")
            _, epsg = georef.parse_epsg(source.epsg)
            return raster.read_raster(spark, source.path, dest.tile_size, epsg)
    raise NotImplementedError(f"no reader for {type(source).__name__}")


def _keys(df: DataFrame, source: Source) -> list[str]:
    if isinstance(source, CSVSource):
        return [key.strip() for key in source.pk.split(",")] if source.pk else []
    return list(duckdb.declared(df, duckdb.KEY))


def load(spark: SparkSession, source: Source, dest: Destination) -> DataFrame:
    """Read, check and publish one dataset; returns the new table.

    Checks run on a written copy, so the source is read once and a violation leaves the
    old table in place.  Without an index that copy is the staging table itself; with one,
    the checked copy is written again in its spatial layout.
    """
    df = read(spark, source, dest)
    schema, name = tables.split_name(dest.table)
    staged = f"{schema}.{name}__next"
    tables.ensure_schemas(spark, [schema])
    spark.sql(f"DROP TABLE IF EXISTS {tables.sql_name(staged)}")
    is_raster = isinstance(source, RasterSource)
    indexed = geo.geometry_columns(df) if dest.geom_index else []
    if indexed or (is_raster and dest.raster_index):
        rows = materialize(df, "load")
    else:
        _packed(df, dest, is_raster).write.saveAsTable(tables.sql_name(staged))
        rows = spark.table(tables.sql_name(staged))
    checks.require_not_null(rows, list(duckdb.declared(df, duckdb.NOT_NULL)))
    keys = _keys(df, source)
    if keys:
        checks.require_key(rows, keys)
    if is_raster and dest.raster_constraints:
        tiles = rows if dest.raster_index else rows.select(f"{dest.raster_column}.*")
        checks.require_raster_constraints(tiles)
    properties = {}
    if indexed or (is_raster and dest.raster_index):
        if is_raster:
            laid_out, mark = layout.cluster(rows, layout.frame_of(rows)), layout.marker(dest.raster_column)
        else:
            laid_out, mark = layout.lay_out(rows, indexed)
        _packed(laid_out, dest, is_raster).write.saveAsTable(tables.sql_name(staged))
        properties = {layout.LAYOUT_PROPERTY: mark}
    tables.publish(spark, staged, dest.table, properties)
    for column, value in duckdb.declared(df, duckdb.DEFAULT).items():
        columns.set_default(spark, dest.table, column, str(value))
    return spark.table(tables.sql_name(dest.table))


def _packed(df: DataFrame, dest: Destination, is_raster: bool) -> DataFrame:
    """Raster tiles in one column, bounds and key beside it when indexed; vectors as is."""
    if not is_raster:
        return df
    beside = [*layout.BOX, "morton"] if dest.raster_index else []
    tile = [c for c in df.columns if c not in ("rid", "morton")]
    return df.select("rid", F.struct(*tile).alias(dest.raster_column), *beside)
