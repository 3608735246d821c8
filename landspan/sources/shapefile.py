"""Shapefiles, read by record ranges taken from the size of the index file."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.functions import geometry as geo
from landspan.sources.files import first_path, listing, open_file, read_at, spread

# Shape types by geometry; +10 carries z, +20 a measure.
SHAPES = {1: "Point", 3: "LineString", 5: "Polygon", 8: "MultiPoint"}
# Sizes of the index header and of one index entry, in bytes.
INDEX_HEADER, INDEX_ENTRY = 100, 8
# Bytes of shapes and attributes that are decoded together.
BATCH_BYTES = 32 << 20
# Records that are worth a task.
ROWS_PER_TASK = 250_000
# Names by which a .prj file without a code calls the systems known here; UTM by rule.
NAMED_SYSTEMS = {
    "GCS_WGS_1984": 4326,
    "WGS_1984_Web_Mercator_Auxiliary_Sphere": 3857,
    "NZGD_2000_New_Zealand_Transverse_Mercator": 2193,
    "NZGD2000_New_Zealand_Transverse_Mercator_2000": 2193,
}
RAW = pa.schema([
    ("record", pa.int64()),
    ("srid", pa.int32()),
    ("kind", pa.string()),
    ("lines", pa.list_(pa.list_(pa.struct(
        [("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])))),
    ("fields", pa.list_(pa.string())),
])
RAW_DDL = """record long, srid int, kind string, lines array<array<struct<x:double,y:double,z:double>>>,
    fields array<string>"""


def _table_header(path: str) -> tuple[int, int, list[tuple[str, str, int, int]]]:
    """(header size, record size, fields as (name, type, width, decimals)) of a .dbf."""
    size, record = struct.unpack_from("<HH", read_at(path, 0, 32), 8)
    raw = read_at(path, 32, size - 32)
    fields = []
    for at in range(0, len(raw) - 31, 32):
        if raw[at] == 0x0D:
            break
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
    return size, record, fields


def _lines(raw: bytes, at: int, code: int) -> list[np.ndarray]:
    """Vertex blocks of one record, as (n, 3) arrays; z is NaN when absent."""
    base, has_z = code % 10, 10 < code < 20
    if base == 1:
        xyz = np.full((1, 3), np.nan)
        count = 3 if has_z else 2
        xyz[0, :count] = np.frombuffer(raw, "<f8", count, at)
        return [xyz]
    if base == 8:
        starts, total, at = np.zeros(1, int), struct.unpack_from("<i", raw, at + 32)[0], at + 36
    else:
        parts, total = struct.unpack_from("<2i", raw, at + 32)
        starts = np.frombuffer(raw, "<i4", parts, at + 40)
        at += 40 + 4 * parts
    xyz = np.full((total, 3), np.nan)
    xyz[:, :2] = np.frombuffer(raw, "<f8", 2 * total, at).reshape(total, 2)
    if has_z:
        xyz[:, 2] = np.frombuffer(raw, "<f8", total, at + 16 * total + 16)
    return np.split(xyz, starts[1:])


def _beside(index: str, suffix: str) -> str:
    """File next to an index file, its suffix in the same case."""
    return index[:-3] + (suffix.upper() if index[-3:].isupper() else suffix)


def _shape_kind(code: int) -> str | None:
    """Geometry kind of a shape type, None for the null shape; other types are an error."""
    if code and (code % 10 not in SHAPES or code > 28):
        raise ValueError(f"shape type {code} cannot be read")
    return SHAPES[code % 10] if code else None


def _batch(records: list, srid: int, kinds: list, shapes: list, fields: list) -> pa.RecordBatch:
    lines = [line for shape in shapes for line in shape]
    xyz = np.concatenate(lines) if lines else np.empty((0, 3))
    nested = pa.StructArray.from_arrays(
        [pa.array(xyz[:, 0]), pa.array(xyz[:, 1]), pa.array(xyz[:, 2], from_pandas=True)],
        names=["x", "y", "z"],
    )
    for sizes in ([len(line) for line in lines], [len(shape) for shape in shapes]):
        nested = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), nested)
    arrays = [pa.array(records, pa.int64()), pa.array([srid] * len(records), pa.int32()), pa.array(kinds, pa.string()), nested,
              pa.array(fields, RAW.field("fields").type)]
    return pa.RecordBatch.from_arrays(arrays, schema=RAW)


def _reader(expected: list, encoding: str):
    """Arrow function that decodes the records of each ``(stem, low, high)`` range."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                at_index, low, count = piece["index"], piece["low"], piece["high"] - piece["low"] + 1
                records = _beside(at_index, "dbf")
                head, width, fields = _table_header(records)
                if fields != expected:
                    raise ValueError(f"{records} has other fields than the first file")
                index = read_at(at_index, INDEX_HEADER + INDEX_ENTRY * low, INDEX_ENTRY * count)
                # Offsets and lengths count 16-bit words.
                entries = np.frombuffer(index, ">i4").reshape(-1, 2).astype("i8") * 2
                srid = _declared_srid(at_index)
                # Large shapes come in several batches of a bounded number of bytes.
                filled = np.cumsum(entries[:, 1] + 8 + width) // BATCH_BYTES
                for rows in np.split(np.arange(count), np.flatnonzero(np.diff(filled)) + 1):
                    some, begin = entries[rows], low + int(rows[0])
                    first, last = some[:, 0].min(), (some[:, 0] + some[:, 1] + 8).max()
                    shapes = read_at(_beside(at_index, "shp"), int(first), int(last - first))
                    table = read_at(records, head + width * begin, width * len(rows))
                    out = ([], [], [], [])
                    for i, start in enumerate(some[:, 0] - first + 8):
                        row = table[i * width : (i + 1) * width]
                        if row[:1] == b"*":
                            continue
                        (code,) = struct.unpack_from("<i", shapes, start)
                        at, texts = 1, []
                        for _, _, size, _ in fields:
                            texts.append(row[at : at + size].decode(encoding).strip(" \0"))
                            at += size
                        out[0].append(begin + i)
                        out[1].append(_shape_kind(code))
                        out[2].append(_lines(shapes, start + 4, code) if code else [])
                        out[3].append(texts)
                    yield _batch(out[0], srid, *out[1:])

    return read


def _attribute(text: Column, kind: str, width: int, decimals: int) -> Column:
    """Typed value of one fixed-width text field; blank is NULL."""
    filled = F.nullif(text, F.lit(""))
    if kind == "N" and decimals == 0:
        return filled.try_cast("bigint" if width <= 18 else f"decimal({min(width, 38)},0)")
    if kind in "NF":
        return filled.try_cast("double")
    if kind == "D":
        return F.try_to_date(filled, "yyyyMMdd")
    if kind == "L":
        return F.when(F.lower(filled).isin("t", "y"), True).when(F.lower(filled).isin("f", "n"), False)
    return filled


def _declared_srid(index: str) -> int:
    """EPSG code named by the .prj file, else the code of its system's name, else 0."""
    try:
        with open_file(_beside(index, "prj")) as handle:
            text = handle.read().decode("latin-1")
    except FileNotFoundError:
        return 0
    codes = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]', text)
    if codes:
        return int(codes[-1])
    name = (re.findall(r'^\s*(?:PROJCS|GEOGCS)\["([^"]*)"', text) or [""])[0]
    zone = re.fullmatch(r"WGS_1984_UTM_Zone_(\d{1,2})([NS])", name)
    if zone:
        return (32600 if zone[2] == "N" else 32700) + int(zone[1])
    return NAMED_SYSTEMS.get(name, 0)


def read_shapefile(
    spark: SparkSession, path: str, encoding: str = "utf-8", rows_per_task: int = ROWS_PER_TASK,
    geometry_name: str = "geom",
) -> DataFrame:
    """Attributes and geometry of one shapefile, or of all below a folder.

    The number of records follows from the size of each index file, so ranges are planned
    from the listing alone; every range reads its own bytes of the three files.
    """
    where = _beside(path, "shx") if path[-4:].lower() == ".shp" else path
    files = listing(spark, where, "shx").select(
        F.col("path").alias("index"),
        F.floor((F.col("length") - INDEX_HEADER) / INDEX_ENTRY).alias("records"),
    )
    first = first_path(files.withColumnRenamed("index", "path"), path)
    _, _, fields = _table_header(_beside(first, "dbf"))
    lows = F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(rows_per_task).cast("long"))
    ranges = files.where("records > 0").select("index", "records", F.explode(lows).alias("low"))
    ranges = ranges.select(
        "index", "low", F.least(F.col("low") + rows_per_task, F.col("records")) .alias("end")
    ).select("index", "low", (F.col("end") - 1).alias("high"))
    raw = spread(ranges, "index", "low", together=ROWS_PER_TASK // rows_per_task).mapInArrow(_reader(fields, encoding), RAW_DDL)
    lines = F.col("lines")
    parts = (
        F.when(F.col("kind") == "Polygon", geo.ring_parts(lines))
        .when(F.col("kind") == "LineString", F.transform(lines, lambda line: F.array(line)))
        .when(F.col("kind") == "MultiPoint",
              F.transform(F.flatten(lines), lambda v: F.array(F.array(v))))
        .otherwise(F.transform(lines, lambda line: F.array(line)))
    )
    shaped = raw.withColumn("__parts", parts)
    many = (F.size("__parts") > 1) & F.col("kind").isin("Polygon", "LineString")
    kind = F.when(many, F.concat(F.lit("Multi"), "kind")).otherwise(F.col("kind"))
    shape = geo.geometry(kind, F.col("__parts"), F.col("srid"))
    return shaped.select(
        *[
            _attribute(F.col("fields")[i], *kind_width).alias(name)
            for i, (name, *kind_width) in enumerate(fields)
        ],
        F.when(F.col("kind").isNotNull(), shape).alias(geometry_name),
    )
