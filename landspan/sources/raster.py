"""GeoTIFF rasters as square tiles.

Two passes: headers give one row per band of tiles, then each such piece reads only the
strips or blocks it covers.  Baseline layout: uncompressed or deflate, strips or blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.operators.columns import add_feature_id
from landspan.sources.files import first_path, listing, open_file, spread

# TIFF field types as (struct code, size).
FIELD_TYPES = {
    1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2),
    9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8),
}
# TIFF and GeoTIFF tags that are read.
WIDTH, HEIGHT, BITS, COMPRESSION = 256, 257, 258, 259
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, BLOCK_WIDTH, BLOCK_HEIGHT, BLOCK_OFFSETS, BLOCK_SIZES = 317, 322, 323, 324, 325
FORMAT, PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, NODATA = 339, 33550, 33922, 34264, 34735, 42113
# Compression codes, and the geo keys of a projected / geographic system.
PLAIN, DEFLATE = 1, (8, 32946)
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048
# The geo key of what a coordinate stands for, and its value for a pixel's center.
RASTER_TYPE_KEY, PIXEL_IS_POINT = 1025, 2

# left and top are the corner of the tile's first pixel; the box holds the whole tile, also a turned one.
TILE_DDL = """rid long, path string, tile_col int, tile_row int, srid int, xmin double,
    ymin double, xmax double, ymax double, scale_x double, scale_y double, width int,
    height int, nodata double, bands array<array<double>>, left double, top double,
    skew_x double, skew_y double, pixel_type string"""


# Pixels of a piece that is worth a task, and of a frame of tiles that is handed on.
PIECE_PIXELS, FRAME_PIXELS = 8192, 1 << 18
_TILE_COLUMNS = [column.split()[0] for column in TILE_DDL.split(",")]


def _placement(path: str, tags: dict, centered: bool) -> tuple[float, ...]:
    """left, scale_x, skew_x, top, skew_y, scale_y: x = left + scale_x * column + skew_x * row,
    y = top + skew_y * column + scale_y * row, for the corner of a pixel.
    """
    if MATRIX in tags:
        m = tags[MATRIX]
        place = m[3], m[0], m[1], m[7], m[4], m[5]
    elif PIXEL_SCALE in tags:
        tie, (across, down, *_) = tags.get(TIE_POINT, (0.0,) * 6), tags[PIXEL_SCALE]
        place = tie[3] - tie[0] * across, across, 0.0, tie[4] + tie[1] * down, 0.0, -down
    elif len(tags.get(TIE_POINT, ())) > 6:
        raise ValueError(f"{path}: control points without a pixel size are not supported")
    else:
        place = 0.0, 1.0, 0.0, 0.0, 0.0, -1.0
    left, scale_x, skew_x, top, skew_y, scale_y = place
    if scale_x * scale_y == skew_x * skew_y:
        raise ValueError(f"{path}: its pixels have no area")
    if centered:  # coordinates name the center of a pixel
        left, top = left - (scale_x + skew_x) / 2, top - (skew_y + scale_y) / 2
    return left, scale_x, skew_x, top, skew_y, scale_y


def _header(path: str) -> SimpleNamespace:
    """Layout and georeference of a file, from its first image directory."""
    with open_file(path) as handle:
        mark = handle.read(8)
        order = "<" if mark[:2] == b"II" else ">"
        magic, at = struct.unpack(order + "HI", mark[2:])
        if mark[:2] not in (b"II", b"MM") or magic != 42:
            raise ValueError(f"{path} is no classic TIFF")
        handle.seek(at)
        (count,) = struct.unpack(order + "H", handle.read(2))
        entries = handle.read(12 * count)
        tags = {}
        for i in range(count):
            tag, kind, length = struct.unpack_from(order + "HHI", entries, 12 * i)
            if kind not in FIELD_TYPES:
                continue
            code, size = FIELD_TYPES[kind]
            raw = entries[12 * i + 8 : 12 * i + 12]
            if length * size > 4:
                handle.seek(struct.unpack(order + "I", raw)[0])
                raw = handle.read(length * size)
            if kind == 2:
                tags[tag] = raw[:length].split(b"\0")[0].decode("latin-1")
            else:
                tags[tag] = struct.unpack_from(f"{order}{length * len(code)}{code[0]}", raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, width, height = one(BITS, 1), one(WIDTH, 0), one(HEIGHT, 0)
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    if bits % 8 or one(PREDICTOR, 1) not in (1, 2) or one(COMPRESSION, PLAIN) not in (PLAIN, *DEFLATE):
        raise ValueError(f"{path}: unsupported bit depth, predictor or compression")
    blocks = BLOCK_OFFSETS in tags
    keys = np.array(tags.get(GEO_KEYS, ()), int).reshape(-1, 4)[1:]
    srids = {int(k): int(v) for k, where, _, v in keys if where == 0}
    left, scale_x, skew_x, top, skew_y, scale_y = _placement(
        path, tags, srids.get(RASTER_TYPE_KEY) == PIXEL_IS_POINT)
    return SimpleNamespace(
        width=width, height=height, bands=one(SAMPLES, 1), dtype=f"{order}{kind}{bits // 8}",
        deflate=one(COMPRESSION, PLAIN) in DEFLATE, predictor=one(PREDICTOR, 1),
        planar=one(PLANAR, 1) == 2,
        block_width=one(BLOCK_WIDTH, width) if blocks else width,
        block_height=one(BLOCK_HEIGHT, height) if blocks else min(one(ROWS_PER_STRIP, height), height),
        whole_blocks=blocks,
        offsets=tags[BLOCK_OFFSETS if blocks else STRIP_OFFSETS],
        sizes=tags[BLOCK_SIZES if blocks else STRIP_SIZES],
        scale_x=scale_x, scale_y=scale_y, skew_x=skew_x, skew_y=skew_y, left=left, top=top,
        pixel_type=f"{bits}B{ {'u': 'UI', 'i': 'SI', 'f': 'F'}[kind]}",
        srid=srids.get(PROJECTED_KEY) or srids.get(GEOGRAPHIC_KEY) or 0,
        nodata=float(tags[NODATA]) if NODATA in tags else None,
    )


def _window(handle, head: SimpleNamespace, x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
    """Pixels ``(bands, y1 - y0, x1 - x0)``, from the blocks that meet the window."""
    across = -(-head.width // head.block_width)
    down = -(-head.height // head.block_height)
    out = np.empty((head.bands, y1 - y0, x1 - x0), head.dtype)
    samples = 1 if head.planar else head.bands
    for plane in range(head.bands if head.planar else 1):
        for row in range(y0 // head.block_height, -(-y1 // head.block_height)):
            for col in range(x0 // head.block_width, -(-x1 // head.block_width)):
                at = (plane * down + row) * across + col
                handle.seek(head.offsets[at])
                raw = handle.read(head.sizes[at])
                raw = zlib.decompress(raw) if head.deflate else raw
                top, left = row * head.block_height, col * head.block_width
                # The last strip may be short; blocks are always whole.
                rows = head.block_height if head.whole_blocks else min(head.block_height, head.height - top)
                shape = (rows, head.block_width, samples)
                block = np.frombuffer(raw, head.dtype, rows * head.block_width * samples).reshape(shape)
                if head.predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=head.dtype)
                ya, yb = max(y0, top), min(y1, top + rows)
                xa, xb = max(x0, left), min(x1, left + head.block_width)
                part = block[ya - top : yb - top, xa - left : xb - left].transpose(2, 0, 1)
                first = plane if head.planar else 0
                out[first : first + samples, ya - y0 : yb - y0, xa - x0 : xb - x0] = part
    return out


def _sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        heads = [_header(path) for path in frame["path"]]
        yield pd.DataFrame({
            "path": frame["path"], "raster_width": [h.width for h in heads],
            "raster_height": [h.height for h in heads],
        })


def _tiles(tile: int):
    """Pandas function that cuts each ``(path, tile_row, cols)`` piece into tiles."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, pixels = [], 0
        for frame in frames:
            for path, pieces in frame.groupby("path", sort=False):
                head = _header(path)
                with open_file(path) as handle:
                    for piece in pieces.itertuples():
                        for row in _piece(handle, head, piece, tile):
                            found.append(row)
                            pixels += row["width"] * row["height"] * head.bands
                            if pixels >= FRAME_PIXELS:
                                yield pd.DataFrame(found, columns=_TILE_COLUMNS)
                                found, pixels = [], 0
        if found:
            yield pd.DataFrame(found, columns=_TILE_COLUMNS)

    return cut


def _piece(handle, head: SimpleNamespace, piece, tile: int) -> Iterator[dict]:
    """Tiles of one piece."""
    y0, y1 = piece.tile_row * tile, min((piece.tile_row + 1) * tile, head.height)
    x0, x1 = piece.first_col * tile, min((piece.last_col + 1) * tile, head.width)
    pixels = _window(handle, head, x0, x1, y0, y1)
    for col in range(piece.first_col, piece.last_col + 1):
        left, right = col * tile, min((col + 1) * tile, head.width)
        bands = pixels[:, :, left - x0 : right - x0].reshape(head.bands, -1).astype("f8")
        corners = [(head.left + c * head.scale_x + r * head.skew_x, head.top + c * head.skew_y + r * head.scale_y)
                   for c in (left, right) for r in (y0, y1)]
        xs, ys = zip(*corners)
        yield {
            "rid": piece.rid + col - piece.first_col, "path": piece.path,
            "tile_col": col, "tile_row": piece.tile_row, "srid": head.srid,
            "xmin": min(xs), "xmax": max(xs), "ymin": min(ys), "ymax": max(ys),
            "left": corners[0][0], "top": corners[0][1], "scale_x": head.scale_x, "scale_y": head.scale_y,
            "skew_x": head.skew_x, "skew_y": head.skew_y, "pixel_type": head.pixel_type,
            "width": right - left, "height": y1 - y0, "nodata": head.nodata,
            "bands": list(bands),
        }


def read_raster(
    spark: SparkSession, path: str, tile_size: int, epsg: int | None = None,
    pixels_per_piece: int = PIECE_PIXELS,
) -> DataFrame:
    """Tiles of one GeoTIFF, or of all below a folder; edge tiles keep their partial size.

    A piece is a run of neighbouring tiles of one tile row, so strips that cross many
    tiles are decoded once.  ``epsg`` assigns an SRID and never moves a pixel.
    """
    if tile_size < 1:
        raise ValueError("tile_size must be positive")
    files = listing(spark, path, "tif", "tiff", "gtiff").select("path")
    first_path(files, path)
    sizes = files.mapInPandas(_sizes, "path string, raster_width int, raster_height int")
    per_piece = max(1, pixels_per_piece // tile_size)

    def last(side: str):
        return F.floor((F.col(side) - 1) / tile_size).cast("int")

    pieces = (
        sizes.where("raster_width > 0 AND raster_height > 0")
        .select("path", last("raster_width").alias("end_col"),
                F.explode(F.sequence(F.lit(0), last("raster_height"))).alias("tile_row"))
        .select("path", "tile_row", "end_col", F.explode(
            F.sequence(F.lit(0), F.col("end_col"), F.lit(per_piece))).alias("first_col"))
        .withColumn("last_col", F.least(F.col("first_col") + per_piece - 1, "end_col"))
    )
    # Tile ids are dense: number the tiles of all pieces before any pixel is read.
    slots = pieces.select("*", F.explode(F.sequence("first_col", "last_col")).alias("tile_col"))
    numbered = add_feature_id(slots.select("path", "tile_row", "tile_col", "first_col", "last_col"),
                              "rid", ["path", "tile_row", "tile_col"])
    starts = numbered.where("tile_col = first_col").drop("tile_col")
    tiles = spread(starts, "path", "tile_row", "first_col", together=PIECE_PIXELS // max(pixels_per_piece, tile_size)
                   ).mapInPandas(_tiles(tile_size), TILE_DDL)
    return tiles if epsg is None else tiles.withColumn("srid", F.lit(epsg))
