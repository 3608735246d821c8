"""Spatial layout: bounding boxes, Morton keys and clustered writes.

Parquet keeps min/max per row group, so rows sorted along a Morton curve let a
bounding-box filter skip most of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landspan.functions import geometry as geo

MORTON_BITS = 16
BOX = ("xmin", "ymin", "xmax", "ymax")
# Table property that marks a finished layout.
LAYOUT_PROPERTY = "spatial.layout"


def prefix_for(names: list[str], column: str) -> str:
    """Prefix for the bounds and key of a geometry column that hides no attribute."""
    prefix = ""
    while any(f"{prefix}{n}" in names for n in (*BOX, "morton")):
        prefix = f"{column}_{prefix}"
    return prefix


def add_bounds(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Bounding box columns of a geometry column."""
    return df.withColumns({f"{prefix}{n}": c for n, c in geo.bounds(column).items()})


def _spread(cell: Column) -> Column:
    """Insert a zero bit after each of the 16 bits."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        cell = F.shiftleft(cell, shift).bitwiseOR(cell).bitwiseAND(F.lit(mask))
    return cell


def morton(x: Column, y: Column, frame: tuple[float, float, float, float]) -> Column:
    """Morton key of a position within ``frame`` (xmin, ymin, xmax, ymax), 16 bits a side."""
    xmin, ymin, xmax, ymax = frame
    top = (1 << MORTON_BITS) - 1

    def cell(value: Column, low: float, high: float) -> Column:
        share = (value - low) / (high - low) if high > low else F.lit(0.0)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * top).cast("long")

    return _spread(cell(x, xmin, xmax)).bitwiseOR(F.shiftleft(_spread(cell(y, ymin, ymax)), 1))


def marker(column: str, prefix: str = "") -> str:
    """Value of the layout property for a table laid out along ``column``."""
    return f"{column}:{prefix}morton"


def frame_of(df: DataFrame, prefix: str = "") -> tuple[float, float, float, float]:
    """Extent over the bounding box columns; all zero when there is no geometry."""
    row = df.agg(*[f(f"{prefix}{n}") for f, n in zip((F.min, F.min, F.max, F.max), BOX)]).first()
    return (0.0, 0.0, 0.0, 0.0) if row[0] is None else tuple(row)


def cluster(
    df: DataFrame, frame: tuple[float, float, float, float], prefix: str = ""
) -> DataFrame:
    """Range-partition and sort rows by the Morton key of their box centre.

    The row number is the last range column: many rows on one spot still spread over
    several partitions.
    """
    centre = [(F.col(f"{prefix}{a}") + F.col(f"{prefix}{b}")) / 2
              for a, b in (("xmin", "xmax"), ("ymin", "ymax"))]
    key = f"{prefix}morton"
    keyed = df.withColumn(key, morton(*centre, frame))
    keyed = keyed.withColumn("__tie", F.monotonically_increasing_id())
    return (
        keyed.repartitionByRange(key, "__tie").sortWithinPartitions(key).drop("__tie")
    )


def interleaved(cells: list[Column], bits: int) -> Column:
    """One key of the bits of several cells in turn, the lowest bits first."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for place, cell in enumerate(cells):
            one = F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(one, bit * len(cells) + place))
    return out


def cluster_columns(df: DataFrame, frames: dict[str, tuple[float, float, float, float]], key: str) -> DataFrame:
    """Range-partition and sort rows along one curve through the box centres of several geometries.

    frames: extent by the prefix of the bounds. The bits of all sides take turns in the key, so a box of any
    of the geometries skips data, the less the more there are. A NULL geometry counts as the corner.
    """
    bits = min(31, 62 // (2 * len(frames)))
    cells = []
    for prefix, (xmin, ymin, xmax, ymax) in frames.items():
        for low, high, a, b in ((xmin, xmax, "xmin", "xmax"), (ymin, ymax, "ymin", "ymax")):
            centre = (F.col(f"{prefix}{a}") + F.col(f"{prefix}{b}")) / 2
            share = (centre - low) / (high - low) if high > low else F.lit(0.0)
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))
            cells.append(F.floor(share * ((1 << bits) - 1)).cast("long"))
    keyed = df.withColumn(key, interleaved(cells, bits)).withColumn("__tie", F.monotonically_increasing_id())
    return keyed.repartitionByRange(key, "__tie").sortWithinPartitions(key).drop("__tie")


def lay_out(df: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """Rows with the bounds of some geometry columns, along a curve through them; the layout's marker."""
    prefixes, boxed = [], df
    for column in columns:
        # Several columns always have their names in front.
        prefix = prefix_for(boxed.columns, column) if len(columns) == 1 else f"{column}_"
        while any(f"{prefix}{n}" in boxed.columns for n in (*BOX, "morton")):
            prefix = f"{column}_{prefix}"
        prefixes.append(prefix)
        boxed = add_bounds(boxed, column, prefix)
    if len(columns) == 1:
        return cluster(boxed, frame_of(boxed, prefixes[0]), prefixes[0]), marker(columns[0], prefixes[0])
    key = "curve"
    while key in boxed.columns:
        key = f"_{key}"
    frames = {prefix: frame_of(boxed, prefix) for prefix in prefixes}
    places = ",".join(f"{column}={prefix}" for column, prefix in zip(columns, prefixes))
    return cluster_columns(boxed, frames, key), f"{places}:{key}"


def layout_of(spark: SparkSession, table: str) -> str | None:
    """Value of the layout property of a table, None when it has no layout."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {table}").collect()
    return {row["key"]: row["value"] for row in rows}.get(LAYOUT_PROPERTY)


def in_box(
    df: DataFrame, box: tuple[float, float, float, float], prefix: str = ""
) -> DataFrame:
    """Rows whose bounding box meets ``box``; the four comparisons reach the scan."""
    xmin, ymin, xmax, ymax = box
    low_x, low_y, high_x, high_y = (F.col(f"{prefix}{n}") for n in BOX)
    return df.where((low_x <= xmax) & (high_x >= xmin) & (low_y <= ymax) & (high_y >= ymin))
