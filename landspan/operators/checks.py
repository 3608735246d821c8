"""Constraints as queries, run before a table is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.operators.columns import quoted


class ConstraintViolation(ValueError):
    """Data breaks a not-null, key or raster constraint."""


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, nulls)``, from one aggregation over all columns."""
    counts = df.agg(
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    )
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"))
        for i, c in enumerate(columns)
    ]
    return counts.select(F.inline(F.array(*pairs)))


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that are NULL in some column or occur more than once, with their count.

    A hash aggregation with map-side partial counts: copies of one key collapse before
    the shuffle.
    """
    has_null = F.lit(False)
    for key in keys:
        has_null = has_null | F.col(quoted(key)).isNull()
    return (
        df.groupBy(*[F.col(quoted(k)) for k in keys])
        .agg(F.count("*").alias("copies"))
        .where((F.col("copies") > 1) | has_null)
    )


def require_not_null(df: DataFrame, columns: list[str]) -> None:
    """Raise when one of the columns holds NULL."""
    if not columns:
        return
    bad = [row for row in null_counts(df, columns).collect() if row["nulls"]]
    if bad:
        found = ", ".join(f"{row['column']}: {row['nulls']}" for row in bad)
        raise ConstraintViolation(f"NULL in not-null columns ({found})")


def require_key(df: DataFrame, keys: list[str]) -> None:
    """Raise when the columns are no primary key (unique and not null)."""
    bad = key_violations(df, keys).take(5)
    if bad:
        raise ConstraintViolation(f"({', '.join(keys)}) is no primary key, for example {bad}")


# Columns of a tile that constraints look at, beside its bands.
TILE = ["path", "srid", "left", "top", "xmin", "ymin", "xmax", "ymax", "scale_x", "scale_y", "skew_x", "skew_y",
        "width", "height", "nodata", "pixel_type"]
# Thousandths of a pixel that places may differ by, from rounding.
SLACK = 2


def raster_constraints(tiles: DataFrame) -> DataFrame:
    """The standard raster constraints over a tile table, one row each.

    Columns ``name``, ``holds``, ``value``. SRID, scale, skew, band count, pixel type, no-data value and
    alignment must agree on every tile. Tiles have the common size, but for those at the right
    or lower edge of their raster, which may be smaller. The tiles of a raster stand on one
    lattice (``regular_blocking``, with the number of rasters where they don't), fill their hull
    (``gaps``) and no place twice (``overlaps``). ``extent`` is the union of the tile boxes.

    Tiles are counted by place, places by raster, rasters as a whole; nothing is joined, and a large
    raster is pre-aggregated. The common size is looked up first.
    """
    common = tiles.agg(F.max("width"), F.max("height")).first()
    wide, high = (1000 * (side or 1) for side in common)
    det = F.col("scale_x") * F.col("scale_y") - F.col("skew_x") * F.col("skew_y")
    # The tile's corner in its own pixel grid, in thousandths of a pixel.
    col = F.round((F.col("scale_y") * F.col("left") - F.col("skew_x") * F.col("top")) / det * 1000).cast("long")
    row = F.round((F.col("scale_x") * F.col("top") - F.col("skew_y") * F.col("left")) / det * 1000).cast("long")
    placed = tiles.select(*TILE, F.size("bands").alias("num_bands"), col.alias("col"), row.alias("row"))
    agreed = {
        "srid": F.col("srid"), "scale_x": F.col("scale_x"), "scale_y": F.col("scale_y"),
        "skew_x": F.col("skew_x"), "skew_y": F.col("skew_y"), "num_bands": F.col("num_bands"),
        "pixel_type": F.col("pixel_type"), "nodata": F.col("nodata"),
        **{f"alignment{half}_{axis}": _from_grid(side, 1000, half) for axis, side in (("x", "col"), ("y", "row"))
           for half in _HALVES},
    }
    sides = {"xmin": F.min, "ymin": F.min, "xmax": F.max, "ymax": F.max}
    ends = {"col": (wide, "width"), "row": (high, "height")}
    of_place = placed.groupBy("path", "col", "row").agg(
        F.count("*").alias("tiles"), F.min("width").alias("least_width"), F.max("width").alias("width"),
        F.min("height").alias("least_height"), F.max("height").alias("height"),
        *[f(s).alias(s) for s, f in sides.items()],
        *[f(e).alias(f"{k}_{n}") for n, e in agreed.items() for k, f in (
            ("lo", F.min), ("hi", F.max), ("no", lambda e: F.count_if(e.isNull())))])
    of_raster = of_place.groupBy("path").agg(
        F.sum("tiles").alias("tiles"), F.count("*").alias("places"),
        *[f(s).alias(s) for s, f in sides.items()],
        *[f(f"{k}_{n}").alias(f"{k}_{n}") for n in agreed for k, f in (("lo", F.min), ("hi", F.max), ("no", F.sum))],
        *[c for axis, (size, side) in ends.items() for c in (
            F.min(axis).alias(f"first_{axis}"), F.max(F.col(axis) + 1000 * F.col(side)).alias(f"end_{axis}"),
            # The smaller tile that ends first; it must end with the raster.
            F.min(F.when(F.col(f"least_{side}") * 1000 < size, F.col(axis) + 1000 * F.col(f"least_{side}"))).alias(
                f"small_{axis}"),
            *[f(_from_grid(axis, size, half)).alias(f"{end}{half}_{axis}")
              for half in _HALVES for f, end in ((F.min, "from"), (F.max, "to"))])])
    on_lattice = F.lit(True)
    slots = F.lit(1)
    for axis, (size, _) in ends.items():
        on_lattice = on_lattice & _close(*[F.col(f"to{half}_{axis}") - F.col(f"from{half}_{axis}") for half in _HALVES])
        slots = slots * F.ceil((F.col(f"end_{axis}") - F.col(f"first_{axis}") - SLACK) / size)
    small = {side: F.coalesce(F.col(f"small_{axis}") < F.col(f"end_{axis}") - SLACK, F.lit(False))
             for axis, (_, side) in ends.items()}
    one = of_raster.agg(
        *[f(s).alias(s) for s, f in sides.items()],
        *[f(f"{k}_{n}").alias(f"{k}_{n}") for n in agreed for k, f in (("lo", F.min), ("hi", F.max), ("no", F.sum))],
        *[F.count_if(bad).alias(f"small_{side}") for side, bad in small.items()],
        F.count("*").alias("rasters"), F.count_if(~on_lattice).alias("regular_blocking"),
        F.sum(F.when(on_lattice, F.greatest(slots - F.col("places"), F.lit(0))).otherwise(0)).alias("gaps"),
        F.sum(F.col("tiles") - F.col("places")).alias("overlaps"))
    rows = [
        F.struct(
            F.lit(n).alias("name"),
            # Partly NULL disagrees; NULL on every tile agrees on having none.
            F.when(F.col(f"no_{n}") > 0, F.col(f"lo_{n}").isNull()).otherwise(
                F.col(f"lo_{n}") == F.col(f"hi_{n}")).alias("holds"),
            (F.col(f"lo_{n}") if n == "pixel_type" else F.col(f"lo_{n}").cast("double").cast("string")).alias("value"))
        for n in agreed if not n.startswith("alignment")
    ]
    rows += [
        F.struct(
            F.lit(f"alignment_{axis}").alias("name"),
            _close(*[F.col(f"hi_alignment{h}_{axis}") - F.col(f"lo_alignment{h}_{axis}") for h in _HALVES]).alias("holds"),
            (F.col(f"lo_alignment_{axis}") - SLACK // 2).cast("double").cast("string").alias("value"))
        for axis in ("x", "y")
    ]
    rows += [
        F.struct(F.lit(side).alias("name"), (F.col(f"small_{side}") == 0).alias("holds"),
                 F.lit(most).cast("double").cast("string").alias("value"))
        for side, most in zip(("width", "height"), common)
    ]
    rows += [
        F.struct(F.lit(n).alias("name"), (F.coalesce(n, F.lit(0)) == 0).alias("holds"),
                 F.coalesce(n, F.lit(0)).cast("double").cast("string").alias("value"))
        for n in ("regular_blocking", "gaps", "overlaps")
    ]
    box = [F.col(c).cast("double").cast("string") for c in ("xmin", "ymin", "xmax", "ymax")]
    rows.append(F.struct(F.lit("extent").alias("name"), F.lit(True).alias("holds"), F.concat_ws(" ", *box).alias("value")))
    return one.where("rasters > 0").select(F.inline(F.array(*rows)))


# Distances from a grid are also taken from its middle: one of the two is far from where they jump.
_HALVES = {"": 0, "_half": 1}


def _from_grid(axis: str, size: int, half: str) -> Column:
    return F.pmod(F.col(axis) + SLACK // 2 + _HALVES[half] * size // 2, F.lit(size))


def _close(*ranges: Column) -> Column:
    """Whether places are at one distance from a grid, but for rounding."""
    return F.least(*ranges) <= SLACK


def require_raster_constraints(tiles: DataFrame) -> None:
    """Raise when the tiles do not form one regular coverage."""
    broken = [row["name"] for row in raster_constraints(tiles).collect() if not row["holds"]]
    if broken:
        raise ConstraintViolation(f"raster constraints broken: {broken}")
