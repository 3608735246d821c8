"""Which coordinate system a loaded geometry column ends up in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landspan.functions import geometry as geo


def parse_epsg(option: int | str | None) -> tuple[int | None, int | None]:
    """(source, target) of an ``epsg`` option: None, ``n``, ``"n"`` or ``"a:b"``."""
    if option is None:
        return None, None
    codes = str(option).split(":")
    if isinstance(option, (int, str)) and len(codes) <= 2:
        source = int(codes[0]) if len(codes) == 2 else None
        return source, int(codes[-1])
    raise ValueError(f"cannot read {option!r} as one code or as two codes around a colon")


def apply_epsg(
    df: DataFrame, column: str, option: int | str | None, points_only: bool = False
) -> DataFrame:
    """Apply an ``epsg`` option to a geometry column.

    No option leaves the column alone.  A single code is the target: rows that declare
    another SRID are transformed, rows that declare none are assigned it.  ``a:b``
    converts from a to b, and a row that declares something other than a is an error.
    """
    source, target = parse_epsg(option)
    if target is None:
        return df
    if source is None:
        return geo.reproject(df, column, target, points_only=points_only)
    srid = F.coalesce(F.col(column)["srid"], F.lit(0))
    wrong = F.concat(F.lit(f"{column} declares SRID "), srid, F.lit(f", not {source}"))
    checked = F.when(~srid.isin(0, source), F.raise_error(wrong).cast(geo.GEOMETRY))
    df = df.withColumn(column, checked.otherwise(F.col(column)))
    if source == target:
        return geo.set_srid(df, column, target)
    return geo.reproject(df, column, target, source, points_only)
