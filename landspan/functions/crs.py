"""Coordinate reference systems covered in closed form.

Codes: 4326 (longitude/latitude), 3857 (spherical Mercator), 2193 (Transverse
Mercator on GRS80) and 326zz / 327zz (UTM north / south on WGS84).  Every other
code raises.  Two projected systems meet through longitude/latitude; datum
shifts are out of scope (the WGS84 and GRS80 frames are taken as equal).

Each formula is written once over a small set of math functions, so it runs both
as a Catalyst expression (points, inside whole-stage codegen) and on whole numpy
coordinate buffers (any kind, one call per Arrow batch).
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ellipsoids as (semi-major axis in metres, inverse flattening).
WGS84 = (6378137.0, 298.257223563)
GRS80 = (6378137.0, 298.257222101)
# Fixed value: latitude where the square Mercator map ends, in degrees.
MERCATOR_MAX_LAT = 85.051128779806604
# EPSG codes with their own formula.
LONLAT = 4326
MERCATOR = 3857
NZTM = 2193

_ARRAYS = SimpleNamespace(
    sin=np.sin, cos=np.cos, sinh=np.sinh, cosh=np.cosh, tanh=np.tanh, asin=np.arcsin,
    atanh=np.arctanh, atan2=np.arctan2, sqrt=np.sqrt, radians=np.radians, degrees=np.degrees,
    where=np.where, let=lambda *values: values,
)


class _Stages:
    """The same functions on columns; ``let`` computes values once, in a projection."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.names: list[str] = []

    def __getattr__(self, name: str):
        return getattr(F, name)

    def where(self, test, yes, no) -> Column:
        return F.when(test, yes).otherwise(no)

    def let(self, *values: Column) -> tuple[Column, ...]:
        new = [f"__crs{len(self.names) + i}" for i in range(len(values))]
        self.df = self.df.withColumns(dict(zip(new, values)))
        self.names += new
        return tuple(F.col(name) for name in new)


def _series(ellipsoid: tuple[float, float]) -> dict:
    """Krueger series to the fourth order in the third flattening n."""
    a, inv_f = ellipsoid
    f = 1.0 / inv_f
    n = f / (2.0 - f)
    return {
        "ecc": (f * (2.0 - f)) ** 0.5,
        "radius": a / (1 + n) * (1 + n**2 / 4 + n**4 / 64),
        "forward": [
            n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4,
            13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4,
            61 / 240 * n**3 - 103 / 140 * n**4,
            49561 / 161280 * n**4,
        ],
        "inverse": [
            n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4,
            17 / 480 * n**3 - 37 / 840 * n**4,
            4397 / 161280 * n**4,
        ],
        "latitude": [
            2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4,
            7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4,
            56 / 15 * n**3 - 136 / 35 * n**4,
            4279 / 630 * n**4,
        ],
    }


def _zone(epsg: int) -> SimpleNamespace:
    """Transverse Mercator parameters of one code."""
    if epsg == NZTM:
        place = (173.0, 1_600_000.0, 10_000_000.0)
    elif 32601 <= epsg <= 32660:
        place = ((epsg - 32600) * 6 - 183.0, 500_000.0, 0.0)
    elif 32701 <= epsg <= 32760:
        place = ((epsg - 32700) * 6 - 183.0, 500_000.0, 10_000_000.0)
    else:
        raise ValueError(f"no closed-form projection for EPSG:{epsg}")
    lon0, east, north = place
    return SimpleNamespace(
        lon0=lon0, k0=0.9996, east=east, north=north,
        **_series(GRS80 if epsg == NZTM else WGS84),
    )


def _zone_of_row(stages: _Stages, epsg: Column, known: list[int]) -> SimpleNamespace:
    """The same parameters when every row names its own code (or one of ``known``)."""
    grs, wgs = _series(GRS80), _series(WGS84)
    is_grs = epsg == NZTM
    is_north = epsg.between(32601, 32660)
    is_south = epsg.between(32701, 32760)
    unknown = F.raise_error(
        F.concat(F.lit("no closed-form projection for EPSG:"), epsg.cast("string"))
    ).cast("double")
    lon0 = (
        F.when(is_grs, F.lit(173.0))
        .when(is_north | is_south, (epsg % 100) * 6 - F.lit(183.0))
        .when(epsg.isNull() | epsg.isin(known), F.lit(0.0))
        .otherwise(unknown)
    )

    def pick(a: float, b: float) -> Column:
        return F.when(is_grs, F.lit(a)).otherwise(F.lit(b))

    series = ("inverse", "latitude")
    values = [
        lon0, pick(1_600_000.0, 500_000.0),
        F.when(is_north, F.lit(0.0)).otherwise(F.lit(10_000_000.0)),
        pick(grs["radius"], wgs["radius"]),
        *[pick(a, b) for name in series for a, b in zip(grs[name], wgs[name])],
    ]
    lon0, east, north, radius, *terms = stages.let(*values)
    return SimpleNamespace(
        lon0=lon0, k0=0.9996, east=east, north=north, radius=radius,
        inverse=terms[:4], latitude=terms[4:],
    )


def check_supported(epsg: int) -> int:
    """The code itself; raises when no formula covers it."""
    if epsg not in (LONLAT, MERCATOR):
        _zone(epsg)
    return epsg


def _mercator_from_lonlat(m, x, y):
    r = WGS84[0]
    inside = (y >= -MERCATOR_MAX_LAT) & (y <= MERCATOR_MAX_LAT)
    return (
        m.where(inside, m.radians(x) * r, float("nan")),
        m.where(inside, m.atanh(m.sin(m.radians(y))) * r, float("nan")),
    )


def _mercator_to_lonlat(m, x, y):
    r = WGS84[0]
    return m.degrees(x / r), m.degrees(m.asin(m.tanh(y / r)))


def _zone_from_lonlat(m, x, y, z):
    sin_lat, lam = m.let(m.sin(m.radians(y)), m.radians(x - z.lon0))
    (t,) = m.let(m.sinh(m.atanh(sin_lat) - m.atanh(sin_lat * z.ecc) * z.ecc))
    xi, eta = m.let(m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(t * t + 1.0)))
    north, east = xi, eta
    for j, c in enumerate(z.forward, start=1):
        north = north + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * c
        east = east + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * c
    return east * z.radius * z.k0 + z.east, north * z.radius * z.k0 + z.north


def _zone_to_lonlat(m, x, y, z):
    north, east = m.let((y - z.north) / (z.radius * z.k0), (x - z.east) / (z.radius * z.k0))
    xi, eta = north, east
    for j, c in enumerate(z.inverse, start=1):
        xi = xi - m.sin(north * (2 * j)) * m.cosh(east * (2 * j)) * c
        eta = eta - m.cos(north * (2 * j)) * m.sinh(east * (2 * j)) * c
    xi, eta = m.let(xi, eta)
    (chi,) = m.let(m.asin(m.sin(xi) / m.cosh(eta)))
    lat = chi
    for j, c in enumerate(z.latitude, start=1):
        lat = lat + m.sin(chi * (2 * j)) * c
    return m.degrees(m.atan2(m.sinh(eta), m.cos(xi))) + z.lon0, m.degrees(lat)


def _from_lonlat(m, x, y, epsg: int):
    if epsg == LONLAT:
        return x, y
    if epsg == MERCATOR:
        return _mercator_from_lonlat(m, x, y)
    return _zone_from_lonlat(m, x, y, _zone(epsg))


def _to_lonlat(m, x, y, epsg: int):
    if epsg == LONLAT:
        return x, y
    if epsg == MERCATOR:
        return _mercator_to_lonlat(m, x, y)
    return _zone_to_lonlat(m, x, y, _zone(epsg))


def project_arrays(x: np.ndarray, y: np.ndarray, source: int, target: int):
    """Coordinates of ``source`` expressed in ``target``; NaN where undefined."""
    if source == target:
        return x, y
    with np.errstate(all="ignore"):
        return _from_lonlat(_ARRAYS, *_to_lonlat(_ARRAYS, x, y, source), target)


def project_columns(
    df: DataFrame, x: str, y: str, source: int | Column, target: int
) -> DataFrame:
    """Same on two DOUBLE columns, in place; ``source`` may be a column of codes."""
    m = _Stages(df)
    px, py = F.col(x), F.col(y)
    if isinstance(source, int):
        if source == target:
            return df
        lon, lat = m.let(*_to_lonlat(m, px, py, source))
        px, py = _from_lonlat(m, lon, lat, target)
    else:
        (code,) = m.let(source)
        mx, my = _mercator_to_lonlat(m, px, py)
        zx, zy = _zone_to_lonlat(m, px, py, _zone_of_row(m, code, [LONLAT, MERCATOR, target]))
        lon, lat = m.let(
            F.when(code == LONLAT, px).when(code == MERCATOR, mx).otherwise(zx),
            F.when(code == LONLAT, py).when(code == MERCATOR, my).otherwise(zy),
        )
        tx, ty = _from_lonlat(m, lon, lat, target)
        px, py = (F.when(code == target, a).otherwise(b) for a, b in ((px, tx), (py, ty)))
    return m.df.withColumns({x: px, y: py}).drop(*m.names)
