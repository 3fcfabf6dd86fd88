"""Longitude/latitude to UTM as column arithmetic (Krueger's series, WGS84)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the UTM projection.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; the 180th meridian belongs to the last."""
    return F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60)).cast("int")


def to_utm(lon: Column, lat: Column) -> dict[str, Column]:
    """Columns `zone`, `easting`, `northing` for a WGS84 position."""
    zone = utm_zone(lon)
    phi = F.radians(lat)
    dlam = F.radians(lon - (zone * 6 - 183))
    ecc = 2 * math.sqrt(_N) / (1 + _N)
    sin_phi = F.sin(phi)
    t = F.sinh(F.atanh(sin_phi) - F.lit(ecc) * F.atanh(sin_phi * ecc))
    xi = F.atan(t / F.cos(dlam))
    eta = F.atanh(F.sin(dlam) / F.sqrt(t * t + 1.0))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    k = SCALE * _RADIUS
    base = F.when(lat < 0, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))
    return {"zone": zone, "easting": east * k + FALSE_EASTING, "northing": north * k + base}
