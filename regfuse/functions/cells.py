"""Space-filling-curve cells of the globe (Morton order) and great-circle distance, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Bits a coordinate of a full cell code has: cells of about 0.15 m by 0.3 m at the equator.
BITS = 26


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius_km: float = EARTH_KM) -> Column:
    """Great-circle distance on a sphere; null if any coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius_km * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def grid(c: Column, low: float, span: float, bits: int) -> Column:
    """The number of the cell of a coordinate among 2**bits equal ones from ``low`` on."""
    n = 1 << bits
    return F.least(F.greatest(F.floor((c - low) / span * n), F.lit(0)), F.lit(n - 1)).cast("bigint")


def _spread(c: Column) -> Column:
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
    return c


def morton(x: Column, y: Column) -> Column:
    """The Morton code of two cell numbers below 2**31."""
    return _spread(x.cast("bigint")).bitwiseOR(F.shiftleft(_spread(y.cast("bigint")), 1))


def point_code(lat: Column, lon: Column) -> Column:
    """The full cell code of a position; longitudes are taken modulo 360."""
    x = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return morton(grid(x, -180.0, 360.0, BITS), grid(lat, -90.0, 180.0, BITS))
