"""Numeric column expressions: units, sentinels, steps, distances, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors of the unit pairs that are shown.
FACTORS = {("km", "mi"): 0.621371, ("m", "ft"): 3.28084, ("km2", "mi2"): 0.386102, ("m/km", "ft/mi"): 5.28, ("pct", "share"): 0.01}
EARTH_M = 6371008.8
#: The equal-area conic for South America (degrees), and its sphere's ellipsoid.
ALBERS = {"lat1": -5.0, "lat2": -42.0, "lat0": -32.0, "lon0": -60.0, "a": 6378160.0, "e2": 0.006694541854587638}


def convert(x: Column, unit: str, to: str) -> Column:
    return x * F.lit(FACTORS[unit, to])


def sentinel_null(x: Column, *values: float) -> Column:
    """Null for 0, -999 (or the values given) and what is not finite."""
    bad = values or (0, -999)
    return F.when(~x.isin(*bad) & ~F.isnan(x.cast("double")), x)


def steps(x: Column, cuts: list[tuple[float, object]], last) -> Column:
    """A step function: the value of the first cut that x lies under."""
    out = None
    for at, value in cuts:
        out = F.when(x < at, F.lit(value)) if out is None else out.when(x < at, F.lit(value))
    return F.when(x.isNull(), F.lit(None)).otherwise(out.otherwise(F.lit(last)))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def local_xy(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin on a local plane."""
    k = math.pi / 180 * EARTH_M
    return (lon - lon0) * (k * math.cos(math.radians(lat0))), (lat - lat0) * k


def mercator(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """World tile coordinates (fractions of tiles) at a zoom."""
    n = float(1 << zoom)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n


def _q(phi: Column | float, e: float):
    sin = F.sin(phi) if isinstance(phi, Column) else math.sin(phi)
    log = F.log((1 - e * sin) / (1 + e * sin)) if isinstance(phi, Column) else math.log((1 - e * sin) / (1 + e * sin))
    return (1 - e * e) * (sin / (1 - e * e * sin * sin) - log / (2 * e))


def albers(lon: Column, lat: Column, p: dict = ALBERS) -> tuple[Column, Column]:
    """Equal-area conic x, y in metres."""
    e = math.sqrt(p["e2"])
    one, two, zero = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    m1, m2 = (math.cos(x) / math.sqrt(1 - p["e2"] * math.sin(x) ** 2) for x in (one, two))
    n = (m1 * m1 - m2 * m2) / (_q(two, e) - _q(one, e))
    c = m1 * m1 + n * _q(one, e)
    rho0 = p["a"] * math.sqrt(c - n * _q(zero, e)) / n
    rho = p["a"] * F.sqrt(c - n * _q(F.radians(lat), e)) / n
    theta = n * F.radians(lon - p["lon0"])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)
