"""Coordinate systems: which are planar, and reprojection by closed formulas, as column expressions.

Known by their EPSG numbers: 4326 (degrees), 3857 (web Mercator), 326zz and 327zz (UTM zone zz, north and south, by the series in
the third flattening up to its third power, good to under a millimetre in a zone), 2056 and 21781 (Swiss, by the survey's
approximation formulas, good to about a metre in Switzerland). Others raise NotImplementedError."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WGS84 = 4326
#: The ellipsoid, and the scale and false easting of UTM.
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * SCALE
_TO = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = 2 * math.sqrt(_N) / (1 + _N)


def is_known(crs: int) -> bool:
    return crs in (WGS84, 3857, 2056, 21781) or crs // 100 in (326, 327) and 1 <= crs % 100 <= 60


def is_planar(crs: int | None) -> bool:
    """Whether coordinates are metres in a plane. Without a coordinate system they count as degrees, with a warning."""
    if crs is None:
        warnings.warn("the coordinate system isn't defined; degrees are assumed", stacklevel=2)
        return False
    if not is_known(crs):
        raise NotImplementedError(f"EPSG:{crs}")
    return crs != WGS84


def _zone(crs: int) -> tuple[float, float]:
    """Central meridian in radians, and false northing."""
    return math.radians(crs % 100 * 6 - 183), 0.0 if crs // 100 == 326 else 10_000_000.0


def from_degrees(lon: Column, lat: Column, crs: int) -> tuple[Column, Column]:
    if crs == 3857:
        return F.radians(lon) * AXIS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * AXIS
    if crs in (2056, 21781):
        p, q = (lat * 3600 - 169028.66) / 10000, (lon * 3600 - 26782.5) / 10000
        e = q * 211455.93 - q * p * 10938.51 - q * p * p * 0.36 - q * q * q * 44.54
        n = p * 308807.95 + q * q * 3745.25 + p * p * 76.63 - q * q * p * 194.56 + p * p * p * 119.79
        return (e + 2600072.37, n + 1200147.07) if crs == 2056 else (e + 600072.37, n + 200147.07)
    meridian, northing = _zone(crs)
    s, d = F.sin(F.radians(lat)), F.radians(lon) - meridian
    t = F.sinh(F.atanh(s) - F.atanh(s * _E) * _E)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(t * t + 1))
    x = eta + sum((F.cos(xi * 2 * k) * F.sinh(eta * 2 * k) * a for k, a in enumerate(_TO, 1)), F.lit(0.0))
    y = xi + sum((F.sin(xi * 2 * k) * F.cosh(eta * 2 * k) * a for k, a in enumerate(_TO, 1)), F.lit(0.0))
    return x * _RADIUS + EASTING, y * _RADIUS + northing


def to_degrees(x: Column, y: Column, crs: int) -> tuple[Column, Column]:
    if crs == 3857:
        return F.degrees(x / AXIS), F.degrees(F.atan(F.exp(y / AXIS)) * 2 - math.pi / 2)
    if crs in (2056, 21781):
        e, n = ((x - 2600000) / 1e6, (y - 1200000) / 1e6) if crs == 2056 else ((x - 600000) / 1e6, (y - 200000) / 1e6)
        lon = e * 4.728982 + e * n * 0.791484 + e * n * n * 0.1306 - e * e * e * 0.0436 + 2.6779094
        lat = n * 3.238272 - e * e * 0.270978 - n * n * 0.002528 - e * e * n * 0.0447 - n * n * n * 0.0140 + 16.9023892
        return lon * 100 / 36, lat * 100 / 36
    meridian, northing = _zone(crs)
    xi, eta = (y - northing) / _RADIUS, (x - EASTING) / _RADIUS
    a = xi - sum((F.sin(xi * 2 * k) * F.cosh(eta * 2 * k) * b for k, b in enumerate(_BACK, 1)), F.lit(0.0))
    c = eta - sum((F.cos(xi * 2 * k) * F.sinh(eta * 2 * k) * b for k, b in enumerate(_BACK, 1)), F.lit(0.0))
    chi = F.asin(F.sin(a) / F.cosh(c))
    lat = chi + sum((F.sin(chi * 2 * k) * b for k, b in enumerate(_LATITUDE, 1)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(c), F.cos(a)) + meridian), F.degrees(lat)


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates of one system in another, by way of degrees."""
    for crs in (source, target):
        if not is_known(crs):
            raise NotImplementedError(f"EPSG:{crs}")
    if source == target:
        return x, y
    lon, lat = (x, y) if source == WGS84 else to_degrees(x, y, source)
    return (lon, lat) if target == WGS84 else from_degrees(lon, lat, target)


def _is_point(kind: str) -> bool:
    return kind.replace("`", "") == "struct<x:double,y:double>"


def to_crs(df: DataFrame, source: int, target: int) -> DataFrame:
    """df with its coordinates in another system: columns lon and lat, and all columns that are points or lines of points."""
    if source == target:
        return df
    point = lambda p: F.struct(*(c.alias(n) for c, n in zip(reproject(p["x"], p["y"], source, target), "xy", strict=True)))
    new = {}
    if {"lon", "lat"} <= set(df.columns):
        new["lon"], new["lat"] = reproject(F.col("lon"), F.col("lat"), source, target)
    for name, kind in df.dtypes:
        if _is_point(kind):
            new[name] = F.when(F.col(name).isNotNull(), point(F.col(name)))
        elif kind.startswith("array<") and _is_point(kind[6:-1]):
            new[name] = F.transform(name, point)
    return df.withColumns(new)
