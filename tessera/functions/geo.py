"""Expressions on places: distances, bearings, map projections, grids, polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

R_KM = 6371.0
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * R_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, for places near each other."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return R_KM * F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    deg = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return (deg + 360.0) % 360.0


def destination(lat: Column, lon: Column, bearing_deg: Column, km: Column) -> tuple[Column, Column]:
    a, b, d = F.radians(lat), F.radians(bearing_deg), km / R_KM
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b))
    east = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), F.degrees(east)


def compass(deg: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in COMPASS]), (F.floor(deg / 22.5 + 0.5) % 16 + 1).cast("int"))


def utm_to_lonlat(east: Column, north: Column, zone: int = 30) -> tuple[Column, Column]:
    """Northern-hemisphere UTM (GRS 80) to (lon, lat), by the usual series in the third flattening's powers, to the sixth order."""
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    e2 = f * (2 - f)
    ep2, e1 = e2 / (1 - e2), (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = north / (k0 * a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    p = mu + (1.5 * e1 - 27 / 32 * e1**3) * F.sin(2 * mu) + (21 / 16 * e1**2 - 55 / 32 * e1**4) * F.sin(4 * mu) + 151 / 96 * e1**3 * F.sin(6 * mu) + 1097 / 512 * e1**4 * F.sin(8 * mu)
    s, c, t = F.sin(p), F.cos(p), F.pow(F.tan(p), F.lit(2.0))
    cc = ep2 * c * c
    n = a / F.sqrt(1 - e2 * s * s)
    r = a * (1 - e2) / F.pow(1 - e2 * s * s, F.lit(1.5))
    d = (east - 500000.0) / (n * k0)
    lat = p - n * F.tan(p) / r * (d * d / 2 - (5 + 3 * t + 10 * cc - 4 * cc * cc - 9 * ep2) * F.pow(d, F.lit(4.0)) / 24 + (61 + 90 * t + 298 * cc + 45 * t * t - 252 * ep2 - 3 * cc * cc) * F.pow(d, F.lit(6.0)) / 720)
    lon = (d - (1 + 2 * t + cc) * F.pow(d, F.lit(3.0)) / 6 + (5 - 2 * cc + 28 * t - 3 * cc * cc + 8 * ep2 + 24 * t * t) * F.pow(d, F.lit(5.0)) / 120) / c
    return F.degrees(lon) + (zone * 6 - 183), F.degrees(lat)


def equal_area(lat: Column, lon: Column, lat0: float = 52.0, lon0: float = 10.0, east0: float = 0.0, north0: float = 0.0) -> tuple[Column, Column]:
    """Ellipsoidal Lambert azimuthal equal-area projection (GRS 80) to metres, the centre being at (east0, north0)."""
    a, f = 6378137.0, 1 / 298.257222101
    e2 = f * (2 - f)
    e = math.sqrt(e2)

    def authalic(s):  # of a column or a number
        lib = F if isinstance(s, Column) else math
        return (1 - e2) * (s / (1 - e2 * s * s) - lib.log((1 - e * s) / (1 + e * s)) / (2 * e))

    qp, s0 = authalic(1.0), math.sin(math.radians(lat0))
    b0 = math.asin(authalic(s0) / qp)
    rq = a * math.sqrt(qp / 2)
    d0 = a * math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * s0 * s0) / (rq * math.cos(b0))
    b, dl = F.asin(authalic(F.sin(F.radians(lat))) / qp), F.radians(lon - lon0)
    k = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(dl)))
    return east0 + k * d0 * F.cos(b) * F.sin(dl), north0 + k / d0 * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(dl))


def cell_index(lat: Column, lon: Column, lat0: float, lon0: float, step: float, ny: int, nx: int) -> Column:
    """Flat index of the cell, or null outside the grid."""
    j, i = F.floor((lat - lat0) / step), F.floor((lon - lon0) / step)
    return F.when((j >= 0) & (j < ny) & (i >= 0) & (i < nx), j * nx + i)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule on a closed ring: array of struct(x, y)."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    crossed = F.filter(pairs, lambda p: ((p["a"]["y"] > y) != (p["b"]["y"] > y)) & (x < (p["b"]["x"] - p["a"]["x"]) * (y - p["a"]["y"]) / (p["b"]["y"] - p["a"]["y"]) + p["a"]["x"]))
    return F.size(crossed) % 2 == 1


def near_ring(x: Column, y: Column, ring: Column, margin: float = 1e-9) -> Column:
    """Whether a point is so near the closed ring that rounding may decide `in_ring`."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def close(p: Column) -> Column:
        dx, dy = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]
        along = F.coalesce(F.least(F.greatest(((x - p["a"]["x"]) * dx + (y - p["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
        return F.hypot(x - p["a"]["x"] - along * dx, y - p["a"]["y"] - along * dy) <= margin

    return F.exists(pairs, close)


def in_open_ring(x: Column, y: Column, ring: Column, sides: Column, margin: float = 1e-9) -> Column:
    """Whether a convex closed ring holds the point in its interior: no point of an edge is inside. Beside an edge, where the ring's
    rounded corners could not tell, the sides decide: array of struct(a, b, c), each a half-plane a x + b y > c."""
    return F.when(near_ring(x, y, ring, margin), F.forall(sides, lambda s: s["a"] * x + s["b"] * y > s["c"])).otherwise(in_ring(x, y, ring))
