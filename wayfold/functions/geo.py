"""Geometry as column expressions: distances, local planes, projections, map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres: the sphere's radius, and a degree of latitude in the local plane.
EARTH_RADIUS_M, DEGREE_M = 6371000.0, 111320.0


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """metres along the sphere; null if any coordinate is."""
    lat1, lon1, lat2, lon2 = map(_lit, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    # least() skips nulls, which a distance must not.
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)))))


def to_plane(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """east and north in metres of a point in the plane around (lat0, lon0)."""
    lat, lon, lat0, lon0 = map(_lit, (lat, lon, lat0, lon0))
    return (lon - lon0) * DEGREE_M * F.cos(F.radians(lat0)), (lat - lat0) * DEGREE_M


def from_plane(x, y, lat0, lon0) -> tuple[Column, Column]:
    """F2, back: latitude and longitude."""
    x, y, lat0, lon0 = map(_lit, (x, y, lat0, lon0))
    return lat0 + y / DEGREE_M, lon0 + x / (DEGREE_M * F.cos(F.radians(lat0)))


def project_on_segment(px, py, ax, ay, bx, by) -> dict[str, Column]:
    """the nearest point of segment ab: fraction, x, y, distance, and offset from a."""
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square <= 1e-12, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / square)
    t = F.when(t < 0, F.lit(0.0)).when(t > 1, F.lit(1.0)).otherwise(t)
    x, y = ax + t * dx, ay + t * dy
    return {"fraction": t, "x": x, "y": y, "distance": F.sqrt((px - x) * (px - x) + (py - y) * (py - y)), "offset": t * F.sqrt(square)}


def web_mercator(lat, lon) -> tuple[Column, Column]:
    """EPSG:3857 east and north."""
    r = 6378137.0
    lat, lon = _lit(lat), _lit(lon)
    return r * F.radians(lon), r * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def utm(lat, lon, zone: int = 33) -> tuple[Column, Column]:
    """WGS 84 / UTM (north) east and north by the Krueger series of third order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    mean = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    lat, lon = _lit(lat), _lit(lon)
    s, d = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183))
    atanh = lambda x: F.log((1 + x) / (1 - x)) / 2
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + k0 * mean * east, k0 * mean * north


def clamp(x, low, high) -> Column:
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def box_distance(lat, lon, south, west, north, east) -> Column:
    """F32: metres from a point to the nearest point of a box."""
    lat, lon = _lit(lat), _lit(lon)
    return haversine(lat, lon, clamp(lat, south, north), clamp(lon, west, east))


def from_web_mercator(x, y) -> tuple[Column, Column]:
    """F34, back: latitude and longitude of EPSG:3857."""
    r = 6378137.0
    return F.degrees(2 * F.atan(F.exp(_lit(y) / r)) - math.pi / 2), F.degrees(_lit(x) / r)


def from_utm(x, y, zone: int = 33) -> tuple[Column, Column]:
    """F34, back: latitude and longitude of WGS 84 / UTM (north), by the Krueger series of third order."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    mean = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = _lit(y) / (k0 * mean), (_lit(x) - 500000.0) / (k0 * mean)
    north, east = xi, eta
    for j, c in enumerate(beta, 1):
        north = north - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(lat), F.lit(float(6 * zone - 183)) + F.degrees(F.atan2(F.sinh(east), F.cos(north)))


#: Reference systems that coordinates may be in, and what makes them latitude and longitude.
SYSTEMS = {32633: lambda x, y: from_utm(x, y, 33), 25833: lambda x, y: from_utm(x, y, 33), 32632: lambda x, y: from_utm(x, y, 32), 25832: lambda x, y: from_utm(x, y, 32), 3857: from_web_mercator}


def tile_zoom(south, west, north, east, pixels: float, bias: int = 0) -> Column:
    """the zoom of map tiles at which a box takes ``pixels``, of 1 to 19; null for a box of no size."""
    (x0, y0), (x1, y1) = web_mercator(south, west), web_mercator(north, east)
    span = F.greatest(x1 - x0, y1 - y0)
    per_pixel = 156543.03392804097 * F.cos(F.radians((_lit(south) + _lit(north)) / 2))
    zoom = F.floor(F.log2(per_pixel * float(pixels) / span)) + bias
    return F.when((span > 0) & (per_pixel > 0), F.least(F.lit(19), F.greatest(F.lit(1), zoom.cast("int"))))
