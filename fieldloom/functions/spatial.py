"""Grid cells, distances and an equal-area projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
#: Semi-major axis and flattening of WGS 84 (fixed values).
A_M, FLATTENING = 6_378_137.0, 1 / 298.257223563


def cell_index(lon: Column, lat: Column, per_degree: int, west: float = -180.0, south: float = -90.0) -> tuple[Column, Column]:
    """Column and row of the lattice cell that holds a point; west and south edges belong to the cell."""
    return F.floor((lon - west) * per_degree).cast("int"), F.floor((lat - south) * per_degree).cast("int")


def center(lon_index: Column, lat_index: Column, per_degree: int, west: float = -180.0, south: float = -90.0) -> tuple[Column, Column]:
    """Center of a cell; NULL where the index is off the globe."""
    lon, lat = west + (lon_index + 0.5) / per_degree, south + (lat_index + 0.5) / per_degree
    inside = lon_index.between(0, 360 * per_degree - 1) & lat_index.between(0, 180 * per_degree - 1)
    return F.when(inside, lon), F.when(inside, lat)


def center_index(lon: Column, lat: Column, per_degree: int, tolerance: float = 1e-4, west: float = -180.0, south: float = -90.0) -> tuple[Column, Column]:
    """Index of the cell that a point is the center of, within a tolerance in degrees; else NULL."""
    i, j = F.rint((lon - west) * per_degree - 0.5), F.rint((lat - south) * per_degree - 0.5)
    close = (F.abs(west + (i + 0.5) / per_degree - lon) <= tolerance) & (F.abs(south + (j + 0.5) / per_degree - lat) <= tolerance)
    return F.when(close, i.cast("int")), F.when(close, j.cast("int"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in meters."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a point is in a box, edges included; a box never wraps around."""
    return lon.between(west, east) & lat.between(south, north)


def equal_area(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Easting and northing of the ellipsoidal Lambert azimuthal equal-area projection; NULL at the antipode."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    s0 = math.sin(math.radians(lat0))
    qp = q_of(1.0)
    beta0 = math.asin(q_of(s0) / qp)
    rq = A_M * math.sqrt(qp / 2)
    m0 = math.cos(math.radians(lat0)) / math.sqrt(1 - e2 * s0 * s0)
    d = A_M * m0 / (rq * math.cos(beta0))
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    beta, lam = F.asin(F.greatest(F.least(q / qp, F.lit(1.0)), F.lit(-1.0))), F.radians(lon - lon0)
    below = 1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(lam)
    b = F.when(below > 1e-12, rq * F.sqrt(2 / below))
    return b * d * F.cos(beta) * F.sin(lam), (b / d) * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(lam))


def distortion(lon: Column, lat: Column, lon0: float, lat0: float, step: float = 1e-4) -> dict[str, Column]:
    """Local distortion of ``equal_area`` from central differences over ``step`` degrees.

    Extreme linear scales (``semimajor``, ``semiminor``), their product ``areal_scale``, the largest change of an angle
    (``angular``, degrees), and ``convergence``: the counter-clockwise turn of projected north, in degrees.
    """
    e2 = FLATTENING * (2 - FLATTENING)
    (east_x, east_y), (west_x, west_y) = (equal_area(lon + s, lat, lon0, lat0) for s in (step, -step))
    (north_x, north_y), (south_x, south_y) = (equal_area(lon, lat + s, lon0, lat0) for s in (step, -step))
    width = 2 * math.radians(step)
    xl, yl, xp, yp = (east_x - west_x) / width, (east_y - west_y) / width, (north_x - south_x) / width, (north_y - south_y) / width
    w = 1 - e2 * F.pow(F.sin(F.radians(lat)), 2)
    meridian, parallel = A_M * (1 - e2) / F.pow(w, 1.5), A_M * F.cos(F.radians(lat)) / F.sqrt(w)
    h2, k2 = (xp * xp + yp * yp) / (meridian * meridian), (xl * xl + yl * yl) / (parallel * parallel)
    area = (yp * xl - xp * yl) / (meridian * parallel)
    both, apart = F.sqrt(F.greatest(h2 + k2 + 2 * area, F.lit(0.0))), F.sqrt(F.greatest(h2 + k2 - 2 * area, F.lit(0.0)))
    return {
        "semimajor": (both + apart) / 2, "semiminor": (both - apart) / 2, "areal_scale": area,
        "angular": F.degrees(2 * F.asin(F.least(apart / both, F.lit(1.0)))), "convergence": -F.degrees(F.atan2(xp, yp)),
    }


def areal_scale(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Area distortion of ``equal_area``."""
    return distortion(lon, lat, lon0, lat0)["areal_scale"]


def solar_toa(us: Column, lon: Column, lat: Column, constant: float = 1361.0) -> Column:
    """Potential shortwave radiation at the top of the atmosphere (W m-2) at a UTC time in microseconds, by Spencer's series."""
    at = F.timestamp_micros(us)
    hour = F.pmod(us, F.lit(86_400_000_000)) / 3.6e9
    g = 2 * math.pi * (F.dayofyear(at) - 1 + (hour - 12) / 24) / 365
    # coefficients of the published series (fixed values)
    declination = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    distance = 1.00011 + 0.034221 * F.cos(g) + 0.00128 * F.sin(g) + 0.000719 * F.cos(2 * g) + 0.000077 * F.sin(2 * g)
    angle = F.radians((hour * 60 + equation + 4 * lon) / 4 - 180)
    height = F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(angle)
    return constant * distance * F.greatest(height, F.lit(0.0))


def angular_distance(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Degrees of arc from a center, by the spherical law of cosines."""
    cosine = F.sin(F.radians(lat)) * math.sin(math.radians(lat0)) + F.cos(F.radians(lat)) * math.cos(math.radians(lat0)) * F.cos(F.radians(lon - lon0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
