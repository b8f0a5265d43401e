"""Distances on the sphere as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Kilometres in a degree of latitude.
DEGREE_KM = 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points given in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return 2 * F.lit(EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.atan2(math.sqrt(a), math.sqrt(max(0.0, 1 - a)))


def planar2(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    """Squared distance in degrees, without a correction for latitude."""
    return (lat - at_lat) * (lat - at_lat) + (lon - at_lon) * (lon - at_lon)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def box_around(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) that holds a circle."""
    dlat = km / DEGREE_KM
    dlon = km / (DEGREE_KM * max(1e-9, math.cos(math.radians(lat))))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def cell3(lat: Column, lon: Column, metres: float) -> Column:
    """Cell of a cubic grid through the sphere: (x, y, z)."""
    p, q = F.radians(lat), F.radians(lon)
    r = EARTH_M / metres
    return F.struct(F.floor(F.cos(p) * F.cos(q) * r).alias("x"), F.floor(F.cos(p) * F.sin(q) * r).alias("y"), F.floor(F.sin(p) * r).alias("z"))
