"""Rounding and geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def plane_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the plane that touches half-way between the latitudes."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.lit(EARTH_M) * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def flat_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lon_m: float = 72_000.0, lat_m: float = 111_320.0) -> Column:
    """Metres with constant lengths of a degree, for one city."""
    return F.sqrt(F.pow((lat2 - lat1) * lat_m, 2) + F.pow((lon2 - lon1) * lon_m, 2))


def coarsened(x: Column) -> Column:
    """Three decimals, never minus zero."""
    return F.round(x, 3) + F.lit(0.0)


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def is_geo_point(lat: Column, lon: Column) -> Column:
    fine = lambda x, most: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most)
    return F.coalesce(fine(lat, 90) & fine(lon, 180), F.lit(False))


def walk_minutes(metres: Column) -> Column:
    """Minutes on foot: a detour of 1.3 at 75 metres a minute."""
    return metres * 1.3 / 75


def rounded_minutes(minutes: Column) -> Column:
    """Shown travel time: 5 below 7.5, steps of 5 to 60 and of 10 beyond; null over two hours."""
    five, ten = half_up(minutes / 5) * 5, half_up(minutes / 10) * 10
    return F.when(minutes > 120, None).when(minutes < 7.5, F.lit(5)).when(five <= 60, five).otherwise(ten)


def rounded_metres(metres: Column) -> Column:
    """Shown distance in metres: steps of 100 (100 at least) below 1 km, 100 m to 10 km, then whole km."""
    hundred = F.greatest(F.lit(100), half_up(metres / 100) * 100)
    return F.when(hundred < 10_000, hundred).otherwise(half_up(metres / 1000) * 1000)


def cell_key(lat: Column, lon: Column, decimals: int = 5) -> Column:
    """Key of a place by its coordinates."""
    return F.concat_ws(",", F.format_number(lat, decimals), F.format_number(lon, decimals))
