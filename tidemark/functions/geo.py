"""Geography on (lat, lon) columns in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean sphere radius for distances, equatorial radius for areas, metres.
SPHERE_RADIUS_M = 6_371_010.0
AREA_RADIUS_M = 6_378_137.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * SPHERE_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def inside_world(lat: Column, lon: Column) -> Column:
    """Strictly inside ±90 / ±180."""
    return (lat < 90) & (lat > -90) & (lon < 180) & (lon > -180)


def degree_bin(coordinate: Column) -> Column:
    """Nearest whole degree, halves away from zero."""
    return F.round(coordinate).cast("double")


def cell_area_km2(lat: Column, size: float = 1.0) -> Column:
    """Area of the cell ``[lat, lat+size]`` x ``size`` degrees of longitude."""
    band = F.sin(F.radians(lat + size)) - F.sin(F.radians(lat))
    return F.abs(band) * F.radians(F.lit(size)) * (AREA_RADIUS_M * AREA_RADIUS_M * 1e-6)


def midpoint(a: Column, b: Column, *, wrap: bool = False) -> Column:
    """Plain mean of two coordinates; with ``wrap`` the mean of two longitudes over ±180."""
    mean = (a + b) / 2
    if not wrap:
        return mean
    far = F.abs(a - b) > 180
    return F.when(far, F.when(mean > 0, mean - 180).otherwise(mean + 180)).otherwise(mean)
