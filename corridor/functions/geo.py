"""Distances, boxes and grid cells on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the earth and length of a degree of latitude, in km.
EARTH_KM = 6371.0
DEGREE_KM = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def box_around(lat: Column, lon: Column, radius_km: Column) -> dict[str, Column]:
    """A box of ``radius_km`` to each side."""
    up, out = radius_km / DEGREE_KM, radius_km / (F.lit(DEGREE_KM) * F.cos(F.radians(lat)))
    return {"north": lat + up, "south": lat - up, "east": lon + out, "west": lon - out}


def cell(x: Column, size: float) -> Column:
    """Grid cell of a coordinate; cut toward zero."""
    return (x / F.lit(size)).cast("bigint")


def speed_ratio(mean: Column, free: Column) -> Column:
    """1 is free flow; without a free speed too."""
    return F.when(free <= 0, 1.0).otherwise(F.least(F.lit(1.0), mean / free))


def colour_index(value: Column) -> Column:
    """Steps of a map's palette by the logarithm of a count."""
    return F.when(value < 10, 32).otherwise(F.least(F.lit(132.0), F.lit(32.0) + F.log10(value / 10) * 30).cast("int"))


def scaled_width(value: Column, least: Column, most: Column, thin: float, thick: float) -> Column:
    """Width by the square root of a value's place between the extremes; the middle where they agree."""
    share = F.sqrt((value - least) / (most - least))
    return F.when(most == least, F.lit((thin + thick) / 2)).otherwise(F.lit(thin) + F.lit(thick - thin) * share)
