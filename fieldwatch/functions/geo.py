"""Distances and height corrections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
METRES_PER_HPA = 8.4  # fixed value


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance, 2 dp."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.round(EARTH_KM * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 2)


def pressure_at(pressure: Column, from_m: Column, to_m: Column) -> Column:
    """Pressure moved from one elevation to another."""
    return pressure - (to_m - from_m) / METRES_PER_HPA
