"""Great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swipelake.fixed_values import EARTH_RADIUS_KM


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points in degrees; NULL when any input is NULL."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((phi2 - phi1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * half_lon * half_lon
    # least() skips NULL, so the clamp against rounding above 1 must keep NULL itself.
    clamped = F.when(chord > 1, 1.0).otherwise(chord)
    return F.asin(F.sqrt(clamped)) * (2 * EARTH_RADIUS_KM)
