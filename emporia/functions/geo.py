"""Great-circle distance as a native column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance in km; null if any coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlat = p2 - p1
    dlng = F.radians(lng2) - F.radians(lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlng / 2), 2)
    # Clamp rounding overshoot above 1; a null h must stay null (least() would skip it).
    clamped = F.when(h > 1.0, F.lit(1.0)).otherwise(h)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clamped))


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance rounded to whole metres, as bigint.

    Trigonometry differs between math libraries in the last digits; metres are
    far coarser than that noise, and integer metres sum exactly.
    """
    return F.round(haversine_km(lat1, lng1, lat2, lng2) * 1000).cast("bigint")
