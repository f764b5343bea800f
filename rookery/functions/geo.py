"""Great-circle distance as Column expressions, in two variants that differ in radius and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_MEAN_M = 6_371_008.8
EARTH_ROUND_M = 6_371_000.0


def haversine_m(lon1, lat1, lon2, lat2, radius: float = EARTH_MEAN_M) -> Column:
    """Unrounded haversine distance in metres."""
    lon1, lat1, lon2, lat2 = (F.radians(x) for x in (lon1, lat1, lon2, lat2))
    s1, s2 = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(lat1) * F.cos(lat2) * s2 * s2
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def haversine_m_int(lon1, lat1, lon2, lat2) -> Column:
    """Whole metres on the round radius, half to even as in a binary rounding."""
    return F.bround(haversine_m(lon1, lat1, lon2, lat2, EARTH_ROUND_M), 0).cast("int")


def usable(lon, lat) -> Column:
    """Neither null nor NaN, not both exactly 0, inside ±180 / ±90."""
    lon, lat = (F.col(x) if isinstance(x, str) else x for x in (lon, lat))
    return F.coalesce(
        lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat) & lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0) & ~((lon == 0.0) & (lat == 0.0)),
        F.lit(False),
    )
