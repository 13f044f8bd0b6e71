"""Great-circle distance and bounds on it for latitude/longitude boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .fixed_values import EARTH_RADIUS_M

RADIUS_KM = EARTH_RADIUS_M / 1000


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres.

    Differences are taken in degrees, so that points mirrored east and west of
    a site get exactly the same distance and stay ties.
    """
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def box_lower_bound_km(
    lat: Column, lon: Column, lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column
) -> Column:
    """A distance no point of the box can undercut.

    The larger of the gap in latitude and the distance to the nearer bounding
    meridian; longitudes are compared around the globe, so boxes next to the
    180-degree line need no special case.  A relative slack of 1e-9 keeps the
    bound safe under rounding.
    """
    lat_gap = F.greatest(lat_min - lat, lat - lat_max, F.lit(0.0))
    centre = (lon_min + lon_max) / 2
    apart = F.abs(F.pmod(lon - centre + 180, F.lit(360.0)) - 180)
    lon_gap = F.least(F.greatest(apart - (lon_max - lon_min) / 2, F.lit(0.0)), F.lit(90.0))
    meridian = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(lon_gap)))
    return F.lit(RADIUS_KM * (1 - 1e-9)) * F.greatest(F.radians(lat_gap), meridian)
