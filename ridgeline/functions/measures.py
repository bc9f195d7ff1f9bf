"""Numbers, places and sets, as column expressions.

The earth constants differ on purpose: each belongs to one use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROJECTION_RADIUS_M = 6378137.0
DISPLAY_RADIUS_M = 6371000.0
KM_PER_DEGREE = 111.0
DEM_M_PER_DEGREE = 111194.93  # ground metres a degree of latitude, for margins of elevation grids


def portable_round(x: Column, digits: int) -> Column:
    """Half up by way of floor; engines agree on it, unlike on round()."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def half_even(x: Column) -> Column:
    return F.rint(x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def easting(lon: Column, mean_lat: Column) -> Column:
    return F.radians(lon) * F.lit(PROJECTION_RADIUS_M) * F.cos(F.radians(mean_lat))


def northing(lat: Column) -> Column:
    return F.radians(lat) * F.lit(PROJECTION_RADIUS_M)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0)
    )
    return F.lit(2 * DISPLAY_RADIUS_M) * F.asin(F.sqrt(a))


def degrees_per_km_lon(lat: Column) -> Column:
    """Null close to the poles, where it has no useful value."""
    c = F.cos(F.radians(lat))
    return F.when(F.abs(c) >= 1e-4, F.lit(1.0) / (F.lit(KM_PER_DEGREE) * c))


def ratio(up: Column, down: Column, length: Column) -> Column:
    """Mean gradient of a route: climbed and lost height over length; 0 without length."""
    return F.when(length > 0, (up + down) / length).otherwise(F.lit(0.0))


def segment_id(u: Column, v: Column, key: Column) -> Column:
    """Identity of a piece of way in either direction."""
    return F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), key.alias("k"))


def jaccard_distance(x: Column, y: Column) -> Column:
    """1 - |x & y| / |x | y|; 0 for two empty sets."""
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(x, y)) / union)
