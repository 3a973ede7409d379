"""Distances, speeds and point-in-polygon as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
#: One edge of a ring: from (x1, y1) to (x2, y2).
Edge = tuple[float, float, float, float]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is. Rounding can't push the root's argument out of [0, 1]."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), F.lit(2))
    a = F.when(a.isNotNull(), F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def speed_kph(distance_km: Column, seconds: Column) -> Column:
    """Distance over time; 0 where no time has passed or it is unknown."""
    return F.when(seconds > 0, distance_km / (seconds / F.lit(3600.0))).otherwise(F.lit(0.0))


def heading_degrees(dlat: Column, dlon: Column) -> Column:
    return F.degrees(F.atan2(dlon, dlat))


def within_edges(x: Column, y: Column, edges: list[Edge]) -> Column:
    """Whether (x, y) lies strictly inside the rings that the edges make: an odd number of edges to its right, and on none.

    Holes and several parts are just more edges. The edges are a literal, so their number bounds the expression's size.
    """
    table = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), e, strict=True)]) for e in edges])

    def crosses(e: Column) -> Column:
        at = (e.x2 - e.x1) * (y - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1
        return F.coalesce(((e.y1 > y) != (e.y2 > y)) & (x < at), F.lit(False))

    def touches(e: Column) -> Column:
        straight = (e.x2 - e.x1) * (y - e.y1) == (e.y2 - e.y1) * (x - e.x1)
        return straight & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    odd = F.aggregate(table, F.lit(False), lambda inside, e: inside != crosses(e))
    return odd & ~F.exists(table, touches)
