"""Geometry and binning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
#: Edges of the norm's distance bins, and of the coarse bands.
NORM_EDGES = (0, 200, 300, 400, 500, 650, 800, 1000, 1200, 1500, 2000, 3000, 99999)
BAND_EDGES = (150, 300, 500, 800, 1200, 2000, 20000)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, with the first point's latitude as the scale of longitudes."""
    return F.hypot((lon2 - lon1) * 111.32 * F.cos(F.radians(lat1)), (lat2 - lat1) * 110.57)


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def gc_point(lat1: Column, lon1: Column, lat2: Column, lon2: Column, f: Column) -> tuple[Column, Column]:
    """The point at the fraction f of the great circle; the start where both ends agree."""
    d = haversine_km(lat1, lon1, lat2, lon2) / EARTH_KM
    a, b = F.sin((1 - f) * d) / F.sin(d), F.sin(f * d) / F.sin(d)
    p1, l1, p2, l2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    x = a * F.cos(p1) * F.cos(l1) + b * F.cos(p2) * F.cos(l2)
    y = a * F.cos(p1) * F.sin(l1) + b * F.cos(p2) * F.sin(l2)
    z = a * F.sin(p1) + b * F.sin(p2)
    same = d < 1e-12
    return F.when(same, lat1).otherwise(F.degrees(F.atan2(z, F.hypot(x, y)))), F.when(same, lon1).otherwise(F.degrees(F.atan2(y, x)))


def right_closed(x: Column, edges: tuple[int, ...] = NORM_EDGES) -> Column:
    """The interval (lo, hi] of edges that holds x, as text; 'nan' outside and for null."""
    out = F.lit("nan")
    for lo, hi in zip(edges[-2::-1], edges[:0:-1], strict=True):
        out = F.when((x > lo) & (x <= hi), F.lit(f"({lo}, {hi}]")).otherwise(out)
    return out


def bucket(x: Column, width: float) -> Column:
    """The nearest multiple of width, halves to the even one."""
    return F.bround(x / width) * width
