"""Geodesy and road tags as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M = 6_371_000.0, 111_320.0
#: Road classes of map tags, and the classes' codes.
ROAD_CLASSES = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary",
    "secondary": "secondary", "secondary_link": "secondary", "tertiary": "tertiary", "tertiary_link": "tertiary",
    "residential": "residential", "living_street": "residential", "unclassified": "other", "service": "other", "track": "other",
}
ROAD_CODES = {"motorway": 0, "trunk": 1, "primary": 2, "secondary": 3, "tertiary": 4, "residential": 5, "other": 6}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """Signed difference a - b of two angles, from -180 to below 180."""
    return F.pmod(a - b + 180, F.lit(360.0)) - 180


def menger(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Curvature of the circle through three points; 0 where they coincide."""
    d = lambda xa, ya, xb, yb: F.sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya))
    area2 = F.abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1))
    sides = d(x1, y1, x2, y2) * d(x2, y2, x3, y3) * d(x1, y1, x3, y3)
    return F.when(sides < 1e-12, F.lit(0.0)).otherwise(2 * area2 / sides)


def road_class(tag: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in ROAD_CLASSES.items() for x in kv))
    return F.coalesce(pairs[F.lower(tag)], F.lit("other"))


def road_code(kind: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in ROAD_CODES.items() for x in kv))
    return F.coalesce(pairs[kind], F.lit(6))


def is_link(tag: Column) -> Column:
    return F.coalesce(F.lower(tag).contains("link"), F.lit(False))


def speed_limit(tag: Column) -> Column:
    """km/h: `50`, `50 mph`; the first word of others; null where it is no number."""
    s = F.trim(F.lower(tag))
    mph = F.trim(F.replace(s, F.lit("mph"), F.lit(""))).try_cast("double") * 1.60934
    return F.when(s.contains("mph"), mph).otherwise(F.element_at(F.split(s, r"\s+"), 1).try_cast("double"))


def lanes(tag: Column) -> Column:
    """Whole lanes; null where it is no number."""
    return tag.try_cast("double").cast("int")
