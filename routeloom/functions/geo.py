"""Geometry on the sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The planners' earth radius and the audits' one, in metres.
PLANNER_RADIUS_M, AUDIT_RADIUS_M = 6_371_000.0, 6_371_008.8
DEGREE_M = 111_195.0


def haversine(lat1, lon1, lat2, lon2, radius: float = PLANNER_RADIUS_M) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


def longitude_gap(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(360.0) - d)


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    return F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def metres(distance: Column) -> Column:
    """Whole metres, half up; the same in every engine."""
    return F.floor(distance + 0.5).cast("long")


def in_world(lat: Column, lon: Column) -> Column:
    return lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)


def chord_cell(lat: Column, lon: Column, radius_m: float, sphere: float = AUDIT_RADIUS_M) -> list[Column]:
    """Cell of a cubic grid over the unit sphere, as wide as the radius's chord; 27 cells hold all
    neighbours everywhere, poles and the date line included."""
    import math

    size = 2 * math.sin(radius_m / (2 * sphere)) * 1.0000001
    return [F.floor(x / F.lit(size)).cast("long") for x in unit_vector(lat, lon)]


def segment_projection(px, py, ax, ay, bx, by) -> tuple[Column, Column]:
    """(fraction along a-b, squared distance) of a point on a plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length)))
    return t, F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2)
