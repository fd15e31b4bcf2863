"""Geodesy as Column expressions: chord distance, bearing, speed, interpolation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS-84 semi-axes in metres.
SEMI_MAJOR_M = 6378137.0
SEMI_MINOR_M = 6356752.314245

_A2 = SEMI_MAJOR_M * SEMI_MAJOR_M
_B2 = SEMI_MINOR_M * SEMI_MINOR_M

# No two surface points are farther apart than this chord.
MAX_CHORD_M = 2 * SEMI_MAJOR_M


def ecef(lat: Column, lon: Column) -> Column:
    """Earth-centred ``struct<x,y,z>`` of a surface point, altitude ignored."""
    phi, lam = F.radians(lat), F.radians(lon)
    cos_phi, sin_phi = F.cos(phi), F.sin(phi)
    norm = F.sqrt(_A2 * cos_phi * cos_phi + _B2 * sin_phi * sin_phi)
    ring = _A2 * cos_phi / norm
    return F.struct(
        (ring * F.cos(lam)).alias("x"),
        (ring * F.sin(lam)).alias("y"),
        (_B2 * sin_phi / norm).alias("z"),
    )


def chord(a: Column, b: Column) -> Column:
    """Straight-line distance between two ``ecef`` structs."""
    dx, dy, dz = (a[axis] - b[axis] for axis in ("x", "y", "z"))
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def chord_sql(a: str, b: str) -> str:
    """``chord`` as SQL text over two struct column names, for long generated rules."""
    gap = lambda axis: f"({a}.{axis} - {b}.{axis})"
    return "sqrt(" + " + ".join(f"{gap(axis)} * {gap(axis)}" for axis in "xyz") + ")"


def gps_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Chord distance in metres (through the ellipsoid, not along it)."""
    return chord(ecef(lat1, lon1), ecef(lat2, lon2))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial compass bearing in [0, 360); the short way round the antimeridian."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    raw = F.radians(lon2) - F.radians(lon1)
    dlon = (
        F.when(raw > math.pi, raw - 2 * math.pi)
        .when(raw < -math.pi, raw + 2 * math.pi)
        .otherwise(raw)
    )
    east = F.sin(dlon) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def diff_bearing(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings."""
    gap = F.abs(b - a)
    return F.when(gap > 180, 360 - gap).otherwise(gap)


def point_speed(distance: Column, t1: Column, t2: Column) -> Column:
    """Metres per second; two points at one instant are infinitely fast."""
    elapsed = F.abs(t2 - t1)
    return F.when(elapsed == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(distance, elapsed)
    )


def farther_than(distance: Column, limit: float | Column) -> Column:
    return distance > limit


def not_faster_than(speed: Column, limit: float | Column) -> Column:
    return speed <= limit


def both(left: Column, right: Column) -> Column:
    return left & right


def weight(t: Column, t1: Column, t2: Column) -> Column:
    """Share of the way from ``t1`` to ``t2``; 0 when the two coincide."""
    return F.when(t1 == t2, F.lit(0.0)).otherwise(F.try_divide(t - t1, t2 - t1))


def lerp(a: Column, b: Column, w: Column) -> Column:
    """Linear blend; null as soon as either end is null."""
    return a + (b - a) * w
