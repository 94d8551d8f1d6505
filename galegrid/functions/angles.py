"""Angles in degrees: gradient directions, rays, and the two ways to fold a difference of angles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: degrees in a radian as the centre-only statistic rounds them.
COARSE_DEGREES = 57.29578


def full_turn(degrees: Column) -> Column:
    return F.pmod(degrees, F.lit(360.0))


def gradient_angle(dy: Column, dx: Column) -> Column:
    """Direction of decreasing values, 0 to 360, anticlockwise from east. A flat spot has 180 (engines differ on signed zeros,
    so it is stated)."""
    flat = (dy == 0) & (dx == 0)
    return F.when(dy.isNull() | dx.isNull(), None).when(flat, F.lit(180.0)).otherwise(full_turn(F.degrees(F.atan2(dy, -dx))))


def ray_angle(dy: Column, dx: Column) -> Column:
    """Direction from the centre to the offset (rows grow southwards); the centre has 0."""
    return F.when((dy == 0) & (dx == 0), F.lit(0.0)).otherwise(full_turn(F.degrees(F.atan2(-dy, dx))))


def coarse_angle(y: Column, x: Column) -> Column:
    """The centre-only statistic's angle: no change of sign, degrees rounded."""
    return F.when((y == 0) & (x == 0), F.lit(0.0)).otherwise(full_turn(COARSE_DEGREES * F.atan2(y, x)))


def fold_angle(d: Column) -> Column:
    """Triangle wave of a difference from -360 to 360: -90 to 90, with no jump."""
    return (
        F.when(d < -270, d + 360).when(d < -90, -d - 180)
        .when(d > 270, d - 360).when(d > 90, F.lit(180.0) - d).otherwise(d)
    )


def wrap_angle(d: Column) -> Column:
    """Sawtooth of a difference from -360 to 360: equal modulo 180, from -90 to 90."""
    return (
        F.when(d < -270, d + 360).when(d < -90, d + 180)
        .when(d > 270, d - 360).when(d > 90, d - 180).otherwise(d)
    )
