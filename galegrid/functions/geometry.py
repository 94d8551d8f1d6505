"""Wind radii as arcs and connectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_radii(radii: str) -> Column:
    """The array, or an error unless it has four values of 0 or more."""
    ok = (F.size(radii) == 4) & F.forall(radii, lambda r: r.isNotNull() & (r >= 0))
    return F.when(F.coalesce(ok, F.lit(False)), F.col(radii)).otherwise(F.raise_error(F.lit("wind radii must be four numbers of 0 or more: NE, SE, SW, NW")))


def wind_radii_arcs(storms: DataFrame, key: str, radii: str, resolution: float, height: int, width: int) -> DataFrame:
    """(key, quadrant, start_deg, end_deg, diameter_px, x0, y0, x1, y1): each quadrant's arc about the image's centre, and the line
    that joins it to the quadrant before (the first to the last) where it starts."""
    cy, cx = width // 2, height // 2  # the centre is taken from the image's shape, height first
    one = storms.select(key, checked_radii(radii).alias("r")).select(key, "r", F.posexplode("r").alias("quadrant", "radius"))
    before = F.get("r", F.pmod(F.col("quadrant") - 1, F.lit(4)))
    start = (F.col("quadrant") - 1) * 90.0
    dx, dy = 0.5 * F.cos(F.radians(start)), 0.5 * F.sin(F.radians(start))
    pixels = lambda r: 2 * r / resolution
    return one.select(
        key, "quadrant", start.alias("start_deg"), (start + 90).alias("end_deg"), pixels(F.col("radius")).alias("diameter_px"),
        (cy + dx * pixels(before)).alias("x0"), (cx + dy * pixels(before)).alias("y0"),
        (cy + dx * pixels(F.col("radius"))).alias("x1"), (cx + dy * pixels(F.col("radius"))).alias("y1"),
    )
