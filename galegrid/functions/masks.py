"""Offsets of neighbourhoods as small relations; their size follows from the radius, never from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .angles import coarse_angle, ray_angle


def square(spark: SparkSession, radius: int, upper: int | None = None) -> DataFrame:
    """(dy, dx) from -radius to upper; upper: radius - 1 unless given, which makes a box of even side."""
    n = (radius - 1 if upper is None else upper) + radius + 1
    side = spark.range(n).select((F.col("id") - radius).cast("int").alias("d"))
    return side.select(F.col("d").alias("dy")).crossJoin(side.select(F.col("d").alias("dx")))


def disc(spark: SparkSession, radius: int) -> DataFrame:
    """(dy, dx, ray) strictly within the radius of a pixel."""
    dy, dx = F.col("dy"), F.col("dx")
    return square(spark, radius).where(dy * dy + dx * dx < radius * radius).withColumn("ray", ray_angle(dy, dx))


def half_disc(spark: SparkSession, radius: int) -> DataFrame:
    """(dy, dx, ray) of pixels whose centres lie within the radius of a pixel's corner, the border included."""
    y, x = F.col("dy") + 0.5, F.col("dx") + 0.5
    return square(spark, radius).where(y * y + x * x <= radius * radius).withColumn("ray", coarse_angle(y, x))


def diamond(spark: SparkSession, radius: int) -> DataFrame:
    """(dy, dx) that radius steps to the four neighbours reach."""
    return square(spark, radius, radius).where(F.abs("dy") + F.abs("dx") <= radius)


def disc_cells(radius: int) -> int:
    return sum(dy * dy + dx * dx < radius * radius for dy in range(-radius, radius) for dx in range(-radius, radius))


def half_disc_cells(radius: int) -> int:
    return sum((dy + 0.5) ** 2 + (dx + 0.5) ** 2 <= radius * radius for dy in range(-radius, radius) for dx in range(-radius, radius))
