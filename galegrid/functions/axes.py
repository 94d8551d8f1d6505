"""Linear axes: pixels and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixel_to_coordinate(pixel: Column, origin: Column, step: Column) -> Column:
    return step * pixel + origin


def coordinate_to_pixel(coordinate: Column, origin: Column, step: Column) -> Column:
    """The nearest pixel; halves go to the even one."""
    return F.rint((coordinate - origin) / step).cast("int")


def clamped_row(latitude: Column, origin: Column, step: Column, height: Column) -> Column:
    """The row a latitude falls in, from 0 to height."""
    return F.when(latitude.isNotNull(), F.least(F.greatest(F.floor((latitude - origin) / step), F.lit(0)), height).cast("int"))


def frame_time_text(day: Column, time: Column) -> Column:
    """A frame's time from a date and a time of which the last five characters go."""
    return F.concat(day, F.lit(" "), F.left(time, F.greatest(F.length(time) - 5, F.lit(0))))


def rescaled_axis(origin: Column, step: Column, factor: Column) -> tuple[Column, Column]:
    """Origin and step of an axis whose pixels become factor times as large; the origin moves by step / factor."""
    return origin + step / factor, step * factor


def axis_summary(points: DataFrame, axis: str, value: str, tolerance: float = 1e-3) -> DataFrame:
    """(axis, x0, dx, n, linear) of each axis: first value, mean step, number of points, and whether no two steps differ by
    tolerance or more. points: (axis, value), values distinct."""
    steps = points.withColumn("step", F.lead(value).over(Window.partitionBy(axis).orderBy(value)) - F.col(value))
    return steps.groupBy(axis).agg(
        F.min(value).alias("x0"),
        F.try_divide(F.max(value) - F.min(value), F.count(F.lit(1)) - 1).alias("dx"),
        F.count(F.lit(1)).alias("n"),
        (F.coalesce(F.max("step") - F.min("step"), F.lit(0.0)) < tolerance).alias("linear"),
    )


def square_pixels(dx_lat: Column, dx_lon: Column) -> Column:
    """Whether the two steps differ by less than a thousandth."""
    ratio = F.abs(dx_lon / dx_lat)
    return (ratio > 0.999) & (ratio < 1.001)
