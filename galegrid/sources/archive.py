"""Archives of gridded files in date folders, and the catalogue of frames that says which files a time needs.

The catalogue is made once from an archive's coordinates (no values are read) and stored: a row for each frame, and the three axes. Frames are
numbered by their time, not by their rank, so a number means the same time whatever is missing. Reads join the scan with the wanted
frames on the date folder, so other folders are pruned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import axes as ax
from ..operators import patches
from ..session import checkpoint_dir
from .readers import null_for_nan

#: Wanted frames that are sent to all tasks; beyond it the join is a shuffle.
BROADCAST_FRAMES = 100_000


@dataclass(frozen=True)
class Layout:
    """Names of an archive's columns: coordinates in degrees, time, and the folders' partition column."""

    variable: str
    lat: str = "lat"
    lon: str = "lon"
    time: str = "time"
    day: str = "day"


INFRARED = Layout("Tb")
WIND = Layout("u", "latitude", "longitude")


@dataclass(frozen=True)
class Axis:
    """A linear axis: its least value, step and number of points. Times are seconds since 1970."""

    first: float
    step: float
    n: int


class Archive:
    """An archive with its catalogue. frames: (t, ts, day, cells, files); lat, lon, time: its axes. missing: numbers of times between the first and
    last frame that no file has."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout, frames: DataFrame, found: dict[str, Axis]) -> None:
        self.spark, self.path, self.layout, self.frames = spark, path, layout, frames
        self.lat, self.lon, self.time = found["lat"], found["lon"], found["time"]

    @property
    def missing(self) -> DataFrame:
        every = self.spark.range(self.time.n).select(F.col("id").cast("int").alias("t"))
        return every.join(self.frames.select("t"), "t", "left_anti")

    def half_width(self, size: float) -> int:
        """Half the side, in pixels, of a patch of so many degrees."""
        return int(size / self.lon.step)

    def cells(self, wanted: DataFrame | None = None) -> DataFrame:
        """(t, ts, y, x, v) of all frames, or of those in wanted, (t): other date folders aren't read. Rows count from the least latitude, columns
        from the least longitude. NaN becomes null."""
        frames = self.frames.select("t", "ts", "day")
        if wanted is not None:
            checkpoint_dir(self.spark)
            # a plan that stays as it is, so that the scan's pruning can use the join's broadcast; the range tells Spark that it is worth it
            frames = frames.join(wanted.select("t").distinct(), "t", "left_semi").checkpoint().where(F.col("t").between(0, self.time.n - 1))
            if frames.limit(BROADCAST_FRAMES + 1).count() <= BROADCAST_FRAMES:
                frames = F.broadcast(frames)
        names = self.layout
        raw = self.spark.read.parquet(self.path).select(
            F.col(names.day).alias("day"), F.col(names.time).alias("ts"), F.col(names.lat).alias("lat"), F.col(names.lon).alias("lon"), null_for_nan(names.variable).alias("v")
        )
        pixel = lambda c, axis: ax.coordinate_to_pixel(F.col(c), F.lit(axis.first), F.lit(axis.step))
        return raw.join(frames, ["day", "ts"]).select("t", "ts", pixel("lat", self.lat).alias("y"), pixel("lon", self.lon).alias("x"), "v")

    def placed(self, points: DataFrame, beyond: str = "error") -> DataFrame:
        """points (iso_time, lat, lon) with index, their time's place among the frames (halves and fractions too), and y, x, the nearest pixel. beyond: times
        before the first frame or after the last are errors, or, with "missing", have no index."""
        index = patches.time_index(F.col("iso_time"), F.timestamp_seconds(F.lit(self.time.first)), self.time.step)
        inside = index.between(0, self.time.n - 1)
        other = F.lit(None).cast("double") if beyond == "missing" else F.raise_error(F.concat(F.lit("no frame is near "), F.col("iso_time").cast("string")))
        return points.withColumns({
            "index": F.when(inside, index).otherwise(other),
            "y": ax.coordinate_to_pixel(F.col("lat"), F.lit(self.lat.first), F.lit(self.lat.step)), "x": ax.coordinate_to_pixel(F.col("lon"), F.lit(self.lon.first), F.lit(self.lon.step)),
        })

    def nearest_patches(self, points: DataFrame, half: int, beyond: str = "error") -> DataFrame:
        """(point_id, py, px, v): boxes of 2 * half pixels about points (point_id, iso_time, lat, lon) in the nearest frame. A frame that is missing
        gives patches without values; points without an index give none."""
        there = patches.nearest_frame(self.placed(points, beyond).where("index is not null"))
        return patches.square_patch(there, self.cells(there), half, self.lat.n, self.lon.n)

    def wind_patches(self, points: DataFrame, half: int, beyond: str = "error") -> DataFrame:
        """(point_id, py, px, v): boxes in the frame of the time, or the mean of two when it is half-way between them; rows from the last. Other
        times are errors."""
        there = patches.frames_at(self.placed(points, beyond).where("index is not null"), "index", self.time.n)
        found = patches.square_patch(there, self.cells(there), half, self.lat.n, self.lon.n, flip=True)
        return found.groupBy("point_id", "py", "px").agg(F.avg("v").alias("v"))


def _axes(coordinates: DataFrame, gaps: str, square: bool, tolerance: float) -> dict[str, Axis]:
    """Axes of (axis, value), distinct, or ValueError: lat and lon must be linear and their pixels square; times must be linear, or, with gaps
    "missing", whole steps apart."""
    rows = {r["axis"]: r for r in ax.axis_summary(coordinates, "axis", "value", tolerance).collect()}
    if not rows:
        raise ValueError("the archive has no frames")
    found = {}
    for name, r in rows.items():
        step = r["dx"] or 1.0
        if not r["linear"]:
            if name != "time" or gaps != "missing":
                raise ValueError(f"the {name} axis isn't linear: steps differ" + (", or a frame is missing" if name == "time" else ""))
            steps = coordinates.where("axis = 'time'").select(F.col("value") - F.lag("value").over(ax.Window.orderBy("value")))
            steps = steps.toDF("step").where("step is not null").groupBy("step").count().select("step")
            step = steps.agg(F.min("step")).first()[0]
            odd = steps.where(F.abs(F.col("step") / step - F.rint(F.col("step") / step)) > tolerance).first()
            if odd is not None:
                raise ValueError(f"times aren't whole steps of {step} seconds apart: {odd[0]}")
        last = r["x0"] + (r["dx"] or 0.0) * (r["n"] - 1)
        found[name] = Axis(r["x0"], step, round((last - r["x0"]) / step) + 1)
    ratio = abs(found["lon"].step / found["lat"].step)
    if square and not 0.999 < ratio < 1.001:
        raise ValueError(f"pixels aren't square: steps of {found['lat'].step} and {found['lon'].step} degrees")
    return found


def build_catalogue(spark: SparkSession, path: str, target: str, layout: Layout = INFRARED, gaps: str = "error", square: bool = True, tolerance: float = 1e-3) -> Archive:
    """The archive at path with its catalogue, which is written to target. Two passes over the coordinates; values aren't read. Axes that aren't linear,
    pixels that aren't square, a time in two folders, and, unless gaps is "missing", a missing frame are ValueErrors."""
    if gaps not in ("error", "missing"):
        raise ValueError("gaps must be error or missing")
    raw = spark.read.parquet(path).select(
        F.col(layout.day).alias("day"), F.col(layout.time).alias("ts"), F.col(layout.lat).cast("double").alias("lat"), F.col(layout.lon).cast("double").alias("lon"),
        F.col("_metadata.file_name").alias("file"),
    )
    seconds = F.unix_micros(F.to_timestamp(F.col("ts").cast("string"))) / 1e6
    each = F.explode(F.create_map(F.lit("lat"), F.col("lat"), F.lit("lon"), F.col("lon"), F.lit("time"), seconds)).alias("axis", "value")
    found = _axes(raw.select(each).distinct(), gaps, square, tolerance)
    by_frame = raw.groupBy("ts", "day").agg(F.count(F.lit(1)).alias("cells"), F.sort_array(F.collect_set("file")).alias("files"))
    number = F.rint((seconds - found["time"].first) / found["time"].step).cast("int")
    by_frame.select(number.alias("t"), "ts", "day", "cells", "files").write.mode("overwrite").parquet(f"{target}/frames")
    twice = spark.read.parquet(f"{target}/frames").groupBy("t").count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"frame {twice['t']} is in more than one folder")
    spark.createDataFrame([(name, a.first, a.step, a.n) for name, a in found.items()], "axis string, first double, step double, n int").coalesce(1).write.mode("overwrite").parquet(f"{target}/axes")
    return open_archive(spark, path, target, layout)


def open_archive(spark: SparkSession, path: str, target: str, layout: Layout = INFRARED) -> Archive:
    """The archive at path with the catalogue stored at target."""
    found = {r["axis"]: Axis(r["first"], r["step"], r["n"]) for r in spark.read.parquet(f"{target}/axes").collect()}
    return Archive(spark, path, layout, spark.read.parquet(f"{target}/frames"), found)
