"""Readers of grids, tracks and masks from parquet, and sinks of drawing layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas


def null_for_nan(column: str) -> Column:
    return F.nullif(F.col(column).cast("double"), F.lit(float("nan")))


def frame_numbers(times: DataFrame, numbered: str = "time", gaps: str = "error") -> DataFrame:
    """(ts, t) of distinct times (ts). numbered "time": t is the time's place on a linear axis from the first time on, in the least step that
    there is; other than whole steps are an error, and so is a missing frame, unless gaps is "missing": then its number is left out. numbered
    "rank": the times in order, whatever lies between them. One task sorts the times, a row for each frame."""
    if numbered not in ("time", "rank") or gaps not in ("error", "missing"):
        raise ValueError("numbered must be time or rank, gaps error or missing")
    order = Window.orderBy("ts")
    if numbered == "rank":
        return times.withColumn("t", (F.row_number().over(order) - 1).cast("int"))
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    micros = F.unix_micros(F.to_timestamp(F.col("ts").cast("string")))
    steps = times.withColumn("at", micros).withColumn("gap", F.col("at") - F.lag("at").over(order))
    steps = steps.withColumns({"least": F.min("gap").over(every), "since": F.col("at") - F.min("at").over(every)})
    whole = F.coalesce(F.col("since") % F.col("least"), F.lit(0)) == 0
    ok = whole if gaps == "missing" else whole & (F.coalesce(F.col("gap"), F.col("least"), F.lit(0)) == F.coalesce("least", F.lit(0)))
    t = F.coalesce(F.expr("since div least"), F.lit(0)).cast("int")
    return steps.select("ts", F.when(ok, t).otherwise(F.raise_error(F.concat(F.lit("a frame is missing before, or the time axis isn't linear at, "), F.col("ts").cast("string")))).alias("t"))


def read_grid(
    spark: SparkSession, *paths: str, variable: str = "v", y: str = "y", x: str = "x", time: str = "ts", numbered: str = "time", gaps: str = "error"
) -> DataFrame:
    """(t, ts, y, x, v) of one variable of gridded files; t as frame_numbers gives it. Only the columns named are read, and
    filters on them reach the scan."""
    raw = spark.read.parquet(*paths).select(
        F.col(time).alias("ts"), F.col(y).cast("int").alias("y"), F.col(x).cast("int").alias("x"), null_for_nan(variable).alias("v")
    )
    return raw.join(frame_numbers(raw.select("ts").distinct(), numbered, gaps), "ts").select("t", "ts", "y", "x", "v")


def read_infrared(spark: SparkSession, *paths: str, gaps: str = "error") -> DataFrame:
    """Brightness temperatures of files with columns time, lat, lon, Tb, where lat and lon are indexes (in degrees: archive.py)."""
    return read_grid(spark, *paths, variable="Tb", y="lat", x="lon", time="time", gaps=gaps)


def read_wind(spark: SparkSession, *paths: str, direction: str = "u", gaps: str = "error") -> DataFrame:
    """One wind component of files with columns time, latitude, longitude (indexes) and components."""
    return read_grid(spark, *paths, variable=direction, y="latitude", x="longitude", time="time", gaps=gaps)


def checked_range(grid: DataFrame, lowest: float = 160.0, highest: float = 335.0) -> DataFrame:
    """grid, or an error at a value that isn't a temperature in kelvin; missing values pass."""
    ok = F.col("v").isNull() | F.col("v").between(lowest, highest)
    return grid.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not a temperature in kelvin: "), F.col("v").cast("string")))))


def range_report(grid: DataFrame, lowest: float = 160.0, highest: float = 335.0) -> DataFrame:
    """(t, valid, lowest, highest) of each frame."""
    ok = F.col("v").isNull() | F.col("v").between(lowest, highest)
    return grid.groupBy("t").agg(F.bool_and(ok).alias("valid"), F.min("v").alias("lowest"), F.max("v").alias("highest"))


def crop(grid: DataFrame, north: int, south: int, west: int, east: int) -> DataFrame:
    """Rows from south to north and columns from west to east, their ends excluded, counted anew from 0."""
    inside = (F.col("y") >= south) & (F.col("y") < north) & (F.col("x") >= west) & (F.col("x") < east)
    return grid.where(inside).withColumns({"y": F.col("y") - south, "x": F.col("x") - west})


def check_bounds(north: float, south: float, west: float, east: float) -> None:
    """Bounds of a crop in degrees: latitudes within 60, longitudes within 180, in order."""
    if not -60 <= south < north <= 60:
        raise ValueError(f"latitudes must be in order and within 60 degrees: {south}, {north}")
    if not (-180 <= west <= 180 and -180 <= east <= 180 and west < east):
        raise ValueError(f"longitudes must be in order and within 180 degrees: {west}, {east}")


def cropped_frames(frames: DataFrame, north: float, south: float, west: float, east: float) -> DataFrame:
    """The frames' axes after a crop: each origin is the bound and half a step; the crop stays global only if it spans all."""
    check_bounds(north, south, west, east)
    return frames.withColumns({
        "lat0": F.lit(float(south)) + F.col("dlat") / 2, "lon0": F.lit(float(west)) + F.col("dlon") / 2,
        "is_global": F.col("is_global") & F.lit(west == -180 and east == 180),
    })


def track_columns(wanted: str | list[str]) -> list[str]:
    """Columns of a preset ("basic", "all"), of one name or of a list of names."""
    if wanted == "basic":
        return list(schemas.BASIC_COLUMNS)
    if wanted == "all":
        return list(schemas.track_columns())
    names = [wanted] if isinstance(wanted, str) else wanted
    if not isinstance(names, list) or not all(isinstance(n, str) for n in names):
        raise ValueError("columns must be a name, a list of names, basic or all")
    for n in names:
        if n not in schemas.track_columns():
            raise KeyError(n)
    return names


def read_tracks(storms: DataFrame, observations: DataFrame, columns: str | list[str] = "basic") -> DataFrame:
    """(storm_idx, obs_idx, columns) of all observations within their storm's number; season as text."""
    kept = observations.join(storms, "storm_idx").where(F.col("obs_idx") < F.col("numobs"))
    return kept.select("storm_idx", "obs_idx", *[F.col(c).cast("string").alias(c) if c == "season" else F.col(c) for c in track_columns(columns)])


def image_layer(grid: DataFrame, height: int, darkest: float = 73.0, brightest: float = 223.0) -> DataFrame:
    """Pixels as they are drawn: rows flipped, values clamped and scaled to 0 to 1, warm is dark."""
    level = (F.least(F.greatest(F.col("v"), F.lit(darkest)), F.lit(brightest)) - darkest) / (brightest - darkest)
    return grid.select("t", (height - 1 - F.col("y")).alias("y"), "x", F.when(F.col("v").isNotNull(), 1 - level).alias("level"))


def write_layers(layers: DataFrame, path: str, by: str = "t") -> None:
    """Layer rows as parquet, a folder for each frame; a drawing program reads them."""
    layers.write.mode("overwrite").partitionBy(by).parquet(path)
