"""The whole job, from frames to systems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dav, patches, stencil
from ..sources import readers
from ..sources.archive import Archive
from ..streaming import tracker


@dataclass(frozen=True)
class Job:
    """height, width: of the frames as read, in pixels of in_km; the work is done in pixels of out_km. radius_km: of the variance's disc.
    rows, columns: half-open pixel ranges to keep, None for all; or bounds, (north, south, west, east) in degrees, on frames with axes (lat0,
    lon0, dlat, dlon): the first cell's place and the steps. mask: (first latitude, step, first longitude, step, columns) of a land mask with axes of its own, which
    also needs axes; without it the mask has the pixels that the work is done in. checked: values must be temperatures in kelvin."""

    height: int
    width: int
    in_km: float = 4.0
    out_km: float = 10.0
    radius_km: float = 300.0
    rows: tuple[int, int] | None = None
    columns: tuple[int, int] | None = None
    bounds: tuple[float, float, float, float] | None = None
    axes: tuple[float, float, float, float] | None = None
    mask: tuple[float, float, float, float, int] | None = None
    checked: bool = True
    is_global: bool = False

    def __post_init__(self) -> None:
        for name in ("in_km", "out_km", "radius_km"):
            if not isinstance(getattr(self, name), (int, float)) or getattr(self, name) <= 0:
                raise ValueError(f"{name} must be a number over 0")
        if self.bounds is not None:
            if self.axes is None or self.rows or self.columns:
                raise ValueError("bounds need axes, and stand in place of rows and columns")
            readers.check_bounds(*self.bounds)
        if self.mask is not None and self.axes is None:
            raise ValueError("a mask with axes of its own needs the frames' axes")

    def kept_pixels(self) -> tuple[tuple[int, int], tuple[int, int]]:
        """The half-open ranges of rows and columns that are kept."""
        if self.bounds is None:
            return self.rows or (0, self.height), self.columns or (0, self.width)
        north, south, west, east = self.bounds
        lat0, lon0, dlat, dlon = self.axes
        pixel = lambda c, first, step, n: min(max(round((c - first) / step), 0), n)
        return (pixel(south, lat0, dlat, self.height), pixel(north, lat0, dlat, self.height)), (pixel(west, lon0, dlon, self.width), pixel(east, lon0, dlon, self.width))

    def lookup(self) -> patches.LandLookup | None:
        """How the pixels that the work is done in find their cell in the mask: their axes are those after the crop and the resampling."""
        if self.mask is None:
            return None
        lat0, lon0, dlat, dlon = self.axes
        (south, _), (west, _) = self.kept_pixels()
        if self.bounds is not None:
            lat0, lon0 = self.bounds[1] + dlat / 2, self.bounds[2] + dlon / 2
        else:
            lat0, lon0 = lat0 + south * dlat, lon0 + west * dlon
        larger = self.out_km / self.in_km
        if larger != 1:
            lat0, lon0, dlat, dlon = lat0 + dlat / larger, lon0 + dlon / larger, dlat * larger, dlon * larger
        return patches.LandLookup(lat0, dlat, lon0, dlon, *self.mask)


def find_systems_in(found: Archive, land: DataFrame, first: str | None = None, last: str | None = None, tracking: dict | None = None, **options) -> DataFrame:
    """find_systems over an archive's frames from first to last (ISO times, both counted; None: to the archive's end), of which alone the date folders are read.
    Size, axes and whether the frames go round come from the catalogue. options: other fields of Job; tracking: settings of tracker.Settings."""
    frames = found.frames.select("t", "ts")
    if first is not None:
        frames = frames.where(F.col("ts") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        frames = frames.where(F.col("ts") <= F.lit(last).cast("timestamp_ntz"))
    start = frames.agg(F.min("t")).first()[0]
    if start is None:
        raise ValueError(f"the archive has no frame between {first} and {last}")
    bounds = options.get("bounds")
    whole = abs(found.lon.n * found.lon.step - 360) < 1e-6 and not options.get("columns") and (bounds is None or bounds[2:] == (-180, 180))
    axes = (found.lat.first, found.lon.first, found.lat.step, found.lon.step)
    job = Job(**{"height": found.lat.n, "width": found.lon.n, "axes": axes, "is_global": whole} | options)
    return find_systems(found.cells(frames).drop("ts"), land, job, first=start + 1, **(tracking or {}))


def find_systems(grid: DataFrame, land: DataFrame, job: Job, first: int = 1, **tracking) -> DataFrame:
    """Track points (tracker.POINT_SCHEMA) of the systems in a grid (t, y, x, v): checked, cropped, resampled, filled in time, its variance
    mapped, folded from the second frame on (first: its number). tracking: other settings of tracker.Settings. Disc means see frames filled in space, as the
    variances do; a cell without a value has no variance."""
    if job.checked:
        grid = readers.checked_range(grid)
    height, width = job.height, job.width
    (south, north), (west, east) = job.kept_pixels()
    if (south, north, west, east) != (0, height, 0, width):
        grid, height, width = readers.crop(grid, north, south, west, east), north - south, east - west
    factor = job.in_km / job.out_km
    if factor != 1:
        grid = stencil.resample_bilinear(grid, height, width, factor)
        height, width = int(height * factor), int(width * factor)
    timed = stencil.temporal_fill(grid)
    values = dav.dav_map(timed, int(job.radius_km // job.out_km), height, width)
    settings = tracker.Settings(height=height, width=width, res_km=job.out_km, is_global=job.is_global, **tracking)
    events = tracker.frame_events(stencil.spatial_fill(timed, width), values, land, settings, lookup=job.lookup())
    return tracker.track(events, settings, first)
