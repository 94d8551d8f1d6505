"""Relations of the engine. Missing is null, never NaN: readers turn one into the other."""

from __future__ import annotations

GRID = "t int, ts timestamp_ntz, y int, x int, v double"
FRAMES = "t int, ts timestamp_ntz, lat0 double, lon0 double, dlat double, dlon double, height int, width int, res_km double, is_global boolean"
WIND = "t int, ts timestamp_ntz, y int, x int, u double, v double"
STORM = "storm_idx int, sid string, season int, name string, numobs int"
OBSERVATION = (
    "storm_idx int, obs_idx int, time_days double, iso_time string, basin string, nature string, lat double, lon double,"
    " dist2land double, usa_wind double, usa_r34 array<double>, usa_r50 array<double>, usa_r64 array<double>"
)
LAND = "lat_idx int, lon_idx int, is_land boolean"
TRACK_POINTS = "system_id string, t int, y int, x int, cdav double, positive boolean"
SYSTEMS = "system_id string, time_start int, active boolean"

#: Fixed value: the small preset.
BASIC_COLUMNS = ["name", "season", "iso_time", "lat", "lon", "usa_wind"]


def columns_of(relation: str) -> dict[str, str]:
    return dict(field.strip().split(" ", 1) for field in relation.split(","))


def track_columns() -> dict[str, str]:
    """What a track can be asked for, in the relations' order, and how it goes from one observation to the next: constant (the storm's),
    step (texts), number, quadrants."""
    storm = {c: "constant" for c in columns_of(STORM) if c not in ("storm_idx", "numobs")}
    kinds = {"string": "step", "double": "number", "array<double>": "quadrants"}
    return storm | {c: kinds[k] for c, k in columns_of(OBSERVATION).items() if c not in ("storm_idx", "obs_idx", "time_days")}
