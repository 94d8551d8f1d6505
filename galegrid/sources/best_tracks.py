"""A reader of best tracks with options, over the storm and observation relations."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tracks
from . import readers, schemas


@dataclass(frozen=True)
class BestTracks:
    """storms and observations as in schemas.STORM and schemas.OBSERVATION. interpolating: tracks on the half-hour clock instead of the
    archive's times. columns: a preset, a name or a list. Options don't change in place: with_settings makes another reader."""

    storms: DataFrame
    observations: DataFrame
    interpolating: bool = True
    columns: str | list[str] = "basic"

    def __post_init__(self) -> None:
        if not isinstance(self.interpolating, bool):
            raise ValueError(f"interpolating must be True or False, not {self.interpolating!r}")
        readers.track_columns(self.columns)

    def with_settings(self, interpolating: bool | None = None, columns: str | list[str] | None = None) -> BestTracks:
        return replace(self, interpolating=self.interpolating if interpolating is None else interpolating, columns=self.columns if columns is None else columns)

    def __repr__(self) -> str:
        return f"BestTracks of {self.storms.count()} storms"

    def _indexes(self, identifier: tuple) -> list[int]:
        """One index, a name and a season, or either as a single tuple."""
        if len(identifier) == 1 and isinstance(identifier[0], tuple):
            identifier = identifier[0]
        if len(identifier) == 1 and isinstance(identifier[0], int) and not isinstance(identifier[0], bool):
            if self.storms.where(F.col("storm_idx") == identifier[0]).isEmpty():
                raise IndexError(f"no storm {identifier[0]}")
            return [identifier[0]]
        if len(identifier) == 2 and isinstance(identifier[0], str) and isinstance(identifier[1], int):
            return tracks.find_storm(self.storms, *identifier)
        raise ValueError("a storm is an index, or a name and a season")

    def read(self, *identifier) -> DataFrame:
        """The track of a storm, or of all storms that share a name in a season's range."""
        wanted = self._indexes(identifier)
        return self._tracks(self.storms.where(F.col("storm_idx").isin(wanted)))

    def read_all(self) -> DataFrame:
        return self._tracks(self.storms)

    def _tracks(self, storms: DataFrame) -> DataFrame:
        """(storm_idx, tick, columns) if interpolating, else (storm_idx, obs_idx, columns)."""
        columns = readers.track_columns(self.columns)
        if not self.interpolating:
            return readers.read_tracks(storms, self.observations, self.columns)
        kinds = schemas.track_columns()
        of = lambda kind: [c for c in columns if kinds[c] == kind and c != "iso_time"]
        seen = self.observations.join(storms.select("storm_idx", "numobs"), "storm_idx").where(F.col("obs_idx") < F.col("numobs"))
        ticks = tracks.half_hour_ticks(seen)
        clock = tracks.interpolate_track(ticks, of("step"), of("number"), of("quadrants"))
        if "iso_time" in columns:
            clock = clock.join(tracks.interpolate_times(seen), ["storm_idx", "tick"], "left")
        one = storms.select("storm_idx", *[F.col(c).cast("string").alias(c) for c in of("constant")])
        return clock.join(one, "storm_idx").select("storm_idx", "tick", *columns)
