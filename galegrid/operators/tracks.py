"""Best tracks: lookups by name and season, half-hourly interpolation, and known storms on frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_hour_ticks(observations: DataFrame) -> DataFrame:
    """observations with tick: half hours since the storm's first observation, days cut to half hours."""
    raw = (F.col("time_days") * 48).cast("int")
    first = F.first(raw).over(Window.partitionBy("storm_idx").orderBy("obs_idx"))
    return observations.withColumn("tick", raw - first)


def season_ranges(storms: DataFrame) -> DataFrame:
    """(season, first_idx, last_idx)."""
    return storms.groupBy("season").agg(F.min("storm_idx").alias("first_idx"), F.max("storm_idx").alias("last_idx"))


def storms_by_name(storms: DataFrame, wanted: DataFrame) -> DataFrame:
    """Storms whose name is the upper case of wanted's, and whose index is in the range of wanted's season (storms of other seasons
    among them too). wanted: (name, season). None, one or several rows each."""
    ranges = season_ranges(storms)
    asked = wanted.select(F.upper("name").alias("name"), "season").join(ranges, "season").withColumnRenamed("season", "asked_season")
    inside = F.col("storm_idx").between(F.col("first_idx"), F.col("last_idx"))
    return storms.join(asked, "name").where(inside).select("asked_season", "name", "storm_idx", "season")


def find_storm(storms: DataFrame, name: str, season: int) -> list[int]:
    """Indexes of the storms of a name in a season's range; KeyError if there is none."""
    wanted = storms.sparkSession.createDataFrame([(name, season)], "name string, season int")
    found = [r["storm_idx"] for r in storms_by_name(storms, wanted).select("storm_idx").distinct().orderBy("storm_idx").collect()]
    if not found:
        raise KeyError(f"{name} {season}")
    return found


def duration(ticks: Column, key: str = "storm_idx") -> Column:
    """Number of half hours from a storm's first to its last observation, both counted."""
    return F.max(ticks).over(Window.partitionBy(key)) + 1


def _to_next(observations: DataFrame, values: list[str]) -> DataFrame:
    w = Window.partitionBy("storm_idx").orderBy("tick", "obs_idx")
    nexts = {f"next_{c}": F.lead(c).over(w) for c in ["tick", *values]}
    return observations.withColumns(nexts)


def interpolate_steps(observations: DataFrame, columns: list[str]) -> DataFrame:
    """(storm_idx, tick, columns) for each half hour: each value until the next observation. A tick that repeats gives way to its last
    observation."""
    n = _to_next(observations, []).withColumn("upto", F.coalesce(F.col("next_tick") - 1, F.col("tick")))
    return n.where("upto >= tick").select("storm_idx", F.explode(F.sequence("tick", "upto")).alias("at"), *columns).withColumnRenamed("at", "tick")


def _each_tick(n: DataFrame) -> DataFrame:
    """A row for each half hour from an observation to before the next. Its own tick is from_tick from here on: a name that the
    result has too would be taken for the result's inside array functions."""
    upto = F.coalesce(F.col("next_tick") - 1, F.col("tick"))
    return n.withColumn("at", F.explode(F.sequence(F.col("tick"), upto))).withColumnRenamed("tick", "from_tick")


def _between(a: Column, b: Column, i: Column, tick: Column, upto: Column) -> Column:
    """a at its own tick; else on the line to b, missing if either is."""
    return F.when(i == tick, a).otherwise(a + (b - a) * (i - tick) / (upto - tick))


def _around(a: Column, b: Column, i: Column, tick: Column, upto: Column) -> Column:
    """_between of degrees, the shorter way round, from -180 to 180 (excluded); halves of the circle go east. a as it is at its own tick."""
    way = F.pmod(b - a + 180, F.lit(360.0)) - 180
    way = F.when(way == -180, F.lit(180.0)).otherwise(way)
    return F.when(i == tick, a).otherwise(F.pmod(a + way * (i - tick) / (upto - tick) + 180, F.lit(360.0)) - 180)


def interpolate_numbers(observations: DataFrame, columns: list[str], degrees: tuple[str, ...] = ()) -> DataFrame:
    """(storm_idx, tick, columns) for each half hour, linear between observations; a missing end leaves the ticks between missing, and
    values at observations stay as they are. degrees: columns that go the shorter way round the circle; literally, none does, so a storm that crosses
    the date line passes through 0."""
    n = _to_next(observations, columns).where("next_tick is null or next_tick > tick")
    each = _each_tick(n)
    line = {c: (_around if c in degrees else _between)(F.col(c), F.col(f"next_{c}"), F.col("at"), F.col("from_tick"), F.col("next_tick")) for c in columns}
    return each.select("storm_idx", F.col("at").alias("tick"), *[e.alias(c) for c, e in line.items()])


def interpolate_quadrants(observations: DataFrame, columns: list[str]) -> DataFrame:
    """interpolate_numbers for arrays of four, quadrant by quadrant."""
    n = _to_next(observations, columns).where("next_tick is null or next_tick > tick")
    each = _each_tick(n)

    def line(c: str) -> Column:
        mixed = F.zip_with(c, f"next_{c}", lambda a, b: _between(a, b, F.col("at"), F.col("from_tick"), F.col("next_tick")))
        return F.when(F.col("at") == F.col("from_tick"), F.col(c)).otherwise(mixed).alias(c)

    return each.select("storm_idx", F.col("at").alias("tick"), *[line(c) for c in columns])


def interpolate_times(observations: DataFrame, cut: int = 5) -> DataFrame:
    """(storm_idx, tick, iso_time): the half hours of each three-hourly observation's next three hours within its day, each once, in
    order of first appearance, without the last cut."""
    hour = F.hour(F.to_timestamp("iso_time"))
    steps = F.sequence(hour * 2, F.least(F.lit(24), hour + 3) * 2 - 1)
    halves = observations.select("storm_idx", "obs_idx", F.substring("iso_time", 1, 10).alias("day"), F.explode(steps).alias("half"))
    text = F.concat("day", F.lit(" "), F.lpad(F.floor(F.col("half") / 2).cast("string"), 2, "0"), F.when(F.col("half") % 2 == 0, ":00:00").otherwise(":30:00"))
    once = halves.withColumn("iso_time", text).groupBy("storm_idx", "iso_time").agg(F.min(F.struct("obs_idx", "half")).alias("seen"))
    w = Window.partitionBy("storm_idx")
    placed = once.withColumns({"tick": F.row_number().over(w.orderBy("seen")) - 1, "n": F.count(F.lit(1)).over(w)})
    return placed.where(F.col("tick") < F.col("n") - cut).select("storm_idx", "tick", "iso_time")


def times_of_ticks(observations: DataFrame) -> DataFrame:
    """(storm_idx, tick, iso_time): the time of each half hour from a storm's first observation to its last, so as many as interpolate_numbers gives, whatever
    gaps and odd hours there are (interpolate_times, the literal way, knows three-hourly observations alone). A storm's clock starts at its first
    observation's half hour. Needs tick (half_hour_ticks)."""
    each = interpolate_numbers(observations, [])
    micros = F.unix_micros(F.to_timestamp("iso_time"))
    start = observations.where("tick = 0").groupBy("storm_idx").agg(F.min(micros - F.pmod(micros, F.lit(1_800_000_000))).alias("start"))
    text = F.date_format(F.timestamp_micros(F.col("start") + F.col("tick").cast("long") * 1_800_000_000), "yyyy-MM-dd HH:mm:ss")
    return each.join(start, "storm_idx").select("storm_idx", "tick", text.alias("iso_time"))


def interpolate_track(observations: DataFrame, steps: list[str], numbers: list[str], quadrants: list[str], degrees: tuple[str, ...] = ()) -> DataFrame:
    """All columns of a track on the half-hour clock, by each one's kind; time follows from the tick."""
    out = interpolate_numbers(observations, numbers, degrees)
    if steps:
        out = out.join(interpolate_steps(observations, steps), ["storm_idx", "tick"], "left")
    return out.join(interpolate_quadrants(observations, quadrants), ["storm_idx", "tick"], "left") if quadrants else out


def known_storms(frames: DataFrame, storms: DataFrame, observations: DataFrame, first_storm: int = 11300) -> DataFrame:
    """(t, storm_idx, name, y, x): where the archive's storms from first_storm on are in each frame. At three-hourly hours the storms
    observed at just that time are looked up (the first such observation); other frames repeat the last list; before the first there is
    none."""
    from ..functions.axes import coordinate_to_pixel

    late = observations.where(F.col("storm_idx") >= first_storm)
    first = late.groupBy("storm_idx", "iso_time").agg(F.min_by(F.struct("lat", "lon"), "obs_idx").alias("place"))
    looked = frames.withColumn("iso_time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).withColumn("is_look", F.hour("ts") % 3 == 0)
    # each frame takes the list of the last frame that looked
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    source = looked.withColumn("look", F.last(F.when(F.col("is_look"), F.struct("iso_time", "lat0", "dlat", "lon0", "dlon")), ignorenulls=True).over(w))
    at = source.where("look is not null").select("t", "look", F.col("look.iso_time").alias("iso_time"))
    return (
        at.join(first, "iso_time").join(storms.select("storm_idx", "name"), "storm_idx")
        .select(
            "t", "storm_idx", "name",
            coordinate_to_pixel(F.col("place.lat"), F.col("look.lat0"), F.col("look.dlat")).alias("y"),
            coordinate_to_pixel(F.col("place.lon"), F.col("look.lon0"), F.col("look.dlon")).alias("x"),
        )
    )


def active_flags(points: DataFrame, window: int = 48) -> DataFrame:
    """points (system_id, t, positive) with active: whether one of the last window points was positive, now and ever since."""
    w = Window.partitionBy("system_id").orderBy("t")
    recent = points.withColumn("recent", F.bool_or("positive").over(w.rowsBetween(1 - window, 0)))
    return recent.withColumn("active", F.bool_and("recent").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("recent")
