"""Deterministic domain relations made from the driver's tables (which hold no rasters or tracks)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 64
CORE_PERIOD = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    return e.withColumn("v", 250 + 60 * F.col("e").cast("double"))


def grid8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 frame for each vector."""
    return _cells(spark, sf_dir).select(F.col("vec_id").cast("int").alias("t"), F.expr("int(pos div 8)").alias("y"), (F.col("pos") % 8).alias("x"), "v")


def grid64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors stacked to a 64 x 64 frame; whole frames only."""
    t = F.expr("int(vec_id div 64)")
    whole = table(spark, sf_dir, "embeddings").groupBy(t.alias("t")).count().where("count = 64").select("t")
    cells = _cells(spark, sf_dir).select(t.alias("t"), (F.col("vec_id") % 64).cast("int").alias("y"), F.col("pos").alias("x"), "v")
    return cells.join(whole, "t", "left_semi")


def grid_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid64(spark, sf_dir).withColumn("v", F.when((7 * F.col("t") + 31 * F.col("y") + 17 * F.col("x")) % 11 != 0, F.col("v")))


def grid_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cold cores that move towards each other over seven frames, again and again, on the noise of grid64."""
    p, y, x = F.col("t") % CORE_PERIOD, F.col("y"), F.col("x")

    def core(cy: Column, cx: Column) -> Column:
        return 70 * F.exp(-((y - cy) * (y - cy) + (x - cx) * (x - cx)) / 128.0)

    noise = (F.col("v") - 250) / 60
    return grid64(spark, sf_dir).withColumn("v", 285 + 20 * noise - core(18 + 2 * p, 16 + 2 * p) - core(46 - p, F.lit(47)))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = grid64(spark, sf_dir).select("t").distinct()
    return t.select(
        "t", (F.lit("2022-09-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("t") * 30)).alias("ts"),
        F.lit(-8.0).alias("lat0"), F.lit(-8.0).alias("lon0"), F.lit(0.25).alias("dlat"), F.lit(0.25).alias("dlon"),
        F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(10.0).alias("res_km"), F.lit(False).alias("is_global"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(point_id, t, y, x)."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        e.alias("point_id"), (e % 7).cast("int").alias("t"), (e % 64).cast("int").alias("y"), (e * 13 % 64).cast("int").alias("x")
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hourly observations of a storm for each user of events; every eleventh wind is missing."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("obs_idx", F.row_number().over(w) - 1)
    start = F.lit("2022-09-01 00:00:00").cast("timestamp_ntz")
    return e.select(
        F.col("user_id").cast("int").alias("storm_idx"), "obs_idx", (F.col("obs_idx") / 8.0 + 100.0).alias("time_days"),
        F.date_format(start + F.make_dt_interval(hours=3 * F.col("obs_idx")), "yyyy-MM-dd HH:mm:ss").alias("iso_time"),
        F.col("event_type").alias("nature"), (F.col("event_id") % 61 * 0.25 - 7.5).alias("lat"), (F.col("event_id") * 7 % 59 * 0.25 - 7.25).alias("lon"),
        F.when(F.col("event_id") % 11 != 0, F.col("value").cast("double")).alias("usa_wind"), "event_id",
    )


def storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    return o.groupBy("storm_idx").agg(F.min_by("nature", "obs_idx").alias("first"), F.count(F.lit(1)).cast("int").alias("numobs")).select(
        "storm_idx", F.lpad(F.col("storm_idx").cast("string"), 6, "0").alias("sid"), (2000 + F.col("storm_idx") % 20).alias("season"), F.upper("first").alias("name"), "numobs"
    )


def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(storm_idx, obs_idx, tick, radii) of each order's lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    values = [F.col(c).cast("double") / d for c, d in (("l_quantity", 1.0), ("l_extendedprice", 1000.0), ("l_discount", 0.01), ("l_tax", 0.01))]
    lines = table(spark, sf_dir, "lineitem").withColumn("obs_idx", F.row_number().over(w) - 1)
    return lines.select(F.col("l_orderkey").alias("storm_idx"), "obs_idx", (6 * F.col("obs_idx")).alias("tick"), F.array(*values).alias("radii"))


def landmask(spark: SparkSession) -> DataFrame:
    return spark.range(SIDE * SIDE).select(
        F.expr("int(id div 64)").alias("lat_idx"), (F.col("id") % 64).cast("int").alias("lon_idx"), (F.col("id") % 5 == 0).alias("is_land")
    )
