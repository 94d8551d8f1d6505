"""The catalogue of frames: numbering by time, guards, and folders that a track join reads."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from galegrid.sources import archive, readers

START = dt.datetime(2022, 9, 1)


def store(spark, path, steps, lats, lons, hours=1.0, name="Tb"):
    """Frames at the given steps; a cell's value is 1000 * step + 10 * row + column."""
    times = spark.createDataFrame([(int(s), START + dt.timedelta(hours=hours * s)) for s in steps], "s int, time timestamp_ntz")
    rows, columns = ([(i, float(v)) for i, v in enumerate(a)] for a in (lats, lons))
    cells = times.crossJoin(spark.createDataFrame(rows, "i int, lat double")).crossJoin(spark.createDataFrame(columns, "j int, lon double"))
    cells = cells.select(F.to_date("time").alias("day"), "time", "lat", "lon", (1000.0 * F.col("s") + 10 * F.col("i") + F.col("j")).alias(name))
    cells.repartition(4, "day").write.partitionBy("day").parquet(f"{path}/cells")
    return f"{path}/cells"


AXIS = [-1.0, -0.5, 0.0, 0.5]


def test_numbers_are_those_of_times(spark, tmp_path):
    """With a frame missing, the catalogue, the reader and the time index still name the same frames, or raise."""
    path = store(spark, str(tmp_path), [0, 1, 2, 4, 5], AXIS, AXIS)
    with pytest.raises(ValueError, match="missing"):
        archive.build_catalogue(spark, path, f"{tmp_path}/c")
    a = archive.build_catalogue(spark, path, f"{tmp_path}/c", gaps="missing")
    assert a.time == archive.Axis(START.replace(tzinfo=dt.UTC).timestamp(), 3600.0, 6) and a.lat == archive.Axis(-1.0, 0.5, 4)
    assert sorted(r.t for r in a.frames.collect()) == [0, 1, 2, 4, 5] and [r.t for r in a.missing.collect()] == [3]
    assert {(r.t, r.y, r.x): r.v for r in a.cells().collect()} == {(t, y, x): 1000.0 * t + 10 * y + x for t in (0, 1, 2, 4, 5) for y in range(4) for x in range(4)}
    points = spark.createDataFrame([(k, f"2022-09-01 0{k}:00:00", 0.0, 0.0) for k in range(6)], "point_id int, iso_time string, lat double, lon double")
    found = {}
    for r in a.nearest_patches(points, 1).collect():
        found.setdefault(r.point_id, []).append(r.v)
    assert {k: sorted(v, key=lambda x: (x is None, x)) for k, v in found.items()} == {k: [None] * 4 if k == 3 else [1000.0 * k + c for c in (11, 12, 21, 22)] for k in range(6)}
    # the reader by itself
    index = spark.read.parquet(path).select("time", F.expr("int((lat + 1) * 2)").alias("lat"), F.expr("int((lon + 1) * 2)").alias("lon"), "Tb")
    index.write.parquet(f"{tmp_path}/index")
    with pytest.raises(PySparkException, match="a frame is missing"):
        readers.read_infrared(spark, f"{tmp_path}/index").collect()
    got = {(r.t, r.v) for r in readers.read_infrared(spark, f"{tmp_path}/index", gaps="missing").collect()}
    assert {t for t, _ in got} == {0, 1, 2, 4, 5} and all(v // 1000 == t for t, v in got)
    again = archive.open_archive(spark, path, f"{tmp_path}/c")
    assert (again.lat, again.lon, again.time) == (a.lat, a.lon, a.time)


def test_guards(spark, tmp_path):
    crooked = store(spark, f"{tmp_path}/1", [0, 1], [-1.0, -0.5, 0.1, 0.5], AXIS)
    with pytest.raises(ValueError, match="lat axis"):
        archive.build_catalogue(spark, crooked, f"{tmp_path}/c1")
    flat = store(spark, f"{tmp_path}/2", [0, 1], AXIS, [0.0, 0.6, 1.2])
    with pytest.raises(ValueError, match="square"):
        archive.build_catalogue(spark, flat, f"{tmp_path}/c2")
    assert archive.build_catalogue(spark, flat, f"{tmp_path}/c2", square=False).lon.n == 3
    uneven = store(spark, f"{tmp_path}/3", [0, 2, 5], AXIS, AXIS)
    with pytest.raises(ValueError, match="whole steps"):
        archive.build_catalogue(spark, uneven, f"{tmp_path}/c3", gaps="missing")
    a = archive.build_catalogue(spark, store(spark, f"{tmp_path}/4", [0, 1], AXIS, AXIS), f"{tmp_path}/c4")
    late = spark.createDataFrame([(1, "2022-09-01 05:00:00", 0.0, 0.0)], "point_id int, iso_time string, lat double, lon double")
    with pytest.raises(PySparkException, match="no frame is near"):
        a.nearest_patches(late, 1).collect()
    assert a.nearest_patches(late, 1, beyond="missing").collect() == []
    with pytest.raises(ValueError):
        archive.build_catalogue(spark, flat, f"{tmp_path}/c5", gaps="fill")
    one = archive.build_catalogue(spark, store(spark, f"{tmp_path}/6", [0], AXIS, AXIS), f"{tmp_path}/c6")
    assert one.time.n == 1 and {r.t for r in one.cells().collect()} == {0}


def test_half_way_winds(spark, tmp_path):
    a = archive.build_catalogue(spark, store(spark, str(tmp_path), range(4), AXIS, AXIS, name="u"), f"{tmp_path}/c", archive.Layout("u"))
    points = spark.createDataFrame([(1, "2022-09-01 01:30:00", 0.0, 0.0), (2, "2022-09-01 03:00:00", 0.0, 0.0)], "point_id int, iso_time string, lat double, lon double")
    found = {(r.point_id, r.py, r.px): r.v for r in a.wind_patches(points, 1).collect()}
    assert found == {(p, 1 - i, j): base + 10 * (1 + i) + 1 + j for p, base in ((1, 1500.0), (2, 3000.0)) for i in (0, 1) for j in (0, 1)}
    odd = points.withColumn("iso_time", F.lit("2022-09-01 01:20:00"))
    with pytest.raises(PySparkException, match="half-way"):
        a.wind_patches(odd, 1).collect()


def test_a_track_reads_the_folders_that_it_needs(spark, tmp_path):
    """1,000 date folders, a track of three days: three folders are read."""
    path = store(spark, str(tmp_path), range(1000), [0.0, 0.5], [0.0, 0.5], hours=24)
    a = archive.build_catalogue(spark, path, f"{tmp_path}/c")
    days = [(k, str(START + dt.timedelta(days=500 + k)), 0.0, 0.0) for k in range(3)]
    found = a.nearest_patches(spark.createDataFrame(days, "point_id int, iso_time string, lat double, lon double"), 1)
    assert sorted({int(r.v // 1000) for r in found.collect() if r.v}) == [500, 501, 502]
    plan = found._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "dynamicpruning" in text.lower()

    def scans(node):
        here = [node] if "FileSourceScan" in node.getClass().getSimpleName() else []
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else [node.plan()] if "QueryStage" in node.getClass().getSimpleName() else []
        below = node.children()
        return here + [s for n in [*(below.apply(i) for i in range(below.size())), *inner] for s in scans(n)]

    read = [int(s.metrics().apply("numFiles").value()) for s in scans(plan) if "cells" in s.simpleString(1000) and "numFiles" in s.metrics().keys().mkString(" ")]
    assert read == [3]


def test_systems_of_an_archive(spark, small_dir, tmp_path):
    """The job over some days of an archive, with a mask of whole degrees, equals a fold over whole frames."""
    from test_goldens import golden_tracker, images_of, points_of

    from galegrid.operators import dav, stencil
    from galegrid.plans import catalogue, jobs
    from galegrid.sources import fixtures as fx

    side = fx.SIDE
    grid = fx.grid_cores(spark, small_dir).withColumn("v", F.when((7 * F.col("t") + 31 * F.col("y") + 17 * F.col("x")) % 11 != 0, F.col("v"))).select("t", "y", "x", "v")
    time = F.lit("2022-09-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=12 * (F.col("t") + 3))
    cells = [grid.select((F.col("t") + k).alias("t"), "y", "x", "v") for k in (-3, 0)]  # frames before, which aren't asked for
    stored = cells[0].where("t < 0").unionByName(cells[1]).select(F.to_date(time).alias("day"), time.alias("time"), (F.col("y") * 0.25 - 8).alias("lat"), (F.col("x") * 0.25 - 8).alias("lon"), F.coalesce("v", F.lit(float("nan"))).alias("Tb"))
    stored.repartition(2, "day").write.partitionBy("day").parquet(f"{tmp_path}/cells")
    found = archive.build_catalogue(spark, f"{tmp_path}/cells", f"{tmp_path}/c")
    assert found.time.n == 10
    land = spark.createDataFrame([(i, j, (i * 18 + j) % 5 == 0) for i in range(18) for j in range(18)], "lat_idx int, lon_idx int, is_land boolean")
    timed = stencil.temporal_fill(grid)
    davs, temps = images_of(dav.dav_map(timed, 10, side, side), "dav", 7, side), images_of(stencil.spatial_fill(timed, side), "v", 7, side)
    is_land = lambda y, x: (round(0.25 * y - 8 + 8.5) * 18 + round(0.25 * x - 8 + 8.5)) % 5 == 0
    want = golden_tracker(temps, davs, is_land, catalogue.core_settings())
    got = jobs.find_systems_in(found, land, first="2022-09-02 12:00:00", in_km=10.0, radius_km=100.0, mask=(-8.5, 1.0, -8.5, 1.0, 18)).collect()
    assert len(want) > 5 and sorted((r.t - 3, r.y, r.x, r.positive, r.active) for r in got) == sorted((p[1], p[2], p[3], p[5], p[6]) for p in want)
    with pytest.raises(ValueError, match="no frame"):
        jobs.find_systems_in(found, land, first="2030-01-01 00:00:00")
    with pytest.raises(ValueError, match="axes"):
        jobs.Job(4, 4, mask=(0.0, 1.0, 0.0, 1.0, 9))
    # axes after a crop and a resampling
    look = jobs.Job(100, 200, bounds=(10.0, -10.0, -20.0, 20.0), axes=(-50.0, -100.0, 0.5, 0.5), mask=(-89.5, 1.0, -179.5, 1.0, 360)).lookup()
    assert (look.lat0, look.lon0, look.dlat, look.dlon) == (-10 + 0.25 + 0.5 / 2.5, -20 + 0.25 + 0.5 / 2.5, 1.25, 1.25)
