"""Operators against NumPy written from the formulae, properties, and edge cases."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galegrid.functions import axes, geometry, masks
from galegrid.operators import clusters, dav, patches, stencil, tiles, tracks
from galegrid.sources import readers
from galegrid.streaming import tracker

RNG = np.random.default_rng(7)


def frame_of(spark, images):
    """Images (t, y, x) as a grid; NaN is missing."""
    images = np.asarray(images, dtype=float)
    t, y, x = np.indices(images.shape)
    rows = [(int(a), int(b), int(c), None if math.isnan(v) else float(v)) for a, b, c, v in zip(t.ravel(), y.ravel(), x.ravel(), images.ravel(), strict=True)]
    return spark.createDataFrame(rows, "t int, y int, x int, v double")


def array_of(df, column, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[column] is not None:
            out[r["t"], r["y"], r["x"]] = r[column]
    return out


def fold(d):
    return np.where(d < -270, d + 360, np.where(d < -90, -d - 180, np.where(d > 270, d - 360, np.where(d > 90, 180 - d, d))))


def golden_dav(image, r):
    dy, dx = np.gradient(image)
    g = np.where((dy == 0) & (dx == 0), 180.0, np.degrees(np.arctan2(dy, -dx)) % 360)
    h, w = image.shape
    out = np.full((h, w), np.nan)
    for y in range(h):
        for x in range(w):
            d = [fold(g[y + j, x + i] - (np.degrees(np.arctan2(-j, i)) % 360 if (j, i) != (0, 0) else 0.0))
                 for j in range(-r, r) for i in range(-r, r) if j * j + i * i < r * r and 0 <= y + j < h and 0 <= x + i < w]
            if len(d) > 1:
                out[y, x] = np.var(d, ddof=1)
    return out


@pytest.mark.parametrize("cells", [1, None])
def test_variance_map(spark, cells):
    image = RNG.normal(250, 10, (20, 70))
    found = array_of(dav.dav_map(frame_of(spark, [image]), 4, 20, 70, smooth=False, cells=cells), "dav", (1, 20, 70))[0]
    np.testing.assert_allclose(found, golden_dav(image, 4), rtol=1e-6)


def test_skipped_cells_cost_nothing(spark):
    """The cells that are left have the values of the whole map, in tiles where they are few and where they are many; the others are null."""
    images = RNG.normal(250, 10, (2, 70, 131))
    images[0, 5, 9:30] = np.nan
    grid = frame_of(spark, images)
    whole = array_of(dav.dav_map(grid, 6, 70, 131), "dav", images.shape)
    for kept in ("(y = 3 and x = 129) or (y = 66 and x = 2)", "x < 60 and t = 1", "y < 0", "y >= 0"):
        some = array_of(dav.dav_map(grid, 6, 70, 131, skip=grid.select("t", "y", "x", F.expr(f"not ({kept})").alias("skip"))), "dav", images.shape)
        left = array_of(grid.select("t", "y", "x", F.expr(f"double({kept})").alias("dav")), "dav", images.shape) == 1
        np.testing.assert_allclose(some[left], whole[left], rtol=1e-9)
        assert np.isnan(some[~left]).all()


def test_runs_equal_shifts():
    """Sums and minima of runs of rows, with ties and missing values, against one pass for each cell of the disc."""
    for r in (1, 2, 7):
        values = np.round(RNG.random((2, 20 + 2 * r, 23 + 2 * r)) * 9)
        values[RNG.random(values.shape) < 0.3] = np.inf
        values[1, : 12 + r] = np.inf
        offsets = patches._half_disc(r)
        runs = tiles.runs_of(*map(np.array, zip(*offsets, strict=True)))
        stack = np.stack([values[w] for w in tiles.windows((20, 23), r, offsets)])
        least, dy, dx = tiles.run_minima(values, runs, r, (20, 23))
        first = stack.argmin(axis=0)
        assert (least == stack.min(axis=0)).all()
        some = np.isfinite(least)
        assert (dy[some] == np.array([o[0] for o in offsets])[first][some]).all() and (dx[some] == np.array([o[1] for o in offsets])[first][some]).all()
        there = np.isfinite(values).astype(float)
        assert (tiles.run_sums(there, runs, r, (20, 23)) == sum(there[w] for w in tiles.windows((20, 23), r, offsets))).all()


def test_radial_bowl_has_no_variance_and_constants_do_not_matter(spark):
    y, x = np.mgrid[-10:11, -10:11]
    bowl = (y**2 + x**2).astype(float)
    both = array_of(dav.dav_map(frame_of(spark, [bowl, bowl + 50]), 5, 21, 21, smooth=False, cells=1), "dav", (2, 21, 21))
    assert both[0, 10, 10] < 1e-9
    np.testing.assert_allclose(both[0], both[1], atol=1e-6)


def test_one_cell_disc_has_no_variance(spark):
    assert dav.dav_map(frame_of(spark, [np.arange(9.0).reshape(3, 3)]), 1, 3, 3, smooth=False, cells=1).where("dav is not null").count() == 0
    with pytest.raises(ValueError):
        dav.dav_map(frame_of(spark, [np.zeros((3, 3))]), 1.5, 3, 3)


def golden_blur(image, edge):
    w = stencil.gaussian_weights(2.0)
    padded = np.pad(image, 8, mode={"reflect": "symmetric", "nearest": "edge"}[edge])
    down = sum(k * padded[i : i + image.shape[0], :] for i, k in enumerate(w))
    return sum(k * down[:, i : i + image.shape[1]] for i, k in enumerate(w))


@pytest.mark.parametrize("edge", ["reflect", "nearest"])
def test_blur(spark, edge):
    image = RNG.normal(250, 10, (11, 9))
    found = array_of(stencil.gaussian_blur(frame_of(spark, [image]), 11, 9, 2.0, edge), "v", (1, 11, 9))[0]
    np.testing.assert_allclose(found, golden_blur(image, edge), rtol=1e-12)


def test_fills(spark):
    images = RNG.normal(250, 10, (4, 6, 5))
    images[RNG.random(images.shape) < 0.3] = np.nan
    images[1, 2] = np.nan
    images[3] = np.nan
    images[0, 0, 0] = images[0, 5, 4] = np.nan
    flat = array_of(stencil.spatial_fill(frame_of(spark, images), 5), "v", images.shape)
    for i in range(3):
        v = images[i].ravel()
        ok = ~np.isnan(v)
        np.testing.assert_allclose(flat[i].ravel(), np.interp(np.arange(30), np.flatnonzero(ok), v[ok]))
    assert np.isnan(flat[3]).all()
    timed = array_of(stencil.temporal_fill(frame_of(spark, images)), "v", images.shape)
    want = images.copy()
    for i in (1, 2):
        with np.errstate(all="ignore"):
            mean = np.where(np.isnan(images[i - 1]), images[i + 1], np.where(np.isnan(images[i + 1]), images[i - 1], (images[i - 1] + images[i + 1]) / 2))
        want[i] = np.where(np.isnan(images[i]), mean, images[i])
    np.testing.assert_allclose(timed, want)


def test_resampling_keeps_planes_and_spreads_gaps(spark):
    y, x = np.mgrid[0:10, 0:20]
    plane = 3.0 * y + 2.0 * x
    out = array_of(stencil.resample_bilinear(frame_of(spark, [plane]), 10, 20, 0.4), "v", (1, 4, 8))[0]
    np.testing.assert_allclose(out, 3 * ((np.arange(4) + 0.5) * 2.5 - 0.5)[:, None] + 2 * ((np.arange(8) + 0.5) * 2.5 - 0.5)[None, :])
    plane[0, 0] = np.nan
    assert np.isnan(array_of(stencil.resample_bilinear(frame_of(spark, [plane]), 10, 20, 0.8), "v", (1, 8, 16))[0][0, 0])


def golden_labels(mask, ring=False):
    labels = np.full(mask.shape, -1)
    for y, x in zip(*np.nonzero(mask), strict=True):
        if labels[y, x] < 0:
            todo, first = [(y, x)], y * mask.shape[1] + x
            while todo:
                j, i = todo.pop()
                i = i % mask.shape[1] if ring else i
                if 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and mask[j, i] and labels[j, i] < 0:
                    labels[j, i] = first
                    todo += [(j + 1, i), (j - 1, i), (j, i + 1), (j, i - 1)]
    return labels


def cells_of(spark, mask):
    return spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)], "t int, y int, x int")


@pytest.mark.parametrize("share", [0.3, 0.6])
def test_components_of_noise_and_of_a_spiral(spark, share):
    mask = RNG.random((25, 30)) < share
    if share == 0.3:
        mask[:, :] = False
        mask[::4, :], mask[1::8, -1], mask[2::8, -1], mask[3::8, -1], mask[5::8, 0], mask[6::8, 0], mask[7::8, 0] = True, True, True, True, True, True, True
    found = np.full(mask.shape, -1)
    for r in clusters.label_components(cells_of(spark, mask), 30).collect():
        found[r.y, r.x] = r.label
    assert (found == golden_labels(mask)).all()


@pytest.mark.parametrize("tile", [7, 64])
@pytest.mark.parametrize("ring", [False, True])
def test_components_over_tiles_and_round(spark, tile, ring):
    masks_ = [RNG.random((25, 30)) < share for share in (0.45, 0.6, 0.75)]
    cells = spark.createDataFrame([(t, int(y), int(x)) for t, m in enumerate(masks_) for y, x in zip(*np.nonzero(m), strict=True)], "t int, y int, x int")
    found = np.full((3, 25, 30), -1)
    for r in clusters.label_components(cells, 30, ring, tile).collect():
        found[r.t, r.y, r.x] = r.label
    for t, m in enumerate(masks_):
        assert (found[t] == golden_labels(m, ring)).all()
    assert clusters.label_components(cells.where("t > 9"), 30, ring, tile).collect() == []


def test_components_that_touch_at_a_corner_are_two(spark):
    assert clusters.label_components(spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "t int, y int, x int"), 9).select("label").distinct().count() == 2


def test_erosion_within_input_within_dilation(spark):
    mask = RNG.random((20, 20)) < 0.85
    grid, cells = frame_of(spark, [np.zeros((20, 20))]), cells_of(spark, mask)
    points = lambda df: {(r.y, r.x) for r in df.collect()}
    small, big = points(stencil.erode(cells, 1)), points(stencil.dilate(cells, grid, 3))
    want = {(y, x) for y in range(1, 19) for x in range(1, 19) if mask[y, x] and mask[y - 1, x] and mask[y + 1, x] and mask[y, x - 1] and mask[y, x + 1]}
    reach = {(y, x) for y in range(20) for x in range(20) if any(abs(y - j) + abs(x - i) <= 3 for j, i in zip(*np.nonzero(mask), strict=True))}
    assert small == want and big == reach and small <= set(zip(*map(lambda a: a.tolist(), np.nonzero(mask)), strict=True)) <= big


def test_patch_wraps_pads_and_equals_a_rolled_image(spark):
    image = RNG.normal(0, 1, (8, 10))
    points = spark.createDataFrame([(1, 0, 4, 0), (2, 0, 0, 9), (3, 0, 7, 5)], "point_id int, t int, y int, x int")
    found = {}
    for r in patches.square_patch(points, frame_of(spark, [image]), 2, 8, 10).collect():
        found.setdefault(r.point_id, np.zeros((4, 4)))[r.py, r.px] = r.v
    padded = np.pad(image, ((2, 2), (0, 0)))
    for p, (y, x) in {1: (4, 0), 2: (0, 9), 3: (7, 5)}.items():
        np.testing.assert_allclose(found[p], np.roll(padded, 2 - x, axis=1)[y : y + 4, :4])


def test_half_steps_and_bad_times(spark):
    grid = frame_of(spark, np.stack([np.full((4, 4), v) for v in (1.0, 3.0, 7.0)]))
    at = lambda *idx: spark.createDataFrame([(i, v, 2, 2) for i, v in enumerate(idx)], "point_id int, index double, y int, x int")
    means = {r.point_id: r.m for r in patches.wind_patch(at(0.5, 1.0, 1.5), grid, 1, 4, 4, 3).groupBy("point_id").agg(F.avg("v").alias("m")).collect()}
    assert means == {0: 2.0, 1: 3.0, 2: 5.0}
    for bad in (0.25, 2.5, -1.0):
        with pytest.raises(Exception, match="half-way"):
            patches.wind_patch(at(bad), grid, 1, 4, 4, 3).collect()
    assert [r.t for r in patches.nearest_frame(at(0.5, 1.5, 2.4)).orderBy("point_id").collect()] == [0, 2, 2]


def test_argmin_ties_missing_and_cut_borders(spark):
    image = np.full((12, 12), 5.0)
    image[3, 3] = image[3, 5] = 1.0
    values = frame_of(spark, [image, np.full((12, 12), np.nan)]).withColumnRenamed("v", "dav")
    points = spark.createDataFrame([(1, 0, 5, 5), (2, 1, 5, 5), (3, 0, 1, 4)], "point_id int, t int, y int, x int")
    found = {r.point_id: (r.new_y, r.new_x) for r in patches.disc_argmin(points, values, 3, 12, 12).collect()}
    # the second has no value; the third's box is cut by two rows, and its place moves up by two
    assert found == {1: (3, 3), 2: (5, 5), 3: (1, 3)}


@pytest.mark.parametrize("is_global", [False, True])
def test_tiles_give_what_joins_give(spark, is_global):
    image = RNG.normal(250, 10, (70, 75))
    image[RNG.random(image.shape) < 0.2] = np.nan
    image[:20, :20] = np.nan
    grid = frame_of(spark, [image])
    places = grid.select("t", "y", "x").withColumn("point_id", F.col("y") * 75 + F.col("x"))
    values = grid.withColumnRenamed("v", "dav")
    joined = {(r.y, r.x): (r.new_y, r.new_x) for r in patches.disc_argmin(places, values, 4, 70, 75, is_global).collect()}
    assert {(r.y, r.x): (r.new_y, r.new_x) for r in patches.all_moves(values, 4, 70, 75, is_global).collect()} == joined
    means = {(r.y, r.x): r.mean_v for r in patches.disc_mean(places, grid, 4, 70, 75, is_global).collect()}
    for r in patches.all_means(grid, 4, 70, 75, is_global).collect():
        assert r.mean_v == pytest.approx(means[r.y, r.x]) if means[r.y, r.x] is not None else r.mean_v is None


def observations(spark, rows):
    return spark.createDataFrame(rows, "storm_idx int, obs_idx int, tick int, v double, iso_time string")


def test_interpolation_is_exact_at_knots_and_missing_between(spark):
    rows = [(1, 0, 0, 1.0, "2020-01-01 00:00:00"), (1, 1, 6, None, "2020-01-01 03:00:00"), (1, 2, 12, 3.0, "2020-01-01 06:00:00"), (1, 3, 18, 6.0, "2020-01-01 09:00:00"), (2, 0, 0, 9.0, "2020-01-01 22:00:00")]
    found = {(r.storm_idx, r.tick): r.v for r in tracks.interpolate_numbers(observations(spark, rows), ["v"]).collect()}
    assert found[1, 0] == 1.0 and found[1, 3] is None and found[1, 12] == 3.0 and found[1, 14] == 4.0 and found[1, 18] == 6.0 and found[2, 0] == 9.0 and len(found) == 20
    times = {(r.storm_idx, r.tick): r.iso_time for r in tracks.interpolate_times(observations(spark, rows)).collect()}
    assert times[1, 1] == "2020-01-01 00:30:00" and times[1, 18] == "2020-01-01 09:00:00" and not [k for k in times if k[0] == 2]


def test_repeated_ticks_give_way(spark):
    rows = [(1, 0, 0, 1.0, "x"), (1, 1, 0, 2.0, "y"), (1, 2, 2, 4.0, "z")]
    got = {r.tick: r.iso_time for r in tracks.interpolate_steps(observations(spark, rows), ["iso_time"]).collect()}
    assert got == {0: "y", 1: "y", 2: "z"}


def test_storms_are_found_by_name_and_season(spark):
    storms = spark.createDataFrame([(0, 1999, "ANA"), (1, 2000, "BOB"), (2, 1999, "BOB"), (3, 2000, "BOB"), (4, 2001, "ANA")], "storm_idx int, season int, name string")
    assert tracks.find_storm(storms, "bob", 2000) == [1, 2, 3] and tracks.find_storm(storms, "Ana", 2001) == [4]
    with pytest.raises(KeyError):
        tracks.find_storm(storms, "ana", 2000)


def test_best_track_reader(spark, sf_dir):
    from galegrid.sources import fixtures as fx
    from galegrid.sources.best_tracks import BestTracks

    reader = BestTracks(fx.storms(spark, sf_dir), fx.observations(spark, sf_dir))
    assert repr(reader) == "BestTracks of 150 storms"
    assert reader.read(3).columns == ["storm_idx", "tick", "name", "season", "iso_time", "lat", "lon", "usa_wind"]
    plain = reader.with_settings(interpolating=False, columns="lat")
    assert plain.read((3,)).columns == ["storm_idx", "obs_idx", "lat"] and reader.interpolating
    name = fx.storms(spark, sf_dir).where("storm_idx = 3").first()
    both = {r.storm_idx for r in plain.read(name["name"].lower(), name["season"]).select("storm_idx").distinct().collect()}
    assert 3 in both
    for bad, error in (((1000,), IndexError), (("nobody", 2003), KeyError), ((1.5,), ValueError)):
        with pytest.raises(error):
            reader.read(*bad)
    with pytest.raises(ValueError):
        reader.with_settings(interpolating="yes")


def test_the_whole_job_crops_and_resamples(spark):
    from galegrid.plans import jobs

    y, x = np.mgrid[0:50, 0:60]
    images = [290 - 70 * np.exp(-((y - 22 - i) ** 2 + (x - 30) ** 2) / 128) for i in range(3)]
    land = spark.createDataFrame([], "lat_idx int, lon_idx int, is_land boolean")
    job = jobs.Job(height=50, width=60, in_km=5.0, out_km=10.0, radius_km=60.0, rows=(0, 48), columns=(2, 58))
    points = jobs.find_systems(frame_of(spark, images), land, job, erosion=1, cloud_km=50.0, search_km=50.0).orderBy("t").collect()
    assert [(p.t, p.y, p.x) for p in points if p.system_id == points[0].system_id]
    assert len(points) >= 2
    with pytest.raises(ValueError):
        jobs.Job(height=5, width=5, in_km="4")


def test_guards(spark):
    with pytest.raises(KeyError):
        readers.track_columns(["nope"])
    with pytest.raises(ValueError):
        readers.track_columns(3)
    assert readers.track_columns("lat") == ["lat"] and len(readers.track_columns("all")) == 13
    for bounds in ((61, 0, 0, 1), (10, 0, 0, 181), (0, 10, 0, 1)):
        with pytest.raises(ValueError):
            readers.check_bounds(*bounds)
    with pytest.raises(Exception, match="kelvin"):
        readers.checked_range(frame_of(spark, [[[50.0]]])).collect()
    with pytest.raises(Exception, match="wind radii"):
        geometry.wind_radii_arcs(spark.createDataFrame([(1, [1.0, 2.0, -3.0, 4.0])], "k int, r array<double>"), "k", "r", 4.0, 9, 9).collect()


def test_readers_turn_nan_into_null(spark, tmp_path):
    pd.DataFrame({"time": pd.to_datetime(["2020-01-02", "2020-01-01"]), "lat": [0, 0], "lon": [1, 1], "Tb": [np.nan, 200.0]}).to_parquet(f"{tmp_path}/a.parquet", coerce_timestamps="us")
    assert [(r.t, r.v) for r in readers.read_infrared(spark, str(tmp_path)).orderBy("t").collect()] == [(0, 200.0), (1, None)]


def test_axes(spark):
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (-3.2,)], "c double")
    got = [r[0] for r in halves.select(axes.coordinate_to_pixel(F.col("c"), F.lit(0.0), F.lit(1.0))).collect()]
    assert got == [0, 2, 2, -3]
    assert (masks.disc_cells(3), masks.disc_cells(15), masks.disc_cells(30)) == (25, 697, 2809)
    assert (masks.half_disc_cells(3), masks.half_disc_cells(15), masks.half_disc_cells(30)) == (32, 716, 2828)


# --- order-dependent rules ------------------------------------------------------------------------------------------


@settings(deadline=None, max_examples=60, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(0, 5)), min_size=1, max_size=12))
def test_suppression_keeps_a_subset_with_the_best(places):
    kept = clusters.suppress([(y, x) for y, x, _ in places], [v for _, _, v in places], 16.0)
    assert any(kept)
    best = min(v for _, _, v in places)
    assert any(k and v == best for k, (_, _, v) in zip(kept, places, strict=True))


def test_a_suppressed_place_still_suppresses():
    # the first and the third are apart, but the second, already gone, sees both
    assert clusters.suppress([(0, 0), (0, 3), (0, 6)], [1.0, 2.0, 3.0], 16.0) == [True, False, False]
    assert clusters.suppress([(0, 0), (0, 3), (0, 6)], [2.0, 3.0, 1.0], 16.0) == [False, False, True]
    assert clusters.suppress([(0, 3), (0, 0), (0, 6)], [2.0, 1.0, 3.0], 16.0) == [False, True, False]


S = tracker.Settings(height=50, width=50)


def test_merging_ends_the_one_with_fewer_positives_and_the_earlier_of_equals():
    one = lambda n, y, p: tracker.System(str(n), 0, y, 5, 3, p)
    for systems, alive in (([one(0, 5, 3), one(1, 6, 2)], [True, False]), ([one(0, 5, 2), one(1, 6, 2)], [False, True]), ([one(0, 5, 2), one(1, 7, 2)], [True, True])):
        tracker.merge(systems, S)
        assert [x.active for x in systems] == alive
    far = [one(0, 5, 2), one(1, 20, 2)]
    tracker.merge(far, tracker.Settings(height=50, width=50, corrected=True))
    assert [x.active for x in far] == [False, True]


def test_a_system_is_silent_for_window_points_before_it_ends():
    system = tracker.System("a", 0, 5, 5)
    for _ in range(47):
        system.update(5, 5, False)
    assert system.is_active(48)
    system.update(5, 5, False)
    assert not system.is_active(48)
    system.update(5, 5, True)
    assert not system.is_active(48)


def test_births_need_sea_cold_and_distance():
    def frame(*births):
        return tracker.Frame(births=list(births))

    systems = []
    points = tracker.step(systems, 1, frame((10, 10, 100.0, False, 250.0), (12, 40, 100.0, True, 250.0), (40, 10, 100.0, False, 273.0), (40, 40, 100.0, False, 273.5), (25, 25, 1.0, False, None)), S)
    assert [(p["y"], p["x"]) for p in points] == [(10, 10), (40, 10), (25, 25)]
    move = tracker.Frame(moves={(10, 10): (12, 10), (40, 10): (50, 10), (25, 25): (26, 25)}, cells={(12, 10): (1999.0, 272.9), (26, 25): (2000.0, 200.0)}, births=[(13, 13, 5.0, False, 200.0)])
    points = tracker.step(systems, 2, move, S)
    assert [(p["y"], p["x"], p["positive"]) for p in points] == [(12, 10, True), (26, 25, False)]
    assert systems[1].active and systems[1].n_points == 1


def test_the_stream_gives_the_batch_fold(spark, sf_dir, tmp_path):
    from galegrid.plans import catalogue

    s = catalogue.core_settings()
    catalogue._events(spark, sf_dir).write.parquet(f"{tmp_path}/all")
    events = spark.read.parquet(f"{tmp_path}/all")
    batch = {tuple(r) for r in tracker.track(events, s).collect()}
    for t in range(7):
        events.where(F.col("t") == t).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        query = tracker.track_stream(stream, s).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    key = lambda r: tuple(r[c] for c in ("system_id", "t", "y", "x", "cdav", "positive"))
    got = {key(r.asDict()) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(b[1], b[2], b[3], b[4], b[5], b[6]) for b in batch} and len(got) == 12


def test_frames_out_of_order_give_the_batch_job(spark, small_dir, tmp_path):
    """Cells of frames with holes come in an order of their own, frames in parts; the points are the batch job's."""
    from galegrid.plans import catalogue
    from galegrid.sources import fixtures as fx
    from galegrid.streaming import frames

    s, side, land = catalogue.core_settings(), fx.SIDE, fx.landmask(spark)
    fx.grid_cores(spark, small_dir).select("t", "y", "x", "v").withColumn("v", F.when((7 * F.col("t") + 31 * F.col("y") + 17 * F.col("x")) % 11 != 0, F.col("v"))).write.parquet(f"{tmp_path}/all")
    cells = spark.read.parquet(f"{tmp_path}/all")
    want = points_of(catalogue.QUERIES["find_systems"](spark, small_dir).collect())
    assert len(want) > 5
    upper, lower = F.col("y") < 20, F.col("y") >= 20
    for batch in ((2, 0), (1,), (4, (3, upper)), ((3, lower), (6, upper), 5), ((6, lower), 2)):
        parts = [cells.where(F.col("t") == (p if isinstance(p, int) else p[0])).where(F.lit(True) if isinstance(p, int) else p[1]) for p in batch]
        for part in parts:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(cells.schema).parquet(f"{tmp_path}/in")
        query = frames.track_frames(stream, land, 10, s, f"{tmp_path}/work", last=6, availableNow=True)
        query.awaitTermination()
    assert points_of(frames.points_of(spark, f"{tmp_path}/work").collect()) == want


# --- the tracker from raw frames ------------------------------------------------------------------------------------


def disc_values(image, y, x, r, wrap=False):
    """(value, y offset, x offset) of what a disc about a pixel's corner holds, row by row."""
    h, w = image.shape
    column = lambda i: (x + i) % w if wrap else x + i
    return [
        (image[y + j, column(i)], j, i) for j in range(-r, r) for i in range(-r, r)
        if (j + 0.5) ** 2 + (i + 0.5) ** 2 <= r * r and 0 <= y + j < h and 0 <= column(i) < w and not math.isnan(image[y + j, column(i)])
    ]


def golden_distance2(a, b, s):
    dx = abs(a[1] - b[1])
    return (a[0] - b[0]) ** 2 + (min(dx, s.width - dx) if s.is_global and s.corrected else dx) ** 2


def golden_clusters(values, s):
    """Places of the minima that stay independent, in order of their components."""
    mask = np.where(np.isnan(values), np.inf, values) < s.low_dav
    for _ in range(s.erosion):
        padded = np.pad(mask, 1)
        mask = padded[1:-1, 1:-1] & padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:]
    labels = golden_labels(mask, s.is_global and s.corrected)
    minima = []
    for label in sorted({int(n) for n in labels[labels >= 0].ravel()}):
        minima.append(min((values[y, x], y, x) for y, x in zip(*np.nonzero(labels == label), strict=True)))
    alive = set(range(len(minima)))
    near = lambda a, b: golden_distance2(a[1:], b[1:], s) < s.apart**2
    for i in range(len(minima)):
        group = [j for j in sorted(alive) if near(minima[i], minima[j])]
        if len(group) >= 2:
            alive -= set(group) - {min(group, key=lambda j: (minima[j][0], j))}
    return [minima[j] for j in sorted(alive)]


def golden_tracker(temps, davs, is_land, s):
    """Points of all systems, folded over whole frames: no place is left out beforehand."""
    height, width = temps[0].shape
    systems, out = [], []
    for t in range(1, len(temps)):
        here, points = [], []
        for one in systems:
            if len(one["signs"]) >= s.window and not any(one["signs"][-s.window :]):
                one["on"] = False
            if not one["on"]:
                continue
            y, x = one["at"]
            if found := disc_values(davs[t], y, x, s.search, s.is_global):
                _, j, i = min(found)
                y, x = min(max(y + j - max(0, s.search - y), 0), height), (x + i) % width if s.is_global else max(x + i - max(0, s.search - x), 0)
            if y in (0, height) or not s.is_global and x in (0, width):
                one["on"] = not s.corrected
                continue
            inside = y < height and x < width
            mean = np.mean([v for v, _, _ in disc_values(temps[t], y, x, s.cloud, s.is_global)]) if disc_values(temps[t], y, x, s.cloud, s.is_global) else np.nan
            value = davs[t][y, x] if inside else np.nan
            positive = bool(mean < s.warm and value < s.low_dav)
            one["at"] = (y, x)
            one["signs"].append(positive)
            here.append((y, x))
            points.append([one, t, y, x, value, positive])
        for a in range(len(systems)):
            for b in range(a + 1, len(systems)):
                one, two = systems[a], systems[b]
                for each in (one, two):
                    if len(each["signs"]) >= s.window and not any(each["signs"][-s.window :]):
                        each["on"] = False
                if one["on"] and two["on"] and golden_distance2(one["at"], two["at"], s) < (s.apart**2 if s.corrected else s.apart_km / s.res_km**2):
                    (two if sum(one["signs"]) > sum(two["signs"]) else one)["on"] = False
        for value, y, x in golden_clusters(davs[t], s):
            cold = [v for v, _, _ in disc_values(temps[t], y, x, s.cloud, s.is_global)]
            if any(golden_distance2((y, x), place, s) < s.apart**2 for place in here) or is_land(y, x) or (cold and np.mean(cold) > s.warm):
                continue
            systems.append({"id": tracker.system_id(t, y, x), "at": (y, x), "signs": [True], "on": True})
            points.append([systems[-1], t, int(y), int(x), value, True])
        out += [(one["id"], t, y, x, None if math.isnan(v) else round(float(v), 4), positive, one["on"]) for one, t, y, x, v, positive in points]
    return out


def images_of(df, column, frames, side):
    return list(array_of(df, column, (frames, side, side)))


def points_of(rows):
    return sorted((r.system_id, r.t, r.y, r.x, None if r.cdav is None else round(r.cdav, 4), r.positive, r.active) for r in rows)


def test_tracker_equals_a_fold_over_whole_frames(spark, small_dir):
    from galegrid.plans import catalogue
    from galegrid.sources import fixtures as fx

    s, side = catalogue.core_settings(), fx.SIDE
    temps = images_of(fx.grid_cores(spark, small_dir), "v", 7, side)
    davs = images_of(catalogue._core_dav(spark, small_dir), "dav", 7, side)
    want = golden_tracker(temps, davs, lambda y, x: (y * side + x) % 5 == 0, s)
    assert len(want) > 5 and points_of(catalogue.QUERIES["track_points"](spark, small_dir).collect()) == sorted(want)
    last = {}
    for p in sorted(want, key=lambda p: p[1]):
        last.setdefault(p[0], []).append(p)
    found = {r.system_id: (r.time_start, r.duration, r.y, r.x, r.active) for r in catalogue.QUERIES["track_systems"](spark, small_dir).collect()}
    assert found == {k: (v[0][1], len(v), v[-1][2], v[-1][3], v[-1][6]) for k, v in last.items()}
    independent = sorted((r.t, r.y, r.x) for r in catalogue.QUERIES["greedy_independent"](spark, small_dir).collect())
    assert independent == sorted((t, y, x) for t in range(7) for _, y, x in golden_clusters(davs[t], s))
    # what is drawn: variances near cold cloud, systems, known storms
    layers = catalogue.QUERIES["annotated_layers"](spark, small_dir).collect()
    want_dav = set()
    for t in range(7):
        cold = np.argwhere(temps[t] < 273.0)
        near = np.zeros((side, side), bool)
        for y, x in cold:
            for j in range(-10, 11):
                k = 10 - abs(j)
                if 0 <= y + j < side:
                    near[y + j, max(0, x - k) : x + k + 1] = True
        want_dav |= {(t, y, x) for y, x in np.argwhere(near & (davs[t] < 2450.0)).tolist()}
    assert {(r.t, r.y, r.x) for r in layers if r.layer == "dav"} == want_dav
    assert sorted((r.label, r.t, r.y, r.x, r.value == 1) for r in layers if r.layer == "system") == sorted(p[:4] + (p[5],) for p in want)
    known = catalogue.QUERIES["known_storm_locf"](spark, small_dir).collect()
    assert sorted((r.label, r.t, r.y, r.x) for r in layers if r.layer == "known") == sorted((r.name, r.t, r.y, r.x) for r in known)


@pytest.mark.parametrize(("corrected", "shift"), [(False, 20), (True, 20), (True, 40)])
def test_the_tracker_of_a_global_grid_equals_a_fold(spark, small_dir, corrected, shift):
    """Frames turned so that cores stand on the last and first columns."""
    from galegrid.plans import catalogue
    from galegrid.sources import fixtures as fx

    side = fx.SIDE
    s = tracker.Settings(height=side, width=side, is_global=True, corrected=corrected)
    turn = lambda df: df.withColumn("x", (F.col("x") + shift) % side)
    grid, values = turn(fx.grid_cores(spark, small_dir).select("t", "y", "x", "v")), turn(catalogue._core_dav(spark, small_dir)).checkpoint()
    want = golden_tracker(images_of(grid, "v", 7, side), images_of(values, "dav", 7, side), lambda y, x: (y * side + x) % 5 == 0, s)
    found = tracker.track(tracker.frame_events(grid, values, fx.landmask(spark), s), s)
    assert len(want) > 3 and points_of(found.collect()) == sorted(want)


def test_the_job_equals_a_fold_over_whole_frames(spark, small_dir):
    from galegrid.plans import catalogue
    from galegrid.sources import fixtures as fx

    side = fx.SIDE
    holes = fx.grid_cores(spark, small_dir).withColumn("v", F.when((7 * F.col("t") + 31 * F.col("y") + 17 * F.col("x")) % 11 != 0, F.col("v")))
    timed = stencil.temporal_fill(holes)
    davs = images_of(dav.dav_map(timed, 10, side, side), "dav", 7, side)
    temps = images_of(stencil.spatial_fill(timed, side), "v", 7, side)
    want = golden_tracker(temps, davs, lambda y, x: (y * side + x) % 5 == 0, catalogue.core_settings())
    assert want and points_of(catalogue.QUERIES["find_systems"](spark, small_dir).collect()) == sorted(want)


def test_merging_equals_loops(spark, small_dir):
    from galegrid.plans import catalogue

    rows = catalogue.QUERIES["merge_kill"](spark, small_dir).collect()
    for t in {r.t for r in rows}:
        mine = sorted((r for r in rows if r.t == t), key=lambda r: r.no)
        on = [True] * len(mine)
        for a in range(len(mine)):
            for b in range(a + 1, len(mine)):
                p, q = mine[a], mine[b]
                if on[a] and on[b] and (p.y - q.y) ** 2 + (p.x - q.x) ** 2 < 1.5**2:
                    on[b if p.n_positive > q.n_positive else a] = False
        assert [r.killed for r in mine] == [not x for x in on]


def test_domains_are_tracked_each_by_itself(spark, small_dir):
    """Two areas' frames, one after the other in t: each gives what it gives alone."""
    from galegrid.plans import catalogue
    from galegrid.sources import fixtures as fx

    s = catalogue.core_settings()
    one, values = fx.grid_cores(spark, small_dir), catalogue._core_dav(spark, small_dir)
    alone = tracker.track(tracker.frame_events(one, values, fx.landmask(spark), s), s).collect()
    both = one.unionByName(one.withColumn("t", F.col("t") + 7)), values.unionByName(values.withColumn("t", F.col("t") + 7))
    domains = spark.range(14).select(F.col("id").cast("int").alias("t"), F.floor(F.col("id") / 7).cast("int").alias("domain"))
    found = tracker.track(tracker.frame_events(*both, fx.landmask(spark), s, domains), s).collect()
    for domain in (0, 1):
        assert points_of(r for r in found if r.domain == domain) == points_of(alone)


def test_domains_with_gaps_and_in_turns(spark, small_dir):
    """Frame numbers with gaps, and two areas of different frames whose numbers alternate: each gives what it gives alone."""
    from galegrid.plans import catalogue
    from galegrid.sources import fixtures as fx

    s, land = catalogue.core_settings(), fx.landmask(spark)
    one, values = fx.grid_cores(spark, small_dir).select("t", "y", "x", "v"), catalogue._core_dav(spark, small_dir)
    flip = lambda df: df.withColumn("x", s.width - 1 - F.col("x"))
    run = lambda grid, dav_, *domains: tracker.track(tracker.frame_events(grid, dav_, land, s, *domains), s).collect()
    at = lambda df, first, gap: df.withColumn("t", first + gap * F.col("t"))
    alone, flipped = run(one, values), run(flip(one), flip(values))
    assert points_of(alone) != points_of(flipped) and len(flipped) > 5
    gaps = run(at(one, 0, 10), at(values, 0, 10))
    ids = {tracker.system_id(t * 10, y, x): tracker.system_id(t, y, x) for t in range(7) for y in range(s.height) for x in range(s.width)}
    assert sorted((ids[r.system_id], r.t // 10, r.y, r.x, r.positive, r.active) for r in gaps) == sorted((r.system_id, r.t, r.y, r.x, r.positive, r.active) for r in alone)
    numbered = spark.createDataFrame([(10 * t, 0) for t in range(7)], "t int, domain int")
    assert points_of(run(at(one, 0, 10), at(values, 0, 10), numbered)) == points_of(alone)
    both = [at(x, 0, 4).unionByName(at(flip(x), 1, 4)) for x in (one, values)]
    turns = spark.createDataFrame([(4 * t + k, k) for t in range(7) for k in (0, 1)], "t int, domain int")
    found = run(*both, turns)
    for domain, want in ((0, alone), (1, flipped)):
        assert points_of(r for r in found if r.domain == domain) == points_of(want)


# --- plans of stencils ----------------------------------------------------------------------------------------------


def test_sobel_of_tiles_and_small_frames(spark):
    images = RNG.normal(250, 10, (9, 7, 6))
    found = stencil.sobel(frame_of(spark, images), 7, 6)
    padded = np.pad(images, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    smooth = lambda a, axis: np.take(a, range(a.shape[axis] - 2), axis) + 2 * np.take(a, range(1, a.shape[axis] - 1), axis) + np.take(a, range(2, a.shape[axis]), axis)
    step = lambda a, axis: np.take(a, range(2, a.shape[axis]), axis) - np.take(a, range(a.shape[axis] - 2), axis)
    np.testing.assert_allclose(array_of(found, "dy", images.shape), smooth(step(padded, 1), 2), atol=1e-9)
    np.testing.assert_allclose(array_of(found, "dx", images.shape), step(smooth(padded, 1), 2), atol=1e-9)


def test_blur_over_tiles_and_over_a_missing_row(spark):
    image = RNG.normal(250, 10, (70, 131))
    image[20, 30] = np.nan
    grid = frame_of(spark, [image])
    w = stencil.gaussian_weights(2.0)
    padded = np.pad(image, 8, mode="symmetric")
    down = sum(k * padded[i : i + 70] for i, k in enumerate(w))
    want = sum(k * down[:, i : i + 131] for i, k in enumerate(w))
    np.testing.assert_allclose(array_of(stencil.gaussian_blur(grid, 70, 131), "v", (1, 70, 131))[0], want, rtol=1e-9)
    # a cell without a row is missing, and moves no other
    np.testing.assert_allclose(array_of(stencil.gaussian_blur(grid.where("v is not null"), 70, 131), "v", (1, 70, 131))[0], want, rtol=1e-9)


def test_erosion_equals_its_definition(spark):
    mask = RNG.random((40, 40)) < 0.97
    want = np.zeros_like(mask)
    for y in range(40):
        for x in range(40):
            around = [(y + j, x + i) for j in range(-2, 3) for i in range(-2, 3) if abs(j) + abs(i) <= 2]
            want[y, x] = all(0 <= a < 40 and 0 <= b < 40 and mask[a, b] for a, b in around)
    found = {(r.y, r.x) for r in stencil.erode(cells_of(spark, mask), 2).collect()}
    assert found == set(map(tuple, np.argwhere(want).tolist())) and found


def test_resampling_guards_and_bounds_in_degrees(spark):
    from galegrid.plans import jobs

    grid = frame_of(spark, [[[1.0, 2.0], [3.0, 4.0]]])
    for height, width, factor in ((2.5, 2, 0.5), (0, 2, 0.5), (2, 2, 0), (2, 2, 0.2), (2, 2, "1"), (True, 2, 1)):
        with pytest.raises(ValueError):
            stencil.resample_bilinear(grid, height, width, factor)
    with pytest.raises(ValueError):
        stencil.resample_bilinear(grid.withColumn("v", F.col("v").cast("string")), 2, 2, 1.0)
    job = jobs.Job(height=100, width=200, bounds=(10.0, -10.0, -20.0, 30.0), axes=(-25.0, -50.0, 0.5, 0.5))
    assert job.kept_pixels() == ((30, 70), (60, 160))
    with pytest.raises(ValueError):
        jobs.Job(height=5, width=5, bounds=(1, 0, 0, 1))
