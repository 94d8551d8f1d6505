"""Queries on tables with more frames, or more points at a place, than the fixtures have."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from galegrid.operators import clusters
from galegrid.plans import catalogue
from galegrid.streaming import tracker


def equals_sql(spark, name: str, folder, **tables: pa.Table) -> None:
    """The query's rows over the tables are its SQL's."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows, f"{folder}/{table}.parquet")
        con.register(table, rows)
    found, want = catalogue.QUERIES[name](spark, str(folder)), con.sql(catalogue.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(want.select(", ".join(columns)).fetchall())


def vectors(frames: int) -> pa.Table:
    n = 64 * frames
    return pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array([[i * j % 17 / 17 for j in range(64)] for i in range(n)], pa.list_(pa.float32()))})


def test_frames_of_a_second_day(spark, tmp_path):
    """The 49th frame is on the day after the file's first."""
    equals_sql(spark, "frame_time_text", tmp_path, embeddings=vectors(50))


def merged_in_pairs(systems: list[tracker.System], s: tracker.Settings) -> list[bool]:
    """Which are active after all pairs were gone through in their order."""
    for i, a in enumerate(systems):
        for b in systems[i + 1 :]:
            if a.is_active(s.window) and b.is_active(s.window) and clusters.distance2(a.y, a.x, b.y, b.x, s.ring) < s.merge2:
                (b if a.n_positive > b.n_positive else a).active = False
    return [x.active for x in systems]


def test_merging_equals_going_through_all_pairs():
    """Crowded and sparse places, frames that go round, and systems that are ended or end when they are asked."""
    deal = random.Random(4)
    for turn in range(600):
        s = tracker.Settings(height=30, width=30, res_km=deal.choice([10.0, 40.0, 75.0, 200.0]), is_global=turn % 2 == 0, corrected=turn % 3 > 0, window=3)
        one = lambda k: tracker.System(str(k), 0, deal.randrange(30), deal.randrange(30), 9, deal.randrange(4), deal.randrange(5), deal.random() < 0.9)  # noqa: B023, E731
        systems = [one(k) for k in range(deal.choice([0, 1, 2, 3, 20, 80]))]
        want = merged_in_pairs([tracker.System(**vars(x)) for x in systems], s)
        tracker.merge(systems, s)
        assert [x.active for x in systems] == want, turn


def test_merging_many_systems_at_one_place_asks_each_once(monkeypatch):
    """5,000 systems: as many questions, not 12 million pairs."""
    asked = []
    own = tracker.System.is_active
    monkeypatch.setattr(tracker.System, "is_active", lambda self, window: asked.append(1) or own(self, window))
    systems = [tracker.System(str(k), 0, 5, 5, 9, k * 7 % 5) for k in range(5000)]
    tracker.merge(systems, tracker.Settings(height=50, width=50, corrected=True))
    assert len(asked) <= 5000 and [x.system_id for x in systems if x.active] == ["4997"]


def test_merging_frames_of_more_than_a_batch(spark):
    """Frames that begin within batches of Arrow, 12,000 systems each, over places of some frames alone."""
    s = tracker.Settings(height=64, width=64, res_km=200.0, corrected=True)
    deal = random.Random(5)
    rows = [(t, no, deal.randrange(12 * (t + 1)), deal.randrange(5), deal.randrange(5)) for t in (0, 2, 3) for no in range(12000 if t else 300)]
    found = tracker.merge_kills(spark.createDataFrame(rows, "t int, no int, y int, x int, n_positive int"), s).collect()
    assert sorted(tuple(r)[:5] for r in found) == rows
    for t in (0, 2, 3):
        systems = [tracker.System(str(no), 0, y, x, 1, n) for at, no, y, x, n in rows if at == t]
        tracker.merge(systems, s)
        assert [r.killed for r in sorted(found) if r.t == t] == [not x.active for x in systems]


def events(n: int) -> pa.Table:
    return pa.table({"event_id": pa.array(range(n), pa.int64())})


def shuffled_rows(spark, query) -> int:
    """Rows that the query's stages write to shuffles."""
    def written() -> dict[int, int]:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = set(written())
    query().write.format("noop").mode("overwrite").save()
    return sum(v for k, v in written().items() if k not in before)


def with_joins_of_shuffles(spark, query, most: int) -> None:
    """The query shuffles as many rows at most where no table is small enough to be broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        assert shuffled_rows(spark, query) <= most
    finally:
        spark.conf.set(key, usual)


@pytest.mark.parametrize("ring", [None, 12])
@pytest.mark.parametrize("reach", [0.5, 1.5, 3.2])
def test_pairs_in_blocks_and_parts_equal_all_pairs(spark, monkeypatch, ring, reach):
    """Crowded places, whose ids come in several blocks and whose points in several parts."""
    for name, number in (("BLOCK", 4), ("PART", 3), ("PAIRS", 50)):
        monkeypatch.setattr(clusters, name, number)
    deal = random.Random(6)
    rows = [(k % 2, k * 3, deal.choice([0, 1, 1, 1, 5, 9]), deal.choice([0, 2, 2, 7, 11])) for k in range(240)]
    old = [(k % 3, k * 3 + k % 2, deal.choice([0, 1, 1, 4, 8]), deal.choice([0, 1, 2, 10, 11])) for k in range(130)]
    schema = "t int, id long, y int, x int"
    points, others = spark.createDataFrame(rows, schema), spark.createDataFrame(old, schema)
    for there, two, once in ((others, old, False), (points, rows, False), (points, rows, True)):
        found = sorted(map(tuple, clusters.pair_distances(points, there, reach, ring, once).collect()))
        near = [(t, i, j, clusters.distance2(y, x, v, w, ring)) for t, i, y, x in rows for u, j, v, w in two if t == u and (i < j or not once)]
        assert found == sorted(p for p in near if p[3] < reach * reach)


@pytest.mark.parametrize("name, n, most", [("pair_distance", 20000, 5), ("pair_distance_ring", 100000, 1)])
def test_pairs_shuffle_points_and_not_copies_of_them(spark, tmp_path, name, n, most):
    """Where tables are too large to be broadcast, ten copies of each point were shuffled; of the ring only every fifth is a point."""
    pq.write_table(events(n), f"{tmp_path}/events.parquet")
    with_joins_of_shuffles(spark, lambda: catalogue.QUERIES[name](spark, str(tmp_path)), most * n)


@pytest.mark.parametrize("name", ["pair_distance", "pair_distance_ring"])
def test_pairs_are_stored_in_less_than_a_byte(spark, tmp_path, name):
    """500 points at each of 40 places: a place's pairs come together, in the order of ids, so that files stay small."""
    ids = [2240 * k + 5 * j for k in range(500) for j in range(40)]
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64())}), f"{tmp_path}/events.parquet")
    catalogue.QUERIES[name](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40 * 500 * 499 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 40 * 500 * 499 // 2


def test_discs_are_gone_through_once_for_each_place(spark, tmp_path):
    """20,000 points at 448 places: points meet their place's result; 80 cells for each point were shuffled or sorted."""
    n = 20000
    equals_sql(spark, "disc_argmin", tmp_path, embeddings=vectors(7), events=events(n))
    with_joins_of_shuffles(spark, lambda: catalogue.QUERIES["disc_argmin"](spark, str(tmp_path)), 6 * n)


def test_boxes_of_wind_are_worked_out_once_for_each_place_and_time(spark, tmp_path):
    """20,000 points at 832 places and times; up to 72 cells for each point were shuffled."""
    n = 20000
    equals_sql(spark, "wind_half_step", tmp_path, embeddings=vectors(7), events=events(n))
    with_joins_of_shuffles(spark, lambda: catalogue.QUERIES["wind_half_step"](spark, str(tmp_path)), 12 * n)
