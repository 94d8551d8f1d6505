"""The whole job as a stream of frames: cells come in any order, systems' points go out frame by frame.

Cells are held by tile, as keyed state, until a frame's neighbours in time have come, so gaps can be filled in time. A tile that is filled goes to the
batch of its trigger, which writes it; frames of which all tiles have come are mapped, and the fold goes on from the systems that the last batch
left. What a batch writes is a folder with its number, written over when the batch is run again, so a restart repeats nothing and
loses nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import dav, stencil, tiles
from . import tracker

#: Frames are held on local disk, and their keys in families of columns; Spark's default store has neither.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CELLS = "t int, y int, x int, v double"
WAITS = "y int, x int, since int"
SYSTEMS = "domain int, system_id string, time_start int, y int, x int, n_points int, n_positive int, since_positive int, active boolean"


class TileFill(StatefulProcessor):
    """Holds a tile's frames until the ones before and after are whole, and gives each filled in time, as stencil.temporal_fill does: the first and
    last frame stay as they are. Frames are numbered from 0; the last needs no successor. A frame that doesn't come for patience milliseconds is left
    out: those about it are then neighbours. Cells that come again, or after their frame went out, are passed over."""

    def __init__(self, height: int, width: int, tile: int, last: int | None, patience: int | None) -> None:
        self.height, self.width, self.tile, self.last, self.patience = height, width, tile, last, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "t int", "y array<int>, x array<int>, v array<double>")
        self.mark = handle.getValueState("mark", "before int, next int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, start = self.mark.get() if self.mark.exists() else (-1, 0)
        for t, cells in pd.concat(list(rows)).groupby("t"):
            if t < start:
                continue
            if self.held.containsKey((int(t),)):
                y, x, v = self.held.getValue((int(t),))
                cells = pd.concat([pd.DataFrame({"y": list(y), "x": list(x), "v": list(v)}), cells[["y", "x", "v"]]])
            cells = cells.drop_duplicates(["y", "x"]).sort_values(["y", "x"])
            self.held.updateValue((int(t),), (cells["y"].astype(int).tolist(), cells["x"].astype(int).tolist(), cells["v"].astype(float).tolist()))
        if self.patience is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield from self.told(key, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.told(key, True)

    def told(self, key: tuple, waited: bool) -> Iterator[pd.DataFrame]:
        ty, tx = (int(k) for k in key)
        cells = min(self.tile, self.height - ty * self.tile) * min(self.tile, self.width - tx * self.tile)
        frames = {int(k[0]): tuple(map(np.array, self.held.getValue(k))) for k in list(self.held.keys())}
        whole = sorted(t for t, (y, _, _) in frames.items() if len(y) == cells)
        before, following = self.mark.get() if self.mark.exists() else (-1, 0)
        while later := [t for t in whole if t > before]:
            t, after = later[0], later[1] if len(later) > 1 else None
            if t != following and not waited or t != self.last and (after is None or after != t + 1 and not waited):
                break
            y, x, v = frames[t]
            if before >= 0 and t != self.last:
                around = np.stack([frames[before][2], frames[after][2]]).astype(float)
                there = ~np.isnan(around)
                mean = np.where(there, around, 0.0).sum(axis=0) / np.maximum(1, there.sum(axis=0))
                v = np.where(np.isnan(v.astype(float)) & there.any(axis=0), mean, v.astype(float))
            yield pd.DataFrame({"t": np.full(len(y), t, dtype=np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), "v": v.astype(float)})
            if before >= 0:
                self.held.removeKey((before,))
            before, following = t, t + 1
            self.mark.update((before, following))


def fill_stream(cells: DataFrame, height: int, width: int, last: int | None = None, patience: int | None = None, tile: int = tiles.TILE) -> DataFrame:
    """(t, y, x, v) of a stream of cells (t, y, x, v; a row for each cell, missing ones too), in any order, filled in time. last: the number of the
    last frame, where it is known. patience: milliseconds to wait for a frame; without it until it comes."""
    keyed = cells.select(*[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in CELLS.split(", "))])
    keyed = keyed.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)}).groupBy("ty", "tx")
    mode = "None" if patience is None else "ProcessingTime"
    filled = keyed.transformWithStateInPandas(TileFill(height, width, tile, last, patience), CELLS, "Append", mode)
    return filled.withColumn("v", F.nullif("v", F.lit(float("nan"))))


def fold_on(events: DataFrame, systems: DataFrame, s: tracker.Settings, first: int) -> DataFrame:
    """Points of the events' frames, and the systems that are left then: rows with point or system set. systems: SYSTEMS, that the frames before left."""
    point, system = "struct<system_id string, t int, y int, x int, cdav double, positive boolean, active boolean>", f"struct<{SYSTEMS.split(', ', 1)[1]}>"
    fields = [f.name for f in tracker.System.__dataclass_fields__.values()]

    def one(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        held = [tracker.System(r.system_id, int(r.time_start), int(r.y), int(r.x), int(r.n_points), int(r.n_positive), int(r.since_positive), bool(r.active)) for r in before.itertuples()]
        points = tracker.fold(held, rows, s, first)
        out = [(int(key[0]), i, p, None) for i, p in enumerate(points)]
        # systems that ended say nothing any more
        out += [(int(key[0]), i, None, {f: getattr(x, f) for f in fields}) for i, x in enumerate(held) if x.active]
        return pd.DataFrame(out, columns=["domain", "no", "point", "system"])

    return events.groupBy("domain").cogroup(systems.groupBy("domain")).applyInPandas(one, f"domain int, no int, point {point}, system {system}")


def track_frames(
    cells: DataFrame, land: DataFrame, radius: int, s: tracker.Settings, work: str, last: int | None = None, patience: int | None = None, first: int = 1, **trigger
) -> StreamingQuery:
    """Starts tracking a stream of cells of one domain (fill_stream); points_of(spark, work) are the points so far. They are what the batch job gives for the
    frames that have come: frames filled in time, variances of disc radius, events, fold. work: a folder that all executors share.

    Frames of which all cells are there are worked out in order, in the batch in which the last cell that they wait for comes; the frame before is read again for
    its places, and its variances are kept.
    """
    spark = cells.sparkSession
    height, width = s.height, s.width

    def folder(name: str, batch: int) -> str:
        return f"{work}/{name}/batch={batch}"

    def read(name: str, schema: str, batch: int) -> DataFrame:
        """What earlier batches wrote."""
        return spark.read.schema(f"{schema}, batch long").option("basePath", f"{work}/{name}").parquet(f"{work}/{name}").where(F.col("batch") <= batch)

    def one(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy("t").parquet(folder("filled", batch))
        state = read("done", "t int", batch - 1).agg(F.max("t")).first()[0] if batch else None
        done = -1 if state is None else state
        filled = read("filled", CELLS, batch).where(F.col("t") >= done).select("t", "y", "x", "v")
        counts = {r["t"]: r["count"] for r in filled.groupBy("t").count().collect()}
        ready = []
        for t in sorted(t for t in counts if t > done):
            if counts[t] < height * width or (patience is None and t != (ready[-1] if ready else done) + 1):
                break
            ready.append(t)
        spark.createDataFrame([(t,) for t in [done, *ready]], "t int").coalesce(1).write.mode("overwrite").parquet(folder("done", batch))
        systems = read("systems", SYSTEMS, batch - 1).where(F.col("batch") == batch - 1).drop("batch") if batch else spark.createDataFrame([], SYSTEMS)
        waits = read("waits", WAITS, batch - 1).groupBy("y", "x").agg(F.min("since").alias("since")) if batch else None
        if not ready:
            systems.write.mode("overwrite").parquet(folder("systems", batch))
            spark.createDataFrame([], WAITS).write.mode("overwrite").parquet(folder("waits", batch))
            return
        new = filled.where(F.col("t").isin(ready))
        dav.dav_map(new, radius, height, width).write.mode("overwrite").parquet(folder("dav", batch))
        values = read("dav", "t int, y int, x int, dav double", batch).where(F.col("t").isin([done, *ready])).drop("batch")
        temperature = stencil.spatial_fill(filled.where(F.col("t").isin([done, *ready])), width)
        events, waiting = tracker.events_and_waits(temperature, values, land, s, waits=waits)
        folded = fold_on(events.where(F.col("t").isin(ready)), systems, s, first).persist()
        folded.where("point is not null").select("domain", "no", "point.*").write.mode("overwrite").parquet(folder("points", batch))
        folded.where("system is not null").orderBy("no").select("domain", "system.*").coalesce(1).write.mode("overwrite").parquet(folder("systems", batch))
        waiting.select("y", "x", F.col("since").cast("int").alias("since")).write.mode("overwrite").parquet(folder("waits", batch))
        folded.unpersist()

    filled = fill_stream(cells, height, width, last, patience)
    writer = filled.writeStream.foreachBatch(one).option("checkpointLocation", f"{work}/checkpoint")
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)  # a query keeps the settings that it was started with
    try:
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        spark.conf.set(STORE[0], before)


def points_of(spark, work: str) -> DataFrame:
    """tracker.POINT_SCHEMA of all batches so far."""
    return spark.read.schema(tracker.POINT_SCHEMA).option("recursiveFileLookup", "true").parquet(os.path.join(work, "points"))
