"""The tracker: systems that follow minima of variance from frame to frame.

The work on pixels (variance maps, clusters, land, disc means and disc minima) is done for all frames at once by DataFrame plans. What
depends on the order of frames is a small fold over places: each frame's independent clusters, and for each cell that a system can stand on
where it moves next. The fold runs as one batch group for each domain, or as a streaming query with keyed state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import clusters, patches
from ..session import checkpoint_dir

POINT_SCHEMA = "domain int, system_id string, t int, y int, x int, cdav double, positive boolean, active boolean"


@dataclass(frozen=True)
class Settings:
    """Distances in kilometres, res_km kilometres a pixel. corrected: also end systems that move out, merge within the full distance, and, on a global grid,
    see across the date line (literally, distance over squared resolution is compared, a system that moved out waits where it was, and components and
    distances end at the last column)."""

    height: int
    width: int
    res_km: float = 10.0
    is_global: bool = False
    low_dav: float = 2000.0
    warm: float = 273.0
    search_km: float = 150.0
    cloud_km: float = 250.0
    apart_km: float = 300.0
    window: int = 48
    erosion: int = 5
    corrected: bool = False

    @property
    def search(self) -> int:
        return int(self.search_km / self.res_km)

    @property
    def cloud(self) -> int:
        return int(self.cloud_km / self.res_km)

    @property
    def apart(self) -> float:
        return self.apart_km / self.res_km

    @property
    def ring(self) -> int | None:
        """Columns that distances go round."""
        return self.width if self.corrected and self.is_global else None

    @property
    def merge2(self) -> float:
        return (self.apart_km / self.res_km) ** 2 if self.corrected else self.apart_km / self.res_km**2


@dataclass
class System:
    system_id: str
    time_start: int
    y: int
    x: int
    n_points: int = 1
    n_positive: int = 1
    since_positive: int = 0
    active: bool = True

    def update(self, y: int, x: int, positive: bool) -> None:
        self.y, self.x = y, x
        self.n_points += 1
        self.n_positive += positive
        self.since_positive = 0 if positive else self.since_positive + 1

    def is_active(self, window: int) -> bool:
        """Asking ends a system whose last window points were all negative; it stays ended."""
        if self.since_positive >= window:
            self.active = False
        return self.active


@dataclass
class Frame:
    """What a frame says of places: moves, from a place to the next; cells, (variance, disc mean); births, independent clusters in order
    with (y, x, variance, is on land, disc mean)."""

    moves: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    cells: dict[tuple[int, int], tuple[float | None, float | None]] = field(default_factory=dict)
    births: list[tuple[int, int, float, bool, float | None]] = field(default_factory=list)


def system_id(t: int, y: int, x: int) -> str:
    return f"{xxhash.xxh64_intdigest(f'{t}:{y}:{x}') % 10**10:010d}"


class Standing:
    """Active systems of which no two are too close, taken in one by one in their order, by squares that only the squares around are close to.

    Of two that are too close the one with fewer positives ends; of equals, the earlier. Each one meets the few that stand near it, since of those that
    came before and were too close to another only one still stands; that gives what going through all pairs in their order gives.
    """

    def __init__(self, s: Settings) -> None:
        self.merge2, self.ring, self.side = s.merge2, s.ring, int(math.sqrt(s.merge2)) + 1
        self.columns = max(1, s.ring // self.side) if s.ring else 0
        self.squares: dict[tuple[int, int], list[tuple]] = {}
        self.met = 0

    def square(self, y: int, x: int) -> tuple[int, int]:
        return y // self.side, x % self.ring * self.columns // self.ring if self.ring else x // self.side

    def around(self, row: int, column: int) -> list[list[tuple]]:
        columns = {(column + d) % self.columns for d in (-1, 0, 1)} if self.ring else (column - 1, column, column + 1)
        return [self.squares[r, c] for r in (row - 1, row, row + 1) for c in columns if (r, c) in self.squares]

    def add(self, y: int, x: int, n_positive: int, system: object) -> list:
        """Takes a system in; returns those that end by it, itself among them if it does."""
        at = self.square(y, x)
        ended = []
        for other in sorted((o for near in self.around(*at) for o in near if clusters.distance2(o[1], o[2], y, x, self.ring) < self.merge2), key=lambda o: o[0]):
            if other[3] > n_positive:
                return [*ended, system]
            self.squares[self.square(other[1], other[2])].remove(other)
            ended.append(other[4])
        self.met += 1
        self.squares.setdefault(at, []).append((self.met, y, x, n_positive, system))
        return ended

    def systems(self) -> list:
        """Those that stand."""
        return [o[4] for near in self.squares.values() for o in near]


def merge(systems: list[System], s: Settings) -> None:
    """Of two active systems that are too close, the one with fewer positives ends; of equals, the earlier. All are asked whether they are active, but the
    last one only if another stands that it could meet."""
    standing = Standing(s)
    for i, system in enumerate(systems):
        if (i < len(systems) - 1 or standing.systems()) and system.is_active(s.window):
            for ended in standing.add(system.y, system.x, system.n_positive, system):
                ended.active = False


def step(systems: list[System], t: int, frame: Frame, s: Settings) -> list[dict]:
    """One frame: systems move, close ones merge, new clusters become systems. Returns the points added; changes systems."""
    points, here = [], []
    for system in systems:
        if not system.is_active(s.window):
            continue
        y, x = frame.moves.get((system.y, system.x), (system.y, system.x))
        if y in (0, s.height) or (not s.is_global and x in (0, s.width)):
            system.active = system.active and not s.corrected
            continue
        dav, mean = frame.cells.get((y, x), (None, None))
        positive = mean is not None and mean < s.warm and dav is not None and dav < s.low_dav
        system.update(y, x, positive)
        points.append({"system_id": system.system_id, "t": t, "y": y, "x": x, "cdav": dav, "positive": positive})
        here.append((y, x))
    merge(systems, s)
    for y, x, dav, land, mean in frame.births:
        if any(clusters.distance2(y, x, v, w, s.ring) < s.apart**2 for v, w in here) or land or (mean is not None and mean > s.warm):
            continue
        systems.append(System(system_id(t, y, x), t, y, x))
        points.append({"system_id": systems[-1].system_id, "t": t, "y": y, "x": x, "cdav": dav, "positive": True})
    alive = {x.system_id: x.active for x in systems}
    return [p | {"active": alive[p["system_id"]]} for p in points]


def frame_events(temperature: DataFrame, dav: DataFrame, land: DataFrame, s: Settings, domains: DataFrame | None = None, lookup: patches.LandLookup | None = None) -> DataFrame:
    """(domain, t, kind, y, x, to_y, to_x, dav, mean_v, is_land, no): what each frame says of places; kind: birth, move (from a place a
    system can stand on, to the next), or cell (variance and disc mean of a place a system can come to).

    A system stands where the frame before had a cluster or where that frame's moves lead (its local minima), or it waits where it moved
    out. So the fold gets these places alone, some thousand a frame, though minima and means are worked out for all cells, by tiles.
    The frame before is that of the same domain, whatever the numbers between them.

    domains: (t, domain) of each frame, whole numbers, where frames are of several areas or seasons, which are tracked each by itself and
    side by side, in any order of t; t then counts a domain's frames from 0. Without it all frames are domain 0 and keep their t.

    land: (lat_idx, lon_idx, is_land) of the frames' own pixels, or, with lookup, of a mask with axes of its own.
    """
    return events_and_waits(temperature, dav, land, s, domains, lookup)[0]


def events_and_waits(
    temperature: DataFrame, dav: DataFrame, land: DataFrame, s: Settings, domains: DataFrame | None = None, lookup: patches.LandLookup | None = None, waits: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """frame_events, and (domain, y, x, since) of the places where systems may wait. waits: (y, x, since) that earlier frames left, of one domain."""
    checkpoint_dir(dav.sparkSession)
    dav = dav.checkpoint()  # read four times below
    found = clusters.find_clusters(dav, s.width, s.low_dav, s.erosion, ring=s.ring is not None)
    births = clusters.greedy_independent(found, s.apart, s.ring).withColumn("no", F.col("label"))
    moves = patches.all_moves(dav, s.search, s.height, s.width, s.is_global).select("t", "y", "x", F.col("new_y").alias("to_y"), F.col("new_x").alias("to_x")).checkpoint()
    means = patches.all_means(temperature, s.cloud, s.height, s.width, s.is_global)
    targets = moves.select("t", F.col("to_y").alias("y"), F.col("to_x").alias("x")).distinct()
    # a row for each frame: its domain, its number there, and the domain's next frame
    frames = dav.select("t").distinct().withColumn("domain", F.lit(0)) if domains is None else domains.select("t", F.col("domain").cast("int").alias("domain"))
    in_order = Window.partitionBy("domain").orderBy("t")
    order = frames.withColumns({"number": (F.row_number().over(in_order) - 1).cast("int"), "next": F.lead("t").over(in_order)})
    stood = targets.unionByName(births.select("t", "y", "x")).join(order.select("t", "next"), "t").select(F.col("next").alias("t"), "y", "x").distinct()
    moved = stood.join(moves, ["t", "y", "x"])
    out = F.col("to_y").isin(0, s.height) | (F.lit(not s.is_global) & F.col("to_x").isin(0, s.width))
    waiting = moved.where(out).join(order.select("t", "domain"), "t").select("domain", "y", "x", F.col("t").alias("since"))
    if waits is not None:
        waiting = waiting.unionByName(waits.select(F.lit(0).alias("domain"), "y", "x", "since"))
    waiting = waiting.groupBy("domain", "y", "x").agg(F.min("since").alias("since"))
    waited = moves.join(waiting, ["y", "x"]).where("t > since").join(order.select("t", "domain"), ["t", "domain"])
    moved = moved.unionByName(waited.select(moved.columns)).distinct()
    cells = targets.join(dav.select("t", "y", "x", "dav"), ["t", "y", "x"]).join(means, ["t", "y", "x"], "left")
    born = births.join(means, ["t", "y", "x"], "left")
    born = patches.land_flag(born, land) if lookup is None else lookup.flag(born, land)
    none = F.lit(None)

    def event(kind: str, df: DataFrame) -> DataFrame:
        kinds = {"to_y": "int", "to_x": "int", "dav": "double", "mean_v": "double", "is_land": "boolean", "no": "long"}
        there = {c: F.col(c) if c in df.columns else none for c in kinds}
        return df.select(F.lit(0).alias("domain"), "t", F.lit(kind).alias("kind"), "y", "x", *[there[c].cast(k).alias(c) for c, k in kinds.items()])

    events = event("move", moved).unionByName(event("cell", cells)).unionByName(event("birth", born))
    if domains is None:
        return events, waiting
    columns = events.columns
    return events.drop("domain").join(order.drop("next"), "t").drop("t").withColumnRenamed("number", "t").select(*columns), waiting


def read_frame(rows: pd.DataFrame) -> Frame:
    def number(v) -> float | None:
        return None if v is None or (isinstance(v, float) and math.isnan(v)) or pd.isna(v) else float(v)

    frame = Frame()
    for r in rows[rows["kind"] == "move"].itertuples():
        frame.moves[r.y, r.x] = (int(r.to_y), int(r.to_x))
    for r in rows[rows["kind"] == "cell"].itertuples():
        frame.cells[r.y, r.x] = (number(r.dav), number(r.mean_v))
    for r in rows[rows["kind"] == "birth"].sort_values("no").itertuples():
        frame.births.append((int(r.y), int(r.x), float(r.dav), bool(r.is_land), number(r.mean_v)))
    return frame


def fold(systems: list[System], rows: pd.DataFrame, s: Settings, first: int) -> list[dict]:
    points: list[dict] = []
    for t, frame in rows.groupby("t"):
        if t >= first:
            points += step(systems, int(t), read_frame(frame), s)
    return points


def _points(domain: int, points: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(points, columns=["system_id", "t", "y", "x", "cdav", "positive", "active"])
    out.insert(0, "domain", domain)
    return out


def track(events: DataFrame, s: Settings, first: int = 1) -> DataFrame:
    """Track points of all systems, POINT_SCHEMA, folded over the frames of each domain from first on. active: after that frame.

    A domain's events pass through one task in the order of frames, a batch at a time; what it holds is its systems and one frame.
    """

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        systems: dict[int, list[System]] = {}
        waiting: list[pd.DataFrame] = []

        def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for domain, part in rows.groupby("domain", sort=False):
                yield _points(int(domain), fold(systems.setdefault(int(domain), []), part, s, first))

        for batch in batches:
            rows = pd.concat([*waiting, batch]) if waiting else batch
            last = (rows["domain"] == rows["domain"].iloc[-1]) & (rows["t"] == rows["t"].iloc[-1]) if len(rows) else []
            waiting = [rows[last]] if len(rows) else []
            if len(rows):
                yield from run(rows[~last])
        if waiting:
            yield from run(waiting[0])

    return events.repartition("domain").sortWithinPartitions("domain", "t").mapInPandas(one, POINT_SCHEMA)


def track_stream(events: DataFrame, s: Settings, first: int = 1) -> DataFrame:
    """track for a stream of events: frames must come in order, each within one batch. The systems are the keyed state."""
    state_schema = "system_id array<string>, time_start array<int>, y array<int>, x array<int>, n_points array<int>, n_positive array<int>, since_positive array<int>, active array<boolean>"
    fields = [f.name for f in System.__dataclass_fields__.values()]

    def one(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        systems = [System(*values) for values in zip(*state.get, strict=True)] if state.exists else []
        points = fold(systems, pd.concat(list(batches)), s, first)
        state.update(tuple([asdict(x)[f] for x in systems] for f in fields))
        yield _points(int(key[0]), points)

    return events.groupBy("domain").applyInPandasWithState(one, POINT_SCHEMA, state_schema, "append", "NoTimeout")


def systems_of(points: DataFrame) -> DataFrame:
    """(domain, system_id, time_start, duration, y, x, active): each system with its last place."""
    return points.groupBy("domain", "system_id").agg(
        F.min("t").alias("time_start"), F.count(F.lit(1)).alias("duration"), F.max_by(F.struct("y", "x"), "t").alias("last"), F.max_by("active", "t").alias("active")
    ).select("domain", "system_id", "time_start", "duration", "last.y", "last.x", "active")


def merge_kills(systems: DataFrame, s: Settings) -> DataFrame:
    """systems (t, no, y, x, n_positive), all active, with killed: those that merging ends, by frame and in order of no.

    A frame's systems pass through one task in their order, a batch at a time; what it holds is one batch and the systems that stand, of which no two are close.
    """
    columns = ["t", "no", "y", "x", "n_positive"]

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, standing = None, Standing(s)
        for rows in batches:
            ended, stood = [], []
            for row in zip(*(rows[c].tolist() for c in columns), strict=True):
                if row[0] != frame:
                    stood += standing.systems()
                    frame, standing = row[0], Standing(s)
                ended += standing.add(row[2], row[3], row[4], row)
            yield pd.DataFrame(stood + ended, columns=columns).assign(killed=[False] * len(stood) + [True] * len(ended))
        yield pd.DataFrame(standing.systems(), columns=columns).assign(killed=False)

    # a number of partitions by name: systems are few bytes and much work, and Spark would bring small partitions together
    number = int(systems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = systems.select(*[F.col(c).cast("int").alias(c) for c in columns]).repartition(number, "t").sortWithinPartitions(*columns)
    return dealt.mapInPandas(one, "t int, no int, y int, x int, n_positive int, killed boolean")


def annotated_layer(grid: DataFrame, dav: DataFrame, points: DataFrame, known: DataFrame, warm: float = 273.0, highest: float = 2450.0) -> DataFrame:
    """(t, layer, y, x, value, label): rows to draw over images: variances near cold cloud, systems (value 1 if positive), known storms."""
    from ..operators.stencil import dilate

    cold = grid.where(F.col("v") < warm).select("t", "y", "x")
    shown = dav.where(F.col("dav") < highest).join(dilate(cold, grid, 10), ["t", "y", "x"], "left_semi")
    text = F.lit(None).cast("string")
    return (
        shown.select("t", F.lit("dav").alias("layer"), "y", "x", F.col("dav").alias("value"), text.alias("label"))
        .unionByName(points.select("t", F.lit("system").alias("layer"), "y", "x", F.col("positive").cast("double").alias("value"), F.col("system_id").alias("label")))
        .unionByName(known.select("t", F.lit("known").alias("layer"), "y", "x", F.lit(None).cast("double").alias("value"), F.col("name").alias("label")))
    )
