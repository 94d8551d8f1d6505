"""Dense neighbourhood work on tiles with a halo: each tile is a bounded array, and rows written grow with the halo alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 64
#: Cells of small frames that are worked on at once.
GROUP_CELLS = TILE * TILE


def haloed(cells: DataFrame, halo: int, height: int, width: int, tile: int = TILE, wrap: bool = False) -> DataFrame:
    """cells (t, y, x, ...) once for each tile (ty, tx) that they are in or within halo of. wrap: columns go round, so that a cell also
    stands at x + width and x - width."""

    def reach(c, n: int):
        low, high = F.floor((c - halo) / tile), F.floor((c + halo) / tile)
        first, last = F.greatest(low, F.lit(0)), F.least(high, F.lit((n - 1) // tile))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    shifts = F.explode(F.array(*[F.lit(s) for s in ((-width, 0, width) if wrap else (0,))]))
    shifted = cells.withColumn("shift", shifts).withColumn("x", F.col("x") + F.col("shift")).drop("shift")
    return shifted.withColumn("ty", reach(F.col("y"), height)).withColumn("tx", reach(F.col("x"), width))


def windows(shape: tuple[int, int], halo: int, offsets: list[tuple[int, int]]) -> Iterator[tuple]:
    """For each offset, where the tile's cells find that neighbour in the haloed arrays."""
    h, w = shape
    for dy, dx in offsets:
        yield ..., slice(halo + dy, halo + dy + h), slice(halo + dx, halo + dx + w)


def runs_of(dys: np.ndarray, dxs: np.ndarray) -> list[tuple[int, int, int]]:
    """(dy, first dx, last dx) of each row of a neighbourhood whose rows have no holes."""
    return [(int(dy), int(dxs[dys == dy].min()), int(dxs[dys == dy].max())) for dy in np.unique(dys)]


def run_sums(values: np.ndarray, runs: list[tuple[int, int, int]], halo: int, shape: tuple[int, int]) -> np.ndarray:
    """Sums of values, haloed arrays without NaN, over a neighbourhood about each cell of the tiles: two running sums of a row for each run, whatever its length."""
    h, w = shape
    along = np.concatenate([np.zeros((*values.shape[:2], 1)), np.cumsum(values, axis=2)], axis=2)
    out = np.zeros((len(values), h, w))
    for dy, first, last in runs:
        rows = along[:, halo + dy : halo + dy + h]
        out += rows[:, :, halo + last + 1 : halo + last + 1 + w]
        out -= rows[:, :, halo + first : halo + first + w]
    return out


def run_minima(values: np.ndarray, runs: list[tuple[int, int, int]], halo: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, dy, dx) over a neighbourhood about each cell of the tiles, the first in row-major order among equals; values: haloed, missing ones infinite.

    Tables hold the least of 1, 2, 4, ... cells from each on, with its column, so a run of any length is two of them that overlap."""
    h, w = shape
    columns = values.shape[2]
    levels = [(values, np.broadcast_to(np.arange(columns, dtype=np.int32), values.shape))]
    longest = max(last - first + 1 for _, first, last in runs)
    while 2 ** len(levels) <= longest:
        (v, at), n = levels[-1], 2 ** (len(levels) - 1)
        right = v[:, :, n:] < v[:, :, :-n]  # strictly, so that the first stays among equals
        levels.append((np.where(right, v[:, :, n:], v[:, :, :-n]), np.where(right, at[:, :, n:], at[:, :, :-n])))
    best, to_y, to_x = np.full((len(values), h, w), np.inf), np.zeros((len(values), h, w), np.int32), np.zeros((len(values), h, w), np.int32)
    here = np.arange(halo, halo + w, dtype=np.int32)
    for dy, first, last in runs:
        level = (last - first + 1).bit_length() - 1
        v, at = (x[:, halo + dy : halo + dy + h] for x in levels[level])
        one, two = (slice(halo + start, halo + start + w) for start in (first, last + 1 - 2**level))
        right = v[:, :, two] < v[:, :, one]
        least, column = np.where(right, v[:, :, two], v[:, :, one]), np.where(right, at[:, :, two], at[:, :, one])
        better = least < best
        best, to_y, to_x = np.where(better, least, best), np.where(better, dy, to_y), np.where(better, column - here, to_x)
    return best, to_y, to_x


def apply_tiles(cells: DataFrame, columns: list[str], halo: int, height: int, width: int, kernel: Callable, out: str, tile: int = TILE, wrap: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(t, y, x, out) of every cell of the tiles. kernel(arrays, shape, top, left) gets each column as arrays with the halo around them,
    (frames, rows, columns), NaN where there is nothing, and returns arrays of the frames' number and the tile's shape, one for each name in
    out ("name type, ..."). only: (t, ty, tx) of tiles to work out; without it all. A cell's columns may come in several rows. Frames of less than a tile come many at once: a group has the cells of a few tiles at most."""
    names = [c.split()[0] for c in out.split(",")]
    together = max(1, GROUP_CELLS // (height * width)) if height <= tile and width <= tile else 1

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, ty, tx = (int(k) for k in key)
        top, left = ty * tile, tx * tile
        shape = min(tile, height - top), min(tile, width - left)
        t, place = np.unique(rows["t"].to_numpy(), return_inverse=True)
        y, x = rows["y"].to_numpy() - top + halo, rows["x"].to_numpy() - left + halo
        inside = (y < shape[0] + 2 * halo) & (x < shape[1] + 2 * halo)
        arrays = []
        for c in columns:
            array = np.full((len(t), shape[0] + 2 * halo, shape[1] + 2 * halo), np.nan)
            values = rows[c].to_numpy(dtype=float)
            there = inside & ~np.isnan(values)
            array[place[there], y[there], x[there]] = values[there]
            arrays.append(array)
        found = kernel(arrays, shape, top, left)
        frame, j, i = np.mgrid[: len(t), top : top + shape[0], left : left + shape[1]]
        return pd.DataFrame({"t": t[frame.ravel()], "y": j.ravel(), "x": i.ravel()} | {n: a.ravel() for n, a in zip(names, found, strict=True)})

    tiles = haloed(cells.select("t", "y", "x", *columns), halo, height, width, tile, wrap)
    if only is not None:
        tiles = tiles.join(only, ["t", "ty", "tx"], "left_semi")
    keys = ["chunk", "ty", "tx"]
    # a number of partitions by name: tiles are few bytes and much work, and Spark would bring small partitions together
    number = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.withColumn("chunk", F.floor(F.col("t") / together)).repartition(number, *keys)
    return dealt.groupBy(*keys).applyInPandas(one, f"t int, y int, x int, {out}")
