"""Neighbourhood operators on image grids (t, y, x, v): fills, blurs, derivatives, resampling, morphology."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import tiles


def across() -> WindowSpec:
    return Window.partitionBy("t", "y").orderBy("x")


def down() -> WindowSpec:
    return Window.partitionBy("t", "x").orderBy("y")


def temporal_fill(grid: DataFrame) -> DataFrame:
    """Missing cells get the mean of what the frames before and after have there; the first and last frame stay as they are.
    Both neighbours are taken as they were before filling. Grids have a row for each cell of each frame."""
    w = Window.partitionBy("y", "x").orderBy("t")
    around = F.array_compact(F.array(F.lag("v").over(w), F.lead("v").over(w)))
    inner = F.lag("t").over(w).isNotNull() & F.lead("t").over(w).isNotNull()
    mean = F.try_divide(F.aggregate("around", F.lit(0.0), lambda a, b: a + b), F.size("around"))
    return grid.withColumns({"around": around, "inner": inner}).withColumn("v", F.when(F.col("v").isNull() & F.col("inner"), mean).otherwise(F.col("v"))).drop("around", "inner")


def spatial_fill(grid: DataFrame, width: int) -> DataFrame:
    """Missing cells by linear interpolation along the frame's cells in row-major order (so across row ends), with the nearest
    value at both ends. A frame without values stays missing.

    A running minimum of the whole frame would sort it in one task; rows are filled first, and only each row's first and last
    known cell go through the frame-wide order.
    """
    at = F.col("y") * width + F.col("x")
    known = F.when(F.col("v").isNotNull(), F.struct(at.alias("at"), F.col("v").alias("v")))
    rows = grid.groupBy("t", "y").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    above = Window.partitionBy("t").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("t").orderBy("y").rowsBetween(1, Window.unboundedFollowing)
    ends = rows.select("t", "y", F.last("last", ignorenulls=True).over(above).alias("above"), F.first("first", ignorenulls=True).over(below).alias("below"))
    left, right = across().rowsBetween(Window.unboundedPreceding, 0), across().rowsBetween(0, Window.unboundedFollowing)
    near = grid.withColumns({"a": F.last(known, ignorenulls=True).over(left), "b": F.first(known, ignorenulls=True).over(right)})
    both = near.join(ends, ["t", "y"]).withColumns({"a": F.coalesce("a", "above"), "b": F.coalesce("b", "below")})
    a, b = F.col("a"), F.col("b")
    between = a["v"] + (b["v"] - a["v"]) * (at - a["at"]) / (b["at"] - a["at"])
    return both.withColumn("v", F.coalesce(F.col("v"), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between))).select(*grid.columns)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights of taps from -h to h, h = truncate * sigma rounded, with the sum 1."""
    h = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-h, h + 1)]
    return [w / sum(raw) for w in raw]


def reflected(i: np.ndarray, n: int) -> np.ndarray:
    """Index mirrored at the border, the border cell included: -1 is 0, n is n - 1, any distance."""
    m = i % (2 * n)
    return np.where(m < n, m, 2 * n - 1 - m)


def clamped(i: np.ndarray, n: int) -> np.ndarray:
    return np.clip(i, 0, n - 1)


EDGES = {"reflect": reflected, "nearest": clamped}


def filter_arrays(
    array: np.ndarray, down: list[float], across: list[float], shape: tuple[int, int], top: int, left: int, height: int, width: int,
    edge: str = "reflect", whole: bool = False, margin: int = 0,
) -> np.ndarray:
    """Haloed arrays (frames, rows, columns) weighed down, then across, to the tile's shape and margin cells around it. Cells beyond the frame
    are taken by edge from within it; a cell that isn't there leaves what it reaches missing."""
    halo = (array.shape[1] - shape[0]) // 2
    for axis, weights, first, n, size in ((1, down, top, height, shape[0]), (2, across, left, width, shape[1])):
        h = len(weights) // 2
        # the frame's rows (columns) that the taps of the cells wanted fall on, as places in the array
        places = EDGES[edge](np.arange(first - margin - h, first + size + margin + h), n) - first + halo
        array = np.take(array, places, axis=axis)
        total = np.zeros(array.shape[:axis] + (size + 2 * margin,) + array.shape[axis + 1 :])
        for k, w in enumerate(weights):
            if w:
                total = total + w * array[(slice(None),) * axis + (slice(k, k + size + 2 * margin),)]
        array = np.trunc(total) if whole else total
    return array


def frame_difference(array: np.ndarray, axis: int, first: int, n: int) -> np.ndarray:
    """Half the difference of the neighbours along an axis, at the frame's border the difference to the one neighbour. array has a margin of
    one cell, which is left; first: place in the frame of the first cell without it."""
    size = array.shape[axis] - 2
    cut = lambda lo, a: np.take(a, range(lo, lo + size), axis=axis)
    before, here, after = (cut(lo, array) for lo in (0, 1, 2))
    at = (first + np.arange(size)).reshape([-1 if k == axis else 1 for k in range(3)])
    found = np.where(at == 0, after - here, np.where(at == n - 1, here - before, (after - before) / 2)) if n > 1 else np.full(here.shape, np.nan)
    other = 3 - axis
    return np.take(found, range(1, found.shape[other] - 1), axis=other)


def gaussian_blur(grid: DataFrame, height: int, width: int, sigma: float = 2.0, edge: str = "reflect", whole: bool = False) -> DataFrame:
    """Separable Gaussian blur, rows of cells down first, then across, by tiles. edge: reflect or nearest. whole: values are cut to integers
    after each pass, as integer images are. A missing cell, or one without a row, leaves what it reaches missing."""
    w = gaussian_weights(sigma)

    def blur(arrays: list[np.ndarray], shape: tuple[int, int], top: int, left: int) -> list[np.ndarray]:
        return [filter_arrays(arrays[0], w, w, shape, top, left, height, width, edge, whole)]

    return tiles.apply_tiles(grid, ["v"], len(w) // 2, height, width, blur, "v double")


def central_difference(grid: DataFrame) -> DataFrame:
    """dy and dx of each cell: half the difference of its neighbours, at a border the difference to the one neighbour."""

    def along(w) -> Column:
        before, after, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
        first, last = F.lag("y").over(w).isNull(), F.lead("y").over(w).isNull()
        return F.when(first & last, None).when(first, after - v).when(last, v - before).otherwise((after - before) / 2)

    return grid.withColumns({"dy": along(down()), "dx": along(across())})


def sobel(grid: DataFrame, height: int, width: int, whole: bool = False) -> DataFrame:
    """(t, y, x, dy, dx) of the 3 x 3 Sobel filter, borders reflected, by tiles."""
    step, smooth = [-1.0, 0.0, 1.0], [1.0, 2.0, 1.0]

    def both(arrays: list[np.ndarray], shape: tuple[int, int], top: int, left: int) -> list[np.ndarray]:
        return [filter_arrays(arrays[0], down, across, shape, top, left, height, width, whole=whole) for down, across in ((step, smooth), (smooth, step))]

    return tiles.apply_tiles(grid, ["v"], 1, height, width, both, "dy double, dx double")


def resample_bilinear(grid: DataFrame, height: int, width: int, factor: float) -> DataFrame:
    """Frames resized by factor, their sides cut to whole cells: each cell mixes the two nearest rows and columns of the source
    by its centre's place, borders clamped. A missing source cell leaves what it has a part in missing."""
    for name, side in (("height", height), ("width", width)):
        if not isinstance(side, int) or isinstance(side, bool) or side < 1:
            raise ValueError(f"{name} must be a whole number of cells, 1 or more: {side!r}")
    if not isinstance(factor, (int, float)) or isinstance(factor, bool) or not factor > 0 or int(min(height, width) * factor) < 1:
        raise ValueError(f"factor must be a number that leaves a cell a side at least: {factor!r}")
    if dict(grid.dtypes).get("v") not in ("double", "float", "int", "bigint", "smallint", "tinyint"):
        raise ValueError("frames must be relations (t, y, x, v) with numbers in v")
    spark = grid.sparkSession

    def taps(n: int, name: str) -> DataFrame:
        m = int(n * factor)
        place = (F.col("id") + 0.5) * n / m - 0.5
        low = F.floor(place)
        two = F.array(
            F.struct(F.greatest(low, F.lit(0)).alias("src"), (1 - (place - low)).alias("w")),
            F.struct(F.least(low + 1, F.lit(n - 1)).alias("src"), (place - low).alias("w")),
        )
        one = spark.range(m).select(F.col("id").cast("int").alias(name), F.explode(two).alias("tap"))
        return one.select(name, F.col("tap.src").cast("int").alias("src"), F.col("tap.w").alias("w")).where("w > 0")

    def mix(cells: DataFrame, name: str, other: str, n: int) -> DataFrame:
        joined = cells.withColumnRenamed(name, "src").join(F.broadcast(taps(n, name)), "src")
        some_missing = F.count_if(F.col("v").isNull()) > 0
        return joined.groupBy("t", name, other).agg(F.when(~some_missing, F.sum(F.col("w") * F.col("v"))).alias("v"))

    return mix(mix(grid.select("t", "y", "x", "v"), "x", "y", width), "y", "x", height).select("t", "y", "x", "v")


def erode(cells: DataFrame, iterations: int = 5) -> DataFrame:
    """cells: (t, y, x) of what is set. Cells whose whole diamond is set; beyond the frame nothing is.

    A cell knows how far its run of set cells goes on both sides, so it says to each row of the diamond whether it fills that row: at most
    2 * iterations + 1 rows for each cell, not the diamond's area.
    """
    k = iterations
    island = cells.distinct().withColumn("island", F.col("x") - F.row_number().over(across()))
    run = Window.partitionBy("t", "y", "island")
    reach = island.withColumn("reach", F.least(F.col("x") - F.min("x").over(run), F.max("x").over(run) - F.col("x"), F.lit(k)))
    fills = F.filter(F.sequence(F.lit(-k), F.lit(k)), lambda dy: F.abs(dy) >= k - F.col("reach"))
    filled = reach.select("t", F.explode(F.transform(fills, lambda dy: F.col("y") + dy)).alias("y"), "x")
    return filled.groupBy("t", "y", "x").count().where(F.col("count") == 2 * k + 1).select("t", "y", "x")


def dilate(cells: DataFrame, grid: DataFrame, iterations: int = 10) -> DataFrame:
    """Cells of grid that a diamond about a set cell reaches. One pass spreads across, one down, so a cell writes
    2 * iterations + 1 rows twice, not the diamond's area: the budget left over goes along."""
    k = iterations
    wide = cells.select("t", "y", F.explode(F.sequence(F.col("x") - k, F.col("x") + k)).alias("nx"), "x")
    best = wide.groupBy("t", "y", "nx").agg(F.min(F.abs(F.col("nx") - F.col("x"))).alias("used"))
    down = best.select("t", F.explode(F.sequence(F.col("y") - (k - F.col("used")), F.col("y") + (k - F.col("used")))).alias("y"), F.col("nx").alias("x")).distinct()
    return grid.select("t", "y", "x").join(down, ["t", "y", "x"], "left_semi")
