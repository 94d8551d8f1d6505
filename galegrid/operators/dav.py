"""Deviation-angle variance: how far gradients about a pixel are from pointing along its rays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import masks
from ..functions.angles import coarse_angle, fold_angle, gradient_angle, wrap_angle
from ..session import checkpoint_dir
from . import stencil, tiles

#: Rows that the offset join may write before the tiled form is taken.
JOIN_ROWS = 50_000_000
#: Pairs of cells that are held at once where few cells of a tile are wanted.
PAIRS = 500_000
#: What a gathered cell costs more than one that is shifted, about.
GATHERED = 10
#: Wanted cells whose tiles and frames, some for each at most, are sent to all tasks; those of more meet the grid by a shuffle.
BROADCAST_CELLS = 100_000


def gradients(grid: DataFrame) -> DataFrame:
    """(t, y, x, g): direction of the steepest fall."""
    d = stencil.central_difference(grid)
    return d.select("t", "y", "x", gradient_angle(F.col("dy"), F.col("dx")).alias("g"))


def smooth_gradients(grid: DataFrame, height: int, width: int, sigma: float = 2.0, only: DataFrame | None = None) -> DataFrame:
    """Gradients of the filled, blurred frames; blur and gradient in one pass over tiles. only: (t, ty, tx) of the tiles that are worked out."""
    w = stencil.gaussian_weights(sigma)
    halo = len(w) // 2 + 1

    def angle(arrays: list[np.ndarray], shape: tuple[int, int], top: int, left: int) -> list[np.ndarray]:
        # blurred a cell beyond the tile, so that its differences are at hand
        smooth = stencil.filter_arrays(arrays[0], w, w, shape, top, left, height, width, margin=1)
        dy, dx = stencil.frame_difference(smooth, 1, top, height), stencil.frame_difference(smooth, 2, left, width)
        return [np.where((dy == 0) & (dx == 0), 180.0, np.degrees(np.arctan2(dy, -dx)) % 360)]

    return tiles.apply_tiles(stencil.spatial_fill(grid, width), ["v"], halo, height, width, angle, "g double", only=only)


def disc_variance(angles: DataFrame, centres: DataFrame, radius: int) -> DataFrame:
    """(t, y, x, dav) of the centres: sample variance of the folded angles in a disc, cut at the frame's border; null where the
    disc has one value. Each centre meets its disc by an equi-join on the cell."""
    cells = angles.withColumnsRenamed({"y": "cy", "x": "cx"})
    near = centres.select("t", "y", "x").crossJoin(F.broadcast(masks.disc(angles.sparkSession, radius)))
    near = near.withColumns({"cy": F.col("y") + F.col("dy"), "cx": F.col("x") + F.col("dx")})
    met = near.join(cells, ["t", "cy", "cx"]).withColumn("d", fold_angle(F.col("g") - F.col("ray")))
    return centres.select("t", "y", "x").join(met.groupBy("t", "y", "x").agg(F.var_samp("d").alias("dav")), ["t", "y", "x"], "left")


def fold_array(d: np.ndarray) -> np.ndarray:
    return np.where(d < -270, d + 360, np.where(d < -90, -d - 180, np.where(d > 270, d - 360, np.where(d > 90, 180 - d, d))))


def disc_offsets(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dy, dx, ray) of the disc's cells in row-major order."""
    dy, dx = np.mgrid[-radius:radius, -radius:radius]
    inside = dy * dy + dx * dx < radius * radius
    dy, dx = dy[inside], dx[inside]
    return dy, dx, np.where((dy == 0) & (dx == 0), 0.0, np.degrees(np.arctan2(-dy, dx)) % 360)


def _of_sums(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 1, (q - s * s / n) / (n - 1), np.nan)


def variance_by_shifts(angles: np.ndarray, radius: int, shape: tuple[int, int]) -> np.ndarray:
    """Variances of all cells of tiles with a halo (frames, rows, columns): one array pass for each cell of the disc, in place.

    With rays from -90 to 270, fold(g - ray) is ||g - ray - 90| - 180| - 90 for all g from 0 to 360. Numbers of values come from running sums of rows.
    """
    dys, dxs, rays = disc_offsets(radius)
    missing = np.isnan(angles)
    g, there = np.where(missing, 0.0, angles), (~missing).astype(float)
    some = missing.any()
    s, q = np.zeros((len(angles), *shape)), np.zeros((len(angles), *shape))
    d = np.empty_like(s)
    for window, ray in zip(tiles.windows(shape, radius, list(zip(dys, dxs, strict=True))), rays, strict=True):
        np.subtract(g[window], (ray - 360 if ray > 270 else ray) + 90, out=d)
        np.abs(d, out=d)
        d -= 180
        np.abs(d, out=d)
        d -= 90
        if some:
            d *= there[window]
        s += d
        d *= d
        q += d
    return _of_sums(tiles.run_sums(there, tiles.runs_of(dys, dxs), radius, shape), s, q)


def variance_at(angles: np.ndarray, radius: int, wanted: np.ndarray) -> np.ndarray:
    """Variances of the wanted cells (frames, rows, columns; true) alone: each gathers its disc. NaN elsewhere."""
    dys, dxs, rays = disc_offsets(radius)
    out = np.full(wanted.shape, np.nan)
    f, y, x = np.nonzero(wanted)
    for some in np.array_split(np.arange(len(f)), max(1, len(f) * len(dys) // PAIRS)):
        d = fold_array(angles[f[some, None], y[some, None] + radius + dys, x[some, None] + radius + dxs] - rays)
        there = ~np.isnan(d)
        d = np.where(there, d, 0.0)
        out[f[some], y[some], x[some]] = _of_sums(there.sum(axis=1), d.sum(axis=1), (d * d).sum(axis=1))
    return out


def tiled_variance(angles: DataFrame, radius: int, height: int, width: int, tile: int = tiles.TILE, centres: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """disc_variance of all cells, from tiles: the sums shift a tile by each offset of the disc. centres: (t, y, x) to work out, of tiles (t, ty, tx) in
    only; where they are few in a tile they gather their discs."""
    some = centres is not None
    columns = ["g", "wanted"] if some else ["g"]

    def variance(arrays: list[np.ndarray], shape: tuple[int, int], top: int, left: int) -> list[np.ndarray]:
        if some:
            wanted = ~np.isnan(arrays[1][:, radius : radius + shape[0], radius : radius + shape[1]])
            if wanted.sum() * GATHERED <= wanted.size:
                return [variance_at(arrays[0], radius, wanted)]
        return [variance_by_shifts(arrays[0], radius, shape)]

    cells = angles.select("t", "y", "x", "g")
    if some:
        none = F.lit(None).cast("double")
        cells = cells.withColumn("wanted", none).unionByName(centres.select("t", "y", "x", none.alias("g"), F.lit(1.0).alias("wanted")))
    return tiles.apply_tiles(cells, columns, radius, height, width, variance, "dav double", tile, only=only)


def tiles_near(cells: DataFrame, reach: int, height: int, width: int, few: bool) -> DataFrame:
    """(t, ty, tx) of the tiles that cells (t, y, x) are in or within reach of; broadcast if the cells are few."""
    found = tiles.haloed(cells, reach, height, width).select("t", "ty", "tx").distinct()
    return F.broadcast(found) if few else found


def dav_map(grid: DataFrame, radius: int, height: int, width: int, skip: DataFrame | None = None, smooth: bool = True, cells: int | None = None) -> DataFrame:
    """(t, y, x, dav) of every cell. dav is null where the input is missing, and where skip, (t, y, x, skip), is true. smooth: frames are
    filled and blurred first.

    With skip, frames without a cell that is left stay out, only tiles near cells that are left are blurred, and only tiles with such cells get to the variance, which takes these cells alone where they
    are few: its time goes with them. What remains is the gap fill, which goes along whole frames, and the join that names all cells.

    cells: of all frames, if known; where cells * disc is over JOIN_ROWS, or cells isn't known, tiles are used.
    """
    if radius != int(radius) or radius < 1:
        raise ValueError("the radius must be a whole number of pixels")
    wanted = grid.select("t", "y", "x", "v").where("v is not null")
    if skip is None:
        centres, near, at = wanted.select("t", "y", "x"), None, None
    else:
        checkpoint_dir(grid.sparkSession)
        left = skip.select("t", "y", "x", F.col("skip").alias("__skip"))
        centres = wanted.join(left, ["t", "y", "x"], "left").where(~F.coalesce("__skip", F.lit(False))).select("t", "y", "x").checkpoint()
        few = centres.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
        near, at = (tiles_near(centres, reach, height, width, few) for reach in (radius, 0))
        grid_near = grid.join(F.broadcast(centres.select("t").distinct()) if few else centres.select("t").distinct(), "t", "left_semi")
    frames = grid if skip is None else grid_near
    angles = smooth_gradients(frames, height, width, only=near) if smooth else gradients(frames)
    if cells is not None and cells * masks.disc_cells(radius) <= JOIN_ROWS:
        found = disc_variance(angles, centres, radius)
    else:
        found = tiled_variance(angles, radius, height, width, centres=None if skip is None else centres, only=at)
        found = found.join(centres, ["t", "y", "x"], "left_semi")
    return grid.select("t", "y", "x").join(found, ["t", "y", "x"], "left")


def centre_cut(grid: DataFrame, height: int, width: int, half: int) -> DataFrame:
    """Cells within half of the frame's centre, counted anew from 0."""
    top, left = height // 2 - half, width // 2 - half
    inside = F.col("y").between(top, top + 2 * half - 1) & F.col("x").between(left, left + 2 * half - 1)
    return grid.where(inside).select("t", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "v")


def centre_dav(grid: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(t, dav): mean of the variances at the 4 x 4 cells about each frame's centre; the frame is cut to radius + 3 about it before it
    is filled and blurred, so the blur reflects at the cut."""
    half = radius + 3
    side = 2 * half
    angles = smooth_gradients(centre_cut(grid, height, width, half), side, side)
    near = F.col("y").between(half - 2, half + 1) & F.col("x").between(half - 2, half + 1)
    return disc_variance(angles, angles.where(near), radius).groupBy("t").agg(F.avg("dav").alias("dav"))


def cpu_dav(grid: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """(t, dav): the centre-only statistic. Integer images cut to radius + 5 about the centre, blurred with clamped borders, Sobel
    gradients, one disc between four pixels, differences wrapped by 180 degrees, and n + 1 as divisor."""
    half = radius + 5
    whole = centre_cut(grid, height, width, half).withColumn("v", F.col("v").cast("int").cast("double"))
    d = stencil.sobel(stencil.gaussian_blur(whole, 2 * half, 2 * half, 2.0, "nearest", whole=True), 2 * half, 2 * half)
    angles = d.select("t", "y", "x", coarse_angle(F.col("dy"), F.col("dx")).alias("g"))
    disc = masks.half_disc(grid.sparkSession, radius).select((F.col("dy") + half).alias("y"), (F.col("dx") + half).alias("x"), "ray")
    # differences are rounded, so that engines agree on which side of a wrap's jump they fall
    met = angles.join(F.broadcast(disc), ["y", "x"]).withColumn("d", wrap_angle(F.round(F.col("g") - F.col("ray"), 6)))
    n = F.count("d")
    return met.groupBy("t").agg(((F.sum(F.col("d") * F.col("d")) - F.sum("d") * F.sum("d") / n) / (n + 1)).alias("dav"))
