"""Resampling, blocks, clipping. Refining by k is a narrow projection; nothing but a coarse neighbourhood is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .algebra import grid_of, key


def coarse(column: str, k: int) -> Column:
    return F.floor(F.col(column) / k).cast("int")


def nearest(cells: DataFrame, k: int) -> DataFrame:
    """Each coarse cell becomes k x k cells, without a shuffle."""
    i = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1)))
    out = cells.select(*grid_of(cells), "row", "col", "value", i.alias("i"))
    return out.select(*grid_of(cells), (F.col("row") * k + F.floor(F.col("i") / k)).cast("int").alias("row"), (F.col("col") * k + F.col("i") % k).cast("int").alias("col"), "value")


def nearest_onto(fine: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The coarse value of each fine cell, by one equi-join on the computed key."""
    g = grid_of(fine)
    side = cells.select(*g, F.col("row").alias("r2"), F.col("col").alias("c2"), "value")
    return fine.select(*key(fine), coarse("row", k).alias("r2"), coarse("col", k).alias("c2")).join(side, [*g, "r2", "c2"]).select(*key(fine), "value")


def bilinear(cells: DataFrame, k: int) -> DataFrame:
    """Weights fall off linearly between coarse centres, and are made up to 1 over what has data; no-data stays where
    the cell's own coarse cell has none. The 3 x 3 coarse neighbourhood is gathered once, at coarse size."""
    g, near = grid_of(cells), [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    spread = cells.select(*g, "row", "col", "value", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])).alias("n"))
    to = spread.select(*g, (F.col("row") - F.col("n.i")).alias("row"), (F.col("col") - F.col("n.j")).alias("col"), "value", "n")
    at = lambda i, j: F.max(F.when((F.col("n.i") == i) & (F.col("n.j") == j), F.col("value")))
    patch = to.groupBy(*g, "row", "col").agg(*[at(i, j).alias(f"v{n}") for n, (i, j) in enumerate(near)]).filter("v4 is not null")
    fine = patch.select("*", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("s"))
    dy, dx = ((x + F.lit(0.5)) / k - F.lit(0.5) for x in (F.floor(F.col("s") / k), F.col("s") % k))
    weight = lambda i, j: F.greatest(F.lit(0.0), 1 - F.abs(dy - i)) * F.greatest(F.lit(0.0), 1 - F.abs(dx - j))
    some = [(F.when(F.col(f"v{n}").isNotNull(), weight(i, j)).otherwise(F.lit(0.0)), F.coalesce(F.col(f"v{n}"), F.lit(0.0))) for n, (i, j) in enumerate(near)]
    value = sum((w * v for w, v in some[1:]), some[0][0] * some[0][1]) / sum((w for w, _ in some[1:]), some[0][0])
    return fine.select(*g, (F.col("row") * k + F.floor(F.col("s") / k)).cast("int").alias("row"), (F.col("col") * k + F.col("s") % k).cast("int").alias("col"), value.alias("value"))


def block_reduce(cells: DataFrame, k: int, how: dict[str, Column] | None = None) -> DataFrame:
    """Blocks of k x k cells by any aggregates of value; the mean if none is given. Nulls don't count, and a block is
    null only if all of it is."""
    how = how or {"value": F.avg("value")}
    return cells.groupBy(*grid_of(cells), coarse("row", k).alias("row"), coarse("col", k).alias("col")).agg(*[v.alias(n) for n, v in how.items()])


def clip(cells: DataFrame, row0: int, row1: int, col0: int, col1: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """Rows and columns from the first up to but not the last, numbered anew; the filter reaches the scan. With the grid's
    shape, a window that is empty or not wholly inside is an error."""
    if shape and not (0 <= row0 < row1 <= shape[0] and 0 <= col0 < col1 <= shape[1]):
        raise ValueError(f"the window {(row0, row1, col0, col1)} is not inside a grid of {shape}")
    inside = F.col("row").between(row0, row1 - 1) & F.col("col").between(col0, col1 - 1)
    return cells.filter(inside).withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})


def window_of(bbox: tuple[float, float, float, float], x0: float, y0: float, res: float, snap: bool = True) -> tuple[int, int, int, int]:
    """(xmin, ymin, xmax, ymax) -> (row0, row1, col0, col1); y0 is the upper edge."""
    put = round if snap else int
    return put((y0 - bbox[3]) / res), put((y0 - bbox[1]) / res), put((bbox[0] - x0) / res), put((bbox[2] - x0) / res)


def clip_bbox(cells: DataFrame, grid: dict, bbox: tuple[float, float, float, float]) -> tuple[DataFrame, dict]:
    """A grid (height, width, x0, y0, res and what else describes it) cut to a box whose sides snap to cells
    -> its cells and its new description."""
    row0, row1, col0, col1 = window_of(bbox, grid["x0"], grid["y0"], grid["res"])
    out = clip(cells, row0, row1, col0, col1, (grid["height"], grid["width"]))
    return out, grid | {"height": row1 - row0, "width": col1 - col0, "x0": grid["x0"] + col0 * grid["res"], "y0": grid["y0"] - row0 * grid["res"]}


def extent(grid: dict) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax)."""
    return grid["x0"], grid["y0"] - grid["height"] * grid["res"], grid["x0"] + grid["width"] * grid["res"], grid["y0"]


def clip_pair_bbox(coarse_cells: DataFrame, coarse_grid: dict, fine_cells: DataFrame, fine_grid: dict, bbox: tuple[float, float, float, float]):
    """The coarse grid by a box that snaps to its cells, the fine one by the extent that this gives; the two then cover the
    same ground, or it is an error -> ((cells, grid), (cells, grid))."""
    low, low_grid = clip_bbox(coarse_cells, coarse_grid, bbox)
    high, high_grid = clip_bbox(fine_cells, fine_grid, extent(low_grid))
    if any(abs(a - b) > 1e-9 for a, b in zip(extent(low_grid), extent(high_grid))):
        raise ValueError("the grids don't line up at the clipped extent")
    return (low, low_grid), (high, high_grid)


def clip_pair(coarse_cells: DataFrame, fine_cells: DataFrame, k: int, row0: int, row1: int, col0: int, col1: int) -> tuple[DataFrame, DataFrame]:
    """A coarse grid by a coarse window, and the fine grid by the same extent."""
    return clip(coarse_cells, row0, row1, col0, col1), clip(fine_cells, row0 * k, row1 * k, col0 * k, col1 * k)


def resolution_ratio(coarse_grid: dict, fine_grid: dict) -> float:
    """How many fine cells a coarse one is wide; less than 1 is an error."""
    ratio = coarse_grid["res"] / fine_grid["res"]
    if ratio < 1:
        raise ValueError(f"the coarse grid is finer than the fine one: {ratio}")
    return ratio


def support_ratio(fine: tuple[int, int], rough: tuple[int, int]) -> float:
    """Heights' ratio, which must be the widths' as well, and no less than 1."""
    h, w = fine[0] / rough[0], fine[1] / rough[1]
    if h != w or h < 1:
        raise ValueError(f"the shapes {fine} and {rough} have no common ratio of 1 or more")
    return h


def divisible(shape: tuple[int, int], k: int) -> bool:
    return all(n % k == 0 for n in shape)


def centres(cells: DataFrame, x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """x and y of each cell's centre."""
    return cells.withColumns({"x": x0 + (F.col("col") + 0.5) * res, "y": y0 - (F.col("row") + 0.5) * res})


def merge(*grids: DataFrame) -> DataFrame:
    """One grid of several: where they overlap, the first with data stands."""
    every = grids[0].withColumn("o", F.lit(0))
    for n, g in enumerate(grids[1:], 1):
        every = every.unionByName(g.withColumn("o", F.lit(n)))
    return every.groupBy(*key(grids[0])).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("o")).otherwise(F.lit(len(grids)))).alias("value"))
