"""Outlines of connected areas as polygons with holes, without gathering an area in one task.

Each side between a cell and one of another area is a directed edge with its area on the left, so shells run
counter-clockwise (y up) and holes clockwise. Which edge follows is told by the three cells around its end: with eight
neighbours an outline turns right where areas touch at a corner, so cells that touch there share an outline; with four it
turns left. A tile, with a frame of one cell around it, knows the successor of each of its edges and ranks them to pieces
by pointer doubling in arrays; a piece ends where its successor lies in another tile. Pieces are stitched to rings by
pointer doubling over the table of pieces: their number is that of crossings of tile borders, the rounds are the logarithm
of the longest ring's pieces, and no group is larger than a tile.

An area has one shell with eight neighbours, and so has one with four; all its other rings are holes in it, so the sign of
the ring's area nests the rings. Corners alone are kept, and an edge's end is one if its successor turns.

Edge cases: a null label is no area; an empty table gives no outline; labels may come from several grids (grid_id), whose
areas are told apart; repeated cells count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import discard, materialize

from .algebra import grid_of

TILE = 512
#: Sides of a cell counter-clockwise: where the neighbour lies (y down), where the edge ends from the cell's corner.
_OUT = np.array([(0, 1), (-1, 0), (0, -1), (1, 0)])  # east, north, west, south
_END = np.array([(0, 1), (0, 0), (1, 0), (1, 1)])
_START = _END[[3, 0, 1, 2]]
_AHEAD = _OUT[[1, 2, 3, 0]]  # the way an edge runs


def _chained(succ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """succ: the place of each edge's successor, or -1. -> the first edge of each edge's chain, and its rank there. A closed
    chain begins with its least edge."""
    n = len(succ)
    pred = np.full(n, -1)
    inner = np.flatnonzero(succ >= 0)
    pred[succ[inner]] = inner
    # edges on closed chains never come to one without a predecessor
    at, least, far = np.where(pred < 0, np.arange(n), pred), np.arange(n), pred < 0
    for _ in range(max(n, 1).bit_length()):
        least, far, at = np.minimum(least, least[at]), far | far[at], at[at]
    pred[np.flatnonzero(~far & (least == np.arange(n)))] = -1
    head, rank = np.where(pred < 0, np.arange(n), pred), (pred >= 0).astype(np.int64)
    for _ in range(max(n, 1).bit_length()):
        rank, head = rank + rank[head], head[head]
    return head, rank


def _pieces(rows: pd.DataFrame, connect: int, tile: int) -> pd.DataFrame:
    """Cells of one tile and its frame -> pieces of outlines."""
    r, c = rows["row"].to_numpy(np.int64), rows["col"].to_numpy(np.int64)
    r0, c0 = int(rows["tr"].iloc[0]) * tile, int(rows["tc"].iloc[0]) * tile
    names, code = np.unique(rows["label"].to_numpy(np.int64), return_inverse=True)
    area = np.full((tile + 4, tile + 4), -1, np.int64)  # the frame's neighbours are never asked for, but addressed
    area[r - r0 + 2, c - c0 + 2] = code
    core = area[2:-2, 2:-2]
    y, x, side = [], [], []
    for s, (i, j) in enumerate(_OUT):
        hit = np.nonzero((core >= 0) & (core != area[2 + i : tile + 2 + i, 2 + j : tile + 2 + j]))
        y.append(hit[0]), x.append(hit[1]), side.append(np.full(len(hit[0]), s))
    y, x, side = (np.concatenate(v) for v in (y, x, side))
    columns = ["label", "start", "next", "points", "twice_area", "edges"]
    if not len(y):
        return pd.DataFrame({k: pd.Series([], dtype=object if k == "points" else float) for k in columns})
    at = lambda v: area[y + v[:, 0] + 2, x + v[:, 1] + 2]
    own, ahead, over = area[y + 2, x + 2], _AHEAD[side], _AHEAD[side] + _OUT[side]
    left, right = at(ahead) == own, at(over) == own
    turn = right if connect == 8 else right & left
    go = np.where(turn, 1, np.where(left, 0, -1))  # to the right, straight on, to the left
    move = np.where(turn[:, None], over, np.where(left[:, None], ahead, 0))
    ny, nx, nside = y + move[:, 0], x + move[:, 1], (side - go) % 4
    key = (y * tile + x) * 4 + side
    order = np.argsort(key)
    inside = (ny >= 0) & (ny < tile) & (nx >= 0) & (nx < tile)
    place = np.searchsorted(key[order], (ny * tile + nx) * 4 + nside)
    head, rank = _chained(np.where(inside, order[np.minimum(place, len(order) - 1)], -1))
    by = np.lexsort((rank, head))
    cuts = np.flatnonzero(np.concatenate([[True], head[by][1:] != head[by][:-1]]))
    last = by[np.append(cuts[1:], len(by)) - 1]
    first = by[cuts]
    px, py = c0 + x + _END[side][:, 1], -(r0 + y + _END[side][:, 0])
    qx, qy = c0 + x + _START[side][:, 1], -(r0 + y + _START[side][:, 0])
    corner = go[by] != 0
    number = np.cumsum(np.concatenate([[True], head[by][1:] != head[by][:-1]])) - 1
    split = np.cumsum(np.bincount(number[corner], minlength=len(cuts)))[:-1]
    points = np.split(np.column_stack([px[by][corner], py[by][corner]]).astype(float), split)
    named = lambda yy, xx, ss: ((r0 + yy).astype(np.int64) << 33) | ((c0 + xx).astype(np.int64) << 2) | ss
    return pd.DataFrame(
        {
            "label": names[own[first]],
            "start": named(y[first], x[first], side[first]),
            "next": named(ny[last], nx[last], nside[last]),
            "points": [[{"x": a, "y": b} for a, b in p] for p in points],
            "twice_area": np.add.reduceat((qx * py - px * qy)[by], cuts),
            "edges": np.diff(np.append(cuts, len(by))),
        }
    )


def pieces(labels: DataFrame, connect: int = 8, tile: int = TILE) -> DataFrame:
    """(row, col, label) -> (label, start, next, points, twice_area, edges): start and next name the piece's first edge and
    that of the piece behind it; a ring within a tile is a piece that is followed by itself."""
    g = grid_of(labels)
    cells = labels.filter("label is not null").select(*g, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("label").cast("long").alias("label"))
    tiles = lambda c: F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor((F.col(c) + i) / tile)))
    sent = cells.select("*", F.explode(tiles("row")).alias("tr")).select("*", F.explode(tiles("col")).alias("tc")).filter("tr >= 0 and tc >= 0")
    out = "label long, start long, next long, points array<struct<x:double,y:double>>, twice_area double, edges long"
    if not g:
        return sent.groupBy("tr", "tc").applyInPandas(lambda rows: _pieces(rows, connect, tile), out)
    return sent.groupBy(*g, "tr", "tc").applyInPandas(lambda rows: _pieces(rows, connect, tile).assign(grid_id=rows["grid_id"].iloc[0]), out + ", grid_id string")


def stitched(found: DataFrame) -> DataFrame:
    """pieces -> the same with ring (its least start), and seq, the piece's place in the ring."""
    by = [*grid_of(found), "at"]
    name = lambda df, new, *more: df.select(*by[:-1], F.col("start").alias("at"), *[F.col(c).alias(n) for c, n in zip(("to", *more), new)])
    own = grid_of(found)
    # least start over 2^k pieces, until twice as many give no other
    now = materialize(found.select(*own, "start", F.col("next").alias("to"), F.least("start", "next").alias("ring")), "ring-least")
    while True:
        then = name(now, ("to2", "ring2"), "ring")
        step = now.withColumnRenamed("to", "at").join(then, by).select(*own, "start", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("new"))
        step = materialize(step, "ring-least")
        discard(now)
        more, now = not step.filter("new").isEmpty(), step.drop("new")
        now.stage_path = step.stage_path
        if not more:
            break
    rings = now.select(*own, "start", "ring")
    # steps to the piece before the ring's first, which is followed by itself from now on
    line = found.select(*own, "start", "next").join(rings, [*own, "start"])
    far = materialize(line.select(*own, "start", "ring", F.when(F.col("next") == F.col("ring"), F.col("start")).otherwise(F.col("next")).alias("to"), F.when(F.col("next") == F.col("ring"), 0).otherwise(1).cast("long").alias("left")), "ring-left")
    while True:
        then = name(far, ("to2", "left2"), "left")
        step = far.withColumnRenamed("to", "at").join(then, by).select(*own, "start", "ring", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"), (F.col("to2") != F.col("at")).alias("new"))
        step = materialize(step, "ring-left")
        discard(far)
        more, far = not step.filter("new").isEmpty(), step.drop("new")
        far.stage_path = step.stage_path
        if not more:
            break
    total = far.groupBy(*own, "ring").agg(F.max("left").alias("most"))
    places = far.join(total, [*own, "ring"]).select(*own, "start", "ring", (F.col("most") - F.col("left")).alias("seq"))
    return found.join(places, [*own, "start"])


def outlines(labels: DataFrame, connect: int = 8, tile: int = TILE) -> DataFrame:
    """(row, col, label) -> (poly_id, ring, hole, seq, points): the pieces of each ring in order, in cell units, y up. ring is a
    number within the grid; a piece may be without a corner."""
    own = grid_of(labels)
    found = materialize(pieces(labels, connect, tile), "outline-pieces")
    whole = materialize(stitched(found), "outlines")
    discard(found)
    sign = whole.groupBy(*own, "ring").agg((F.sum("twice_area") < 0).alias("hole"))
    return whole.join(sign, [*own, "ring"]).select(*own, F.col("label").alias("poly_id"), "ring", "hole", "seq", "points", "twice_area", "edges")


def summary(lines: DataFrame) -> DataFrame:
    """(poly_id, area, perimeter, corners, holes) from the outlines alone."""
    own = grid_of(lines)
    each = lines.groupBy(*own, "poly_id", "ring", "hole").agg(F.sum("twice_area").alias("a"), F.sum("edges").alias("e"), F.sum(F.size("points")).alias("c"))
    return each.groupBy(*own, "poly_id").agg((F.sum("a") / 2).alias("area"), F.sum("e").alias("perimeter"), F.sum("c").alias("corners"), F.count_if("hole").alias("holes"))


def polygons(lines: DataFrame) -> DataFrame:
    """(poly_id, rings): one row for each area, the shell first. A row holds the whole outline, so this is for areas whose
    outlines fit a row; ``outlines`` and ``summary`` have no such limit."""
    own = grid_of(lines)
    ring = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "points"))), lambda p: p["points"]))
    each = lines.groupBy(*own, "poly_id", "hole", "ring").agg(ring.alias("points"))
    return each.groupBy(*own, "poly_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring", "points"))), lambda r: r["points"]).alias("rings"))
