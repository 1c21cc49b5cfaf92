"""Depressions of a terrain, filled or breached, on grids of any size.

Water leaves at outlets: cells at the grid's edge or beside a cell without data. Each cell's way out is the path whose
highest cell is least; with cells ordered by (value, row, col) these paths are the minimum spanning tree of the cells and
the outside, which is unique. A tile finds the tree of its own cells, and of that only what joins its border cells and the
outside matters to others: paths between these shrink to one edge each (``_shrunk``). Four regions with the edges between
them make a region of twice the side, up to one that holds all; no group holds more than the borders of its four parts. On
the way down each region is told how its border cells are joined outside of it, so every tile ends up with its part of the
one tree, and every cell with the next cell on its way (``flow``).

Filling lifts each cell to the highest cell on its way. Breaching lowers each to the least cell whose way passes it, so
all ways fall or stay level, and cells that no lower one drains through keep their values. Where ways cross from tile to
tile, least values are passed on by pointer doubling over the crossings.

Edge cases: cells without data are no part and stay NULL; a lone cell is an outlet; equal values go by row and column; an
empty grid stays empty; with grid_id each grid has its own outside; rows and columns count from 0.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import discard, materialize

from .algebra import grid_of

TILE = 128
_OUT, _WIDE = -1, 1 << 31
_HALF = ((0, 1), (1, -1), (1, 0), (1, 1))
_EDGE = ["kz", "khi", "klo", "u", "v", "hu", "hv"]
_EDGES = "kz double, khi long, klo long, u long, v long, hu long, hv long"


def _edges(columns) -> np.ndarray:
    """(kz, khi, klo, u, v, hu, hv[, tag]) as one array of records."""
    columns = [np.asarray(c) for c in columns]
    out = np.empty(len(columns[0]), [(c, float if c == "kz" else np.int64) for c in (*_EDGE, "tag")])
    out["tag"] = -1
    for name, values in zip((*_EDGE, "tag"), columns):
        out[name] = values
    return out


def _tree(edges: np.ndarray) -> np.ndarray:
    """The minimum spanning forest of edges by their keys, the first three, in this order. Each part takes its least edge to
    another, until none has any."""
    edges = edges[np.lexsort((edges["klo"], edges["khi"], edges["kz"]))]
    m = len(edges)
    nodes, ends = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    part, taken = np.arange(len(nodes)), np.zeros(m, bool)
    left, a, b = np.arange(m), ends[:m], ends[m:]
    while True:
        pa, pb = part[a], part[b]
        other = pa != pb
        left, a, b, pa, pb = left[other], a[other], b[other], pa[other], pb[other]
        if not len(left):
            return edges[taken]
        least = np.full(len(nodes), m)
        np.minimum.at(least, pa, left), np.minimum.at(least, pb, left)
        own = np.flatnonzero(least < m)
        taken[least[own]] = True
        at = np.searchsorted(left, least[own])
        to = np.where(pa[at] == own, pb[at], pa[at])
        up = np.arange(len(nodes))
        up[own] = to
        both = own[(up[to] == own) & (own < to)]  # two that took the same edge
        up[both] = both
        while not np.array_equal(more := up[up], up):
            up = more
        part = up[part]


def _shrunk(tree: np.ndarray, keep) -> np.ndarray:
    """The tree between the nodes that keep tells, and branchings between them; an edge stands for a path, with its highest
    key and, at both ends, the first cell on the way. Leaves go and, of nodes with two edges, those before their neighbours
    in an order at random, so rounds are few. The tree's edges are in the order of their keys."""
    m = len(tree)
    nodes, ends = np.unique(np.concatenate([tree["u"], tree["v"]]), return_inverse=True)
    n, kept, draw = len(nodes), keep(nodes), np.random.default_rng(0)
    u, v, hu, hv, top = ends[:m], ends[m:], tree["hu"], tree["hv"], np.arange(m)
    while True:
        leaf = (np.bincount(np.concatenate([u, v]), minlength=n) == 1) & ~kept
        stay = ~(leaf[u] | leaf[v])
        u, v, hu, hv, top = u[stay], v[stay], hu[stay], hv[stay], top[stay]
        both = np.concatenate([u, v])
        size = np.bincount(both, minlength=n)
        free = (size == 2) & ~kept
        mid = np.flatnonzero(free)
        if not len(mid):
            if leaf.any():
                continue
            return _edges([*(tree[k][top] for k in ("kz", "khi", "klo")), nodes[u], nodes[v], hu, hv])
        half, begin = np.argsort(both, kind="stable"), np.cumsum(size) - size
        far, here, there = np.concatenate([v, u]), np.concatenate([hu, hv]), np.concatenate([hv, hu])
        x, y = half[begin[mid]], half[begin[mid] + 1]
        turn = np.where(free, draw.permutation(n), -1)
        ok = (turn[mid] > turn[far[x]]) & (turn[mid] > turn[far[y]])
        x, y = x[ok], y[ok]
        old = np.ones(len(u), bool)
        old[x % len(u)] = old[y % len(u)] = False
        over = np.maximum(top[x % len(u)], top[y % len(u)])
        u, v, hu, hv, top = (np.concatenate([c[old], d]) for c, d in ((u, far[x]), (v, far[y]), (hu, there[x]), (hv, there[y]), (top, over)))


def _on_border(side: int, bounds: tuple[int, int, int, int]):
    """Of cells by number: whether their square of that side has neighbours beside them within the bounds (first row, last
    row, first col, last col) of the grid; the outside counts."""
    r0, r1, c0, c1 = bounds

    def told(cell: np.ndarray) -> np.ndarray:
        r, c = cell // _WIDE, cell % _WIDE
        low, high = ((r % side == 0) & (r > r0)) | ((c % side == 0) & (c > c0)), ((r % side == side - 1) & (r < r1)) | ((c % side == side - 1) & (c < c1))
        return (cell == _OUT) | low | high

    return told


def _tile_edges(rows: pd.DataFrame, tr: int, tc: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a tile and its frame -> the tile's own edges and ways out, and the edges from it on to later tiles."""
    r, c = rows["row"].to_numpy(np.int64), rows["col"].to_numpy(np.int64)
    at = np.full((tile + 4, tile + 4), -1, np.int64)
    z = rows["value"].to_numpy(float)
    y, x = r - tr * tile + 2, c - tc * tile + 2
    at[y, x] = np.arange(len(r))
    ids = r * _WIDE + c
    core = (r // tile == tr) & (c // tile == tc)
    alone = np.zeros(len(r), bool)
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            alone |= at[np.clip(y + i, 0, tile + 3), np.clip(x + j, 0, tile + 3)] < 0
    k = np.flatnonzero(core & alone)
    out = np.full(len(k), _OUT)
    own, cross = [_edges([z[k], ids[k], out, ids[k], out, out, ids[k]])], []
    for i, j in _HALF:
        b = at[np.clip(y + i, 0, tile + 3), np.clip(x + j, 0, tile + 3)]
        a = np.flatnonzero((b >= 0) & (core | core[b]))
        b = b[a]
        up = (z[a] > z[b]) | ((z[a] == z[b]) & (ids[a] > ids[b]))
        hi, lo = np.where(up, a, b), np.where(up, b, a)
        found = _edges([z[hi], ids[hi], ids[lo], ids[a], ids[b], ids[b], ids[a]])
        own.append(found[core[a] & core[b]])
        cross.append(found[core[a] & ~core[b]])  # the tile of the first cell tells the edge
    return np.concatenate(own), np.concatenate(cross)


def _met(u: np.ndarray, v: np.ndarray, tile: int) -> np.ndarray:
    """The level at which two cells' regions are the same."""
    apart = (u // _WIDE // tile ^ v // _WIDE // tile) | (u % _WIDE // tile ^ v % _WIDE // tile)
    return np.frexp(apart.astype(float))[1]


def _table(edges: np.ndarray, **more) -> pd.DataFrame:
    return pd.DataFrame({c: edges[c] for c in _EDGE}).assign(**more)


def _first(rows: pd.DataFrame, tile: int, bounds: tuple[int, int, int, int]) -> pd.DataFrame:
    tr, tc = int(rows["tr"].iloc[0]), int(rows["tc"].iloc[0])
    own, cross = _tile_edges(rows, tr, tc, tile)
    k = _met(cross["u"], cross["v"], tile)
    out = _table(_shrunk(_tree(own), _on_border(tile, bounds)), level=0, rr=tr, rc=tc)
    return pd.concat([out, _table(cross, level=k, rr=tr >> k, rc=tc >> k)], ignore_index=True)


def _up(rows: pd.DataFrame, side: int, bounds: tuple[int, int, int, int]) -> pd.DataFrame:
    tree = _tree(_edges([rows[c] for c in _EDGE]))
    return _table(_shrunk(tree, _on_border(side, bounds)), rr=rows["rr"].iloc[0], rc=rows["rc"].iloc[0])


def _down(rows: pd.DataFrame, side: int, bounds: tuple[int, int, int, int]) -> pd.DataFrame:
    """tag: the part that an edge comes from, 0 to 3, or -1. side: that of the parts."""
    tree = _tree(_edges([rows[c] for c in (*_EDGE, "tag")]))
    rr, rc, parts = int(rows["rr"].iloc[0]), int(rows["rc"].iloc[0]), sorted({*rows["tag"]} - {-1})
    told, out = _on_border(side, bounds), []
    for part in parts:
        r, c = 2 * rr + part // 2, 2 * rc + part % 2
        keep = lambda x: (x == _OUT) | ((x // _WIDE // side == r) & (x % _WIDE // side == c) & told(x))  # noqa: B023, E731
        out.append(_table(_shrunk(tree[tree["tag"] != part], keep), rr=r, rc=c))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["rr", "rc", *_EDGE])


def _directed(rows: pd.DataFrame, outer: pd.DataFrame, tile: int) -> pd.DataFrame:
    """The tile's cells with the next cell on each one's way out, and the highest value on it."""
    if not len(rows):
        return pd.DataFrame(columns=["row", "col", "value", "level", "next"])
    tr, tc = int(rows["tr"].iloc[0]), int(rows["tc"].iloc[0])
    own, _ = _tile_edges(rows, tr, tc, tile)
    tree = _tree(np.concatenate([own, _edges([outer[c] for c in _EDGE])]))
    nodes, ends = np.unique(np.concatenate([[_OUT], tree["u"], tree["v"]]), return_inverse=True)
    a, b = np.split(ends[1:], 2)
    order = np.argsort(both := np.concatenate([a, b]), kind="stable")
    begin = np.searchsorted(both[order], np.arange(len(nodes) + 1)).tolist()
    far, here, high = (np.concatenate(c)[order].tolist() for c in ((b, a), (tree["hv"], tree["hu"]), (tree["kz"], tree["kz"])))
    way, level, stack = [None] * len(nodes), [-np.inf] * len(nodes), [0]  # the outside has the least number
    way[0] = _OUT
    while stack:
        x = stack.pop()
        for e in range(begin[x], begin[x + 1]):
            if way[y := far[e]] is None:
                way[y], level[y] = here[e], max(level[x], high[e])
                stack.append(y)
    core = rows[(rows["row"] // tile == tr) & (rows["col"] // tile == tc)]
    at = np.searchsorted(nodes, core["row"].to_numpy(np.int64) * _WIDE + core["col"].to_numpy(np.int64)).tolist()
    return core[["row", "col", "value"]].assign(level=[level[i] for i in at], next=[way[i] for i in at])


def _grouped(df: DataFrame, g: list[str], by: list[str], f, schema: str) -> DataFrame:
    """applyInPandas by grid and region."""
    if not g:
        return df.groupBy(*by).applyInPandas(lambda rows: f(rows), schema)
    return df.groupBy(*g, *by).applyInPandas(lambda rows: f(rows).assign(grid_id=rows["grid_id"].iloc[0]), schema + ", grid_id string")


def _cogrouped(a: DataFrame, b: DataFrame, g: list[str], by: list[str], f, schema: str) -> DataFrame:
    if not g:
        return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(f, schema)
    named = lambda x, y: f(x, y).assign(grid_id=(x if len(x) else y)["grid_id"].iloc[0])
    return a.groupBy(*g, *by).cogroup(b.groupBy(*g, *by)).applyInPandas(named, schema + ", grid_id string")


def flow(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(row, col, value) -> (row, col, value, level, next) of the cells with data: level is the highest value on the way
    out, next the cell that follows, as row * 2^31 + col, or -1 for the outside."""
    g = grid_of(cells)
    data = cells.filter("value is not null").select(*g, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value"))
    tiles = lambda c: F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor((F.col(c) + i) / tile)))
    sent = data.select("*", F.explode(tiles("row")).alias("tr")).select("*", F.explode(tiles("col")).alias("tc"))
    # a frame alone, beside the grid, is no tile
    real = data.select(*g, F.floor(F.col("row") / tile).alias("tr"), F.floor(F.col("col") / tile).alias("tc")).distinct()
    sent = materialize(sent.join(real, [*g, "tr", "tc"], "left_semi"), "flow-tiles")
    bounds = tuple(x or 0 for x in data.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first())
    top = (max(bounds) // tile).bit_length()
    first = materialize(_grouped(sent, g, ["tr", "tc"], partial(_first, tile=tile, bounds=bounds), f"level int, rr long, rc long, {_EDGES}"), "flow-first")
    spots = [*g, "rr", "rc"]
    parts = [first.filter("level = 0").drop("level")]
    half = lambda df: df.withColumns({"rr": F.shiftright("rr", 1), "rc": F.shiftright("rc", 1)})
    tag = (F.col("rr") % 2 * 2 + F.col("rc") % 2).cast("int")
    items = []  # of each level: its parts' edges and those between them
    for k in range(1, top + 1):
        met = half(parts[-1].withColumn("tag", tag)).unionByName(first.filter(F.col("level") == k).drop("level").withColumn("tag", F.lit(-1)))
        items.append(met)
        if k < top:
            parts.append(materialize(_grouped(met, g, ["rr", "rc"], partial(_up, side=tile << k, bounds=bounds), f"{_EDGES}, rr long, rc long"), "flow-up"))
    outer = None
    for k in range(top, 0, -1):
        every = items[k - 1] if outer is None else items[k - 1].unionByName(outer.withColumn("tag", F.lit(-1)))
        outer = materialize(_grouped(every, g, ["rr", "rc"], partial(_down, side=tile << (k - 1), bounds=bounds), f"rr long, rc long, {_EDGES}"), "flow-down")
    out = "row long, col long, value double, level double, next long"
    if outer is None:
        outer = parts[0].limit(0)
    told = outer.select(*[F.col(c).alias({"rr": "tr", "rc": "tc"}.get(c, c)) for c in (*spots, *_EDGE)])
    found = materialize(_cogrouped(sent, told, g, ["tr", "tc"], lambda rows, more: _directed(rows, more, tile), out), "flow")
    discard(sent, first, *parts[1:])
    return found


def filled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Each cell lifted to the highest cell on its way out."""
    return _onto(cells, flow(cells, tile), "level")


def _onto(cells: DataFrame, found: DataFrame, value: str) -> DataFrame:
    g = grid_of(cells)
    kind = dict(cells.dtypes)
    back = found.select(*g, F.col("row").cast(kind["row"]).alias("row"), F.col("col").cast(kind["col"]).alias("col"), F.col(value).alias("value"))
    return back.unionByName(cells.filter("value is null").select(*g, "row", "col", F.lit(None).cast("double").alias("value")))


def _least(rows: pd.DataFrame, come: dict[int, float], tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell numbers, the least value whose way passes each within the tile, the last cell of each one's way in the tile)."""
    ids = rows["row"].to_numpy(np.int64) * _WIDE + rows["col"].to_numpy(np.int64)
    order = np.argsort(ids)
    at = np.searchsorted(ids[order], rows["next"].to_numpy())
    at = order[np.minimum(at, len(ids) - 1)]
    own = np.arange(len(ids))
    up = np.where(ids[at] == rows["next"].to_numpy(), at, own)
    value = rows["value"].to_numpy(float).copy()
    if come:
        value = np.minimum(value, np.array([come.get(i, np.inf) for i in ids.tolist()]))
    deep, end = (up != own).astype(np.int64), up.copy()
    for _ in range(max(len(ids), 1).bit_length()):
        deep, end = deep + deep[end], end[end]
    by = np.argsort(-deep, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], deep[by][1:] != deep[by][:-1]]))
    for part in np.split(by, cuts[1:]):
        np.minimum.at(value, up[part], value[part])
    return ids, value, end


def _ways(rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Of the cells at the tile's border: their last cell in the tile, and of these the least value and the next cell."""
    ids, value, end = _least(rows, {}, tile)
    r, c = rows["row"].to_numpy(np.int64) % tile, rows["col"].to_numpy(np.int64) % tile
    some = (r == 0) | (r == tile - 1) | (c == 0) | (c == tile - 1)
    return pd.DataFrame({"cell": ids[some], "last": ids[end[some]], "least": value[end[some]], "next": rows["next"].to_numpy()[end[some]]})


def breached(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Each cell lowered to the least cell whose way out passes it, so that every way falls or stays level."""
    g = grid_of(cells)
    tiled = flow(cells, tile).withColumns({"tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    ways = materialize(_grouped(tiled, g, ["tr", "tc"], lambda rows: _ways(rows, tile), "cell long, last long, least double, next long"), "breach-ways")
    over = ways.filter("cell = last and next <> -1").select(*g, F.col("last").alias("at"), "least", F.col("next").alias("enters"))
    on = ways.select(*g, F.col("cell").alias("enters"), F.when(F.col("next") != -1, F.col("last")).alias("to"))
    # at: cells from which ways leave a tile; to: the one that the way leaves the next tile from
    now = materialize(over.join(on, [*g, "enters"]).select(*g, "at", "to", "least"), "breach-least")
    while not now.filter("to is not null").isEmpty():
        come = now.filter("to is not null").groupBy(*g, F.col("to").alias("at")).agg(F.min("least").alias("come"))
        jump = now.select(*g, F.col("at").alias("to"), F.col("to").alias("to2"))
        then = now.join(come, [*g, "at"], "left").join(jump, [*g, "to"], "left").select(*g, "at", F.col("to2").alias("to"), F.least("least", "come").alias("least"))
        then = materialize(then, "breach-least")
        discard(now)
        now = then
    into = now.join(over.drop("least"), [*g, "at"]).groupBy(*g, "enters").agg(F.min("least").alias("least"))
    into = into.select(*g, "enters", "least", F.expr(f"enters div {_WIDE * tile}").alias("tr"), F.floor(F.col("enters") % _WIDE / tile).alias("tc"))

    def lowered(rows: pd.DataFrame, come: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["row", "col", "least"])
        _, value, _ = _least(rows, dict(zip(come["enters"], come["least"])), tile)
        return rows[["row", "col"]].assign(least=value)

    found = materialize(_cogrouped(tiled, into, g, ["tr", "tc"], lowered, "row long, col long, least double"), "breached")
    discard(ways, now)
    return _onto(cells, found, "least")
