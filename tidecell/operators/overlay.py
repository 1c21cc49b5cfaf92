"""Overlay of polygons of any shape, with holes: intersection, difference, symmetric difference and dissolve.

Edges are dealt to horizontal bands. Within a band the ys of all vertices and of all crossings of edges cut it into slabs in
which no edges cross; there the edges are sorted by x, and their counts tell what lies inside of which polygon (even-odd,
so holes are rings like any other). The stretches between two edges that the operation keeps are trapezoids; trapezoids
between the same two edges in slabs that touch are one. So the work of a band is that of the edges in it, and what is
kept comes as rows of trapezoids (``pieces``), disjoint and as many as needed: areas and centroids are sums over them.
``outline`` turns pieces into edges, dropping what two pieces share, and ``polygons`` chains these to rings.

Intersections and differences are grouped by polygon, with all others whose boxes meet its own, found by tiles of the
plane; a dissolve by its key. Only edges of the same band come together.

Polygons with the same rings are one shape (``alike``): shapes alone are cut, and what is found is told of each polygon that
has the shape (``each``). So copies cost a row of the result each and no more.

Edge cases: polygons that only touch share no area and give no piece; a ring with fewer than three different points has none
either; a null key is a key; rings may cross themselves (even-odd); an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import materialize

from . import vector
from .algebra import dealt

#: Height of bands, in units of the coordinates.
BAND = 64.0
_PIECE = ["y0", "y1", "l0", "r0", "l1", "r1"]
_PIECES = "y0 double, y1 double, l0 double, r0 double, l1 double, r1 double"
#: Slabs that are thinner than this share of the largest coordinate are left out.
_THIN = 1e-13
_DIGITS = 9


def _crossing_ys(x1, y1, x2, y2, low: float, high: float) -> np.ndarray:
    """Where edges cross within the band; each pair is met once, rows of the table at a time."""
    out = [np.zeros(0)]
    dx, dy = x2 - x1, y2 - y1
    for i in range(len(x1) - 1):
        j = slice(i + 1, None)
        den = dx[i] * dy[j] - dy[i] * dx[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((x1[j] - x1[i]) * dy[j] - (y1[j] - y1[i]) * dx[j]) / den
            u = ((x1[j] - x1[i]) * dy[i] - (y1[j] - y1[i]) * dx[i]) / den
        hit = (den != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        y = y1[i] + t[hit] * dy[i]
        out.append(y[(y > low) & (y < high)])
    return np.concatenate(out)


def _kept_by_both(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (own > 0) & (others > 0)


def _kept_by_own(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (own > 0) & (others == 0)


def _kept_by_any(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    return own > 0


def _inside(poly: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Behind each edge, in order of x: how many of the chosen polygons one is inside of."""
    order = np.lexsort((np.arange(len(poly)), poly))
    head = np.concatenate([[True], poly[order][1:] != poly[order][:-1]])
    nth = np.arange(len(poly)) - np.maximum.accumulate(np.where(head, np.arange(len(poly)), 0))
    step = np.empty(len(poly), np.int64)
    step[order] = np.where(nth % 2 == 0, 1, -1)
    return np.cumsum(np.where(chosen, step, 0))


def _told(rows: pd.DataFrame, by: list[str], n: int) -> dict[str, pd.Series]:
    return {c: pd.Series([rows[c].iloc[0]] * n, dtype=object) for c in by}


def _cut(x1, y1, x2, y2, own, poly, low: float, high: float, keep: Callable) -> np.ndarray:
    """Edges that cross the band from low to high -> the pieces kept there, a row each."""
    ends = np.clip(np.concatenate([y1, y2]), low, high)
    ys = np.unique(np.concatenate([ends, _crossing_ys(x1, y1, x2, y2, low, high)]))
    thin = _THIN * max(1.0, float(np.abs(ys).max(initial=0.0)), float(np.abs(x1).max(initial=0.0)))
    bottom, top = np.minimum(y1, y2), np.maximum(y1, y2)
    at = lambda k, y: x1[k] + (y - y1[k]) * (x2[k] - x1[k]) / (y2[k] - y1[k])
    open_: dict[tuple, list] = {}
    out = []
    for a, b in zip(ys[:-1].tolist(), ys[1:].tolist()):
        mid, last, open_ = (a + b) / 2, open_, {}
        if b - a > thin:
            k = np.flatnonzero((bottom < mid) & (top > mid))
            if len(k) < 2:
                continue
            x = at(k, mid)
            order = np.argsort(x, kind="stable")
            k, x = k[order], x[order]
            inside = keep(_inside(poly[k], own[k]), _inside(poly[k], ~own[k]))
            # edges that lie on one another: only what is between different ones counts
            apart = np.append(x[1:] - x[:-1] > thin, True)
            inside, k = inside[apart], k[apart]
            before = np.concatenate([[False], inside[:-1]])
            for left, right in zip(k[inside & ~before].tolist(), k[~inside & before].tolist()):
                piece = last.pop((left, right), None)
                if piece is None:
                    piece = [left, right, a, b]
                    out.append(piece)
                piece[3] = b
                open_[(left, right)] = piece
    if not out:
        return np.zeros((0, len(_PIECE)))
    left, right = (np.array([p[i] for p in out]) for i in (0, 1))
    a, b = (np.array([p[i] for p in out]) for i in (2, 3))
    return np.column_stack([a, b, at(left, a), at(right, a), at(left, b), at(right, b)])


def _edges_of(rows: pd.DataFrame, band: float) -> tuple:
    own = rows["own"].to_numpy(bool)
    low = float(rows["band"].iloc[0]) * band
    return (*(rows[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2")), own, rows["poly"].to_numpy(np.int64) * 2 + own, low, low + band)


def _slabs(rows: pd.DataFrame, by: list[str], band: float, keep: Callable) -> pd.DataFrame:
    """rows: edges (own, poly, x1, y1, x2, y2) of a band -> pieces."""
    found = _cut(*_edges_of(rows, band), keep)
    return pd.DataFrame(_told(rows, by, len(found)) | dict(zip(_PIECE, found.T)))


def _slabs_of_pairs(rows: pd.DataFrame, band: float) -> pd.DataFrame:
    """rows: edges of one polygon (own) and of all that may meet it in a band -> the pieces that it shares with each."""
    x1, y1, x2, y2, own, poly, low, high = _edges_of(rows, band)
    mine, rest = np.flatnonzero(own), np.flatnonzero(~own)
    rest = rest[np.argsort(poly[rest], kind="stable")]
    ids, begin = np.unique(poly[rest], return_index=True)
    box = lambda k: (np.minimum(x1[k], x2[k]).min(), np.maximum(x1[k], x2[k]).max(), np.minimum(y1[k], y2[k]).min(), np.maximum(y1[k], y2[k]).max())
    at = box(mine) if len(mine) else None
    out, told = [np.zeros((0, len(_PIECE)))], [np.zeros(0, np.int64)]
    for b, part in zip((ids // 2).tolist(), np.split(rest, begin[1:]) if len(rest) else []):
        other = box(part)
        if at and at[0] < other[1] and other[0] < at[1] and at[2] < other[3] and other[2] < at[3]:
            k = np.concatenate([mine, part])
            found = _cut(x1[k], y1[k], x2[k], y2[k], own[k], poly[k], low, high, _kept_by_both)
            out.append(found)
            told.append(np.full(len(found), b))
    found = np.concatenate(out)
    return pd.DataFrame(_told(rows, ["a"], len(found)) | {"b": np.concatenate(told)} | dict(zip(_PIECE, found.T)))


def _banded(polygons: DataFrame, band: float, *more: str) -> DataFrame:
    """(poly, ..., x1, y1, x2, y2, band): the edges of polygons, once for each band they cross."""
    e = vector.edges(polygons)
    if more:
        e = e.join(polygons.select("poly_id", *more).distinct(), "poly_id")  # a polygon may be in several rows
    low, high = F.floor(F.least("y1", "y2") / band), F.ceil(F.greatest("y1", "y2") / band) - 1
    return e.select(F.col("poly_id").cast("long").alias("poly"), *more, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], F.explode(F.sequence(low, F.greatest(low, high))).alias("band"))


def _pairs(a: DataFrame, b: DataFrame, tile: float) -> DataFrame:
    """(a, b) of polygons whose boxes share a tile of the plane and meet."""
    spread = lambda lo, hi: F.sequence(F.floor(F.col(lo) / tile), F.floor(F.col(hi) / tile))
    boxes = lambda p, n: vector.bbox_of_polygons(p).select(F.col("poly_id").cast("long").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("xmin", "ymin", "xmax", "ymax")], F.explode(spread("xmin", "xmax")).alias("tx"), F.col("ymin").alias("lo"), F.col("ymax").alias("hi")).withColumn("ty", F.explode(spread("lo", "hi"))).drop("lo", "hi")
    met = boxes(a, "a").join(boxes(b, "b"), ["tx", "ty"])
    return met.filter("xmin_a < xmax_b and xmax_a > xmin_b and ymin_a < ymax_b and ymax_a > ymin_b").select("a", "b").distinct()


def alike(polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(poly_id, shape) of all polygons, and (poly_id, rings) of one polygon for each shape. Those with the same rings, however
    many rows hold them, have one shape: the least poly_id among them."""
    own = polygons.select(F.col("poly_id").cast("long").alias("poly_id"), "rings")
    told = own.withColumn("one", F.sha2(F.to_json("rings"), 256)).groupBy("poly_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list("one"))), 256).alias("told"))
    first = told.groupBy("told").agg(F.min("poly_id").alias("shape"))
    members = materialize(told.join(first, "told").select("poly_id", "shape"), "shapes")
    return members, own.join(members.filter("poly_id = shape"), "poly_id", "left_semi")


def each(rows: DataFrame, **of: DataFrame) -> DataFrame:
    """Rows of shapes, once for each polygon that has the shape. of: for columns of shapes the members that ``alike`` tells."""
    columns = rows.columns
    out = dealt(rows)  # by no column, or Spark would leave rows that are grouped by it where they are
    for name, members in of.items():
        out = out.withColumnRenamed(name, "shape").join(members.withColumnRenamed("poly_id", name), "shape").drop("shape")
    return out.select(*columns)


def shared(a: DataFrame, b: DataFrame, band: float = BAND) -> DataFrame:
    """(a, b, pieces) as ``intersection`` tells them, of polygons that are taken one by one."""
    pairs = _pairs(a, b, 4 * band)
    mine = _banded(a, band).withColumns({"a": F.col("poly"), "own": F.lit(True)})
    other = _banded(b, band).join(pairs, F.col("poly") == F.col("b")).drop("b").withColumn("own", F.lit(False))
    met = other.join(mine.select("a", "band").distinct(), ["a", "band"], "left_semi")
    return dealt(mine.unionByName(met), "a", "band").groupBy("a", "band").applyInPandas(partial(_slabs_of_pairs, band=band), f"a long, b long, {_PIECES}")


def intersection(a: DataFrame, b: DataFrame, band: float = BAND) -> DataFrame:
    """(a, b, pieces): what each polygon of a shares with each of b; pairs that share no area have no row."""
    (of_a, a), (of_b, b) = alike(a), alike(b)
    return each(shared(a, b, band), a=of_a, b=of_b)


def shared_areas(a: DataFrame, b: DataFrame, band: float = BAND) -> DataFrame:
    """(a, b, area, x, y): area and centroid of what each polygon of a shares with each of b, summed by shape."""
    (of_a, a), (of_b, b) = alike(a), alike(b)
    return each(areas(shared(a, b, band), "a", "b"), a=of_a, b=of_b)


def difference(a: DataFrame, b: DataFrame, band: float = BAND) -> DataFrame:
    """(a, pieces): what of each polygon of a lies in none of b."""
    (of_a, a), (_, b) = alike(a), alike(b)
    pairs = _pairs(a, b, 4 * band)
    mine = _banded(a, band).withColumns({"a": F.col("poly"), "own": F.lit(True)})
    other = _banded(b, band).join(pairs, F.col("poly") == F.col("b")).drop("b").withColumn("own", F.lit(False))
    met = other.join(mine.select("a", "band").distinct(), ["a", "band"], "left_semi")
    found = dealt(mine.unionByName(met), "a", "band").groupBy("a", "band").applyInPandas(partial(_slabs, by=["a"], band=band, keep=_kept_by_own), f"a long, {_PIECES}")
    return each(found, a=of_a)


def symmetric_difference(a: DataFrame, b: DataFrame, band: float = BAND) -> DataFrame:
    """(side, poly_id, pieces): what lies in polygons of one side alone."""
    one = lambda x, y, n: difference(x, y, band).select(F.lit(n).alias("side"), F.col("a").alias("poly_id"), *_PIECE)
    return one(a, b, "a").unionAll(one(b, a, "b"))


def dissolve(polygons: DataFrame, key: str, band: float = BAND) -> DataFrame:
    """(key, pieces): the union of the polygons with each value of a column."""
    kind = dict(polygons.dtypes)[key]
    rows = _banded(polygons, band, key).withColumn("own", F.lit(True))
    return dealt(rows, key, "band").groupBy(key, "band").applyInPandas(partial(_slabs, by=[key], band=band, keep=_kept_by_any), f"`{key}` {kind}, {_PIECES}")


def areas(pieces: DataFrame, *by: str) -> DataFrame:
    """(.., area, x, y): area and centroid of all pieces together."""
    h = F.col("y1") - F.col("y0")
    bottom, top = F.col("r0") - F.col("l0"), F.col("r1") - F.col("l1")
    area = h * (bottom + top) / 2
    # integrals of x and y over a trapezoid with level sides
    mx = h * (F.col("r0") ** 2 + F.col("r0") * F.col("r1") + F.col("r1") ** 2 - F.col("l0") ** 2 - F.col("l0") * F.col("l1") - F.col("l1") ** 2) / 6
    my = F.col("y0") * area + h * h * (bottom + 2 * top) / 6
    return pieces.groupBy(*by).agg(F.sum(area).alias("area"), F.try_divide(F.sum(mx), F.sum(area)).alias("x"), F.try_divide(F.sum(my), F.sum(area)).alias("y"))


def _level(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Level sides at one y -> what one side of the line alone has, pieces' interiors on the left."""
    cuts = np.unique(np.concatenate([rows["x1"].to_numpy(), rows["x2"].to_numpy()]))
    up = np.zeros(len(cuts), np.int64)
    for x1, x2 in zip(rows["x1"], rows["x2"]):
        lo, hi = np.searchsorted(cuts, (min(x1, x2), max(x1, x2)))
        up[lo:hi] += 1 if x1 < x2 else -1
    a, b, s = cuts[:-1], cuts[1:], up[:-1]
    a, b, s = a[s != 0], b[s != 0], s[s != 0]
    told = _told(rows, [*by, "y1"], len(a))
    return pd.DataFrame(told | {"x1": np.where(s > 0, a, b), "x2": np.where(s > 0, b, a)}).assign(y2=lambda d: d["y1"])


def outline(pieces: DataFrame, *by: str) -> DataFrame:
    """(.., x1, y1, x2, y2): the directed edges around the pieces, interiors on the left; sides that pieces share are gone."""
    kinds = dict(pieces.dtypes)
    r = lambda c: F.round(c, _DIGITS)
    edge = lambda *c: F.struct(*[r(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), c)])
    steep = pieces.select(*by, F.explode(F.array(edge("r0", "y0", "r1", "y1"), edge("l1", "y1", "l0", "y0"))).alias("e")).select(*by, "e.*")
    flat = pieces.select(*by, F.explode(F.array(edge("l0", "y0", "r0", "y0"), edge("r1", "y1", "l1", "y1"))).alias("e")).select(*by, "e.*").filter("x1 <> x2")
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "y1 double, x1 double, x2 double, y2 double"])
    level = flat.groupBy(*by, "y1").applyInPandas(partial(_level, by=list(by)), schema)
    # of steep sides that run both ways, as where pieces touch along one, none is left
    net = F.sum(F.when((F.col("y2") > F.col("y1")), 1).otherwise(-1))
    ways = steep.withColumns({"xa": F.when(F.col("y2") > F.col("y1"), F.col("x1")).otherwise(F.col("x2")), "ya": F.least("y1", "y2"), "xb": F.when(F.col("y2") > F.col("y1"), F.col("x2")).otherwise(F.col("x1")), "yb": F.greatest("y1", "y2")})
    left = ways.groupBy(*by, "xa", "ya", "xb", "yb").agg(net.alias("net")).filter("net <> 0")
    turned = lambda a, b: F.when(F.col("net") > 0, F.col(a)).otherwise(F.col(b))
    left = left.select(*by, turned("xa", "xb").alias("x1"), turned("ya", "yb").alias("y1"), turned("xb", "xa").alias("x2"), turned("yb", "ya").alias("y2"))
    return left.unionByName(level.select(*by, "x1", "y1", "x2", "y2"))


def _rings(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Directed edges of one result -> its rings, shells counter-clockwise, corners alone."""
    out = defaultdict(list)
    for x1, y1, x2, y2 in zip(rows["x1"], rows["y1"], rows["x2"], rows["y2"]):
        out[(x1, y1)].append((x2, y2))
    rings = []
    while out:
        start = next(iter(out))
        ring, at, came = [], start, None
        while True:
            options = out[at]
            if came and len(options) > 1:  # the leftmost way keeps rings that touch at a corner apart
                back = np.arctan2(came[1] - at[1], came[0] - at[0])
                options.sort(key=lambda p: (np.arctan2(p[1] - at[1], p[0] - at[0]) - back) % (2 * np.pi), reverse=True)
            nxt = options.pop(0)
            if not options:
                del out[at]
            ring.append(at)
            came, at = at, nxt
            if at == start:
                break
        n = len(ring)
        cross = [(ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) - (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0]) for i in range(n)]
        size = [abs(ring[i][0] - ring[i - 1][0]) + abs(ring[i][1] - ring[i - 1][1]) for i in range(n)]
        kept = [p for p, c, s, t in zip(ring, cross, size, [*size[1:], size[0]]) if abs(c) > 1e-7 * s * t]
        if len(kept) > 2:
            rings.append([{"x": float(x), "y": float(y)} for x, y in kept])
    return pd.DataFrame({**_told(rows, by, 1), "rings": [rings]})


def polygons(pieces: DataFrame, *by: str) -> DataFrame:
    """(.., rings): one row for each result. A row and its group hold a whole outline; ``outline`` and ``areas`` have no such
    limit."""
    kinds = dict(pieces.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "rings array<array<struct<x:double,y:double>>>"])
    return outline(pieces, *by).groupBy(*by).applyInPandas(partial(_rings, by=list(by)), schema)
