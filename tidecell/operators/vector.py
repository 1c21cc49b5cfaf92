"""Points, polygons and rasters. Polygons meet cells along rows: an edge is dealt to the rows it crosses, the crossings of a
row are paired to runs of columns, and runs are dealt to blocks of columns. So a cell meets, by an equi-join on its row and
block, only what passes through its block, however many polygons cross its row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import materialize

from . import ranks
from .algebra import grid_of, key


def sample(points: DataFrame, cells: DataFrame, x0: float = 0.0, y0: float = 0.0, res: float = 1.0, name: str = "value") -> DataFrame:
    """The value of the cell that holds each point; NULL outside the grid and on no-data. Of many grids, points that have a
    grid_id look into their own."""
    g = [c for c in grid_of(cells) if c in points.columns]
    p = points.withColumns({"__r": F.floor((y0 - F.col("y")) / res).cast("int"), "__c": F.floor((F.col("x") - x0) / res).cast("int")})
    c = cells.select(*g, F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("value").alias(name))
    return p.join(c, [*g, "__r", "__c"], "left").select(*points.columns, name)


def edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, rings) -> (poly_id, x1, y1, x2, y2), each ring closed, without level edges, which no row crosses."""
    return edges_with_level(polygons).filter("y1 <> y2")


def edges_with_level(polygons: DataFrame) -> DataFrame:
    ring = polygons.select("poly_id", F.explode("rings").alias("ring"))
    follow = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    e = ring.select("poly_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), follow.alias("b"))).alias("e"))
    return e.select("poly_id", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))


def inside_of(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(poly_id, id) of the points (poly_id, id, x, y) that lie in their own polygons."""
    met = points.select("poly_id", "id", "x", "y").join(edges(polygons), "poly_id")
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    return met.filter(cross).groupBy("poly_id", "id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("poly_id", "id")


def crossings(polygon_edges: DataFrame, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """(poly_id, row, xs): where the polygon's outline crosses the centre line of each row of cells."""
    top, low = F.greatest("y1", "y2"), F.least("y1", "y2")
    # rows whose centre y0 - (row + .5) res is in [low, top)
    first = (F.floor((y0 - top) / res - 0.5) + 1).cast("int")
    last = F.floor((y0 - low) / res - 0.5).cast("int")
    e = polygon_edges.withColumns({"first": first, "last": last}).filter("first <= last")
    e = e.select("poly_id", "x1", "y1", "x2", "y2", F.explode(F.sequence("first", "last")).alias("row"))
    y = y0 - (F.col("row") + 0.5) * res
    x = F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    return e.select("poly_id", "row", x.alias("x")).groupBy("poly_id", "row").agg(F.collect_list("x").alias("xs"))


#: Columns of a block in which cells meet runs, and widths of the tiles in which points meet polygons.
BLOCK = 64


def runs(polygons: DataFrame, x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """(poly_id, row, first, last): the columns whose centres the polygon holds in each row."""
    xs = F.sort_array("xs")
    column = lambda x: F.ceil((x - x0) / res - 0.5).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(column(F.get(xs, i)).alias("first"), (column(F.get(xs, i + 1)) - 1).alias("last")))
    run = crossings(edges(polygons), y0, res).filter("size(xs) > 1").select("poly_id", "row", F.explode(pairs).alias("r"))
    return run.select("poly_id", "row", "r.first", "r.last").filter("first <= last")


def inside(cells: DataFrame, polygons: DataFrame, x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """The cells whose centre is in a polygon, once for each polygon."""
    block = lambda c: F.floor(F.col(c) / BLOCK)
    dealt = runs(polygons, x0, y0, res).withColumn("block", F.explode(F.sequence(block("first"), block("last"))))
    met = cells.withColumn("block", block("col")).join(dealt, ["row", "block"]).filter("col between first and last")
    return met.select(*cells.columns, "poly_id")


def rasterize(cells: DataFrame, polygons: DataFrame, x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """(.., wet boolean): whether the cell's centre is in any polygon."""
    k = key(cells)
    hit = inside(cells.select(*k), polygons, x0, y0, res).select(*k).distinct().withColumn("wet", F.lit(True))
    return cells.select(*k).join(hit, k, "left").select(*k, F.coalesce("wet", F.lit(False)).alias("wet"))


def burn(cells: DataFrame, polygons: DataFrame, **where) -> DataFrame:
    return rasterize(cells, polygons, **where).select(*key(cells), F.when(F.col("wet"), F.lit(1.0)).alias("value"))


def zonal_stats(cells: DataFrame, polygons: DataFrame, **where) -> DataFrame:
    """(poly_id, count, min, max, mean, sum, std, median) of the cells with data in each polygon. Equal values are counted
    before anything else, so no buffer holds a polygon's values."""
    counts = materialize(ranks.counted(inside(cells, polygons, **where), ["poly_id"], F.col("value")), "zonal-counts")
    v, n = F.col("v"), F.when(F.col("v").isNotNull(), F.col("n"))
    first = counts.groupBy("poly_id").agg(F.coalesce(F.sum(n), F.lit(0)).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.sum(v * n).alias("sum"))
    spread = counts.join(first.select("poly_id", "mean"), "poly_id").groupBy("poly_id").agg(F.sqrt(F.sum(n * (v - F.col("mean")) ** 2) / F.sum(n)).alias("std"))
    half = ranks.placed(counts, ["poly_id"]).groupBy("poly_id").agg(ranks.quantile(0.5).alias("median"))
    return first.join(spread, "poly_id").join(half, "poly_id", "left").select("poly_id", "count", "min", "max", "mean", "sum", "std", "median")


def zonal_order_statistics(cells: DataFrame, polygons: DataFrame, **where) -> DataFrame:
    """(poly_id, count, unique, q1, median, q3, iqr, minority, majority) of the cells in each polygon."""
    return ranks.order_statistics(inside(cells, polygons, **where), ["poly_id"], F.col("value"))


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Directed unit edges of one area -> its closed rings. At a crossing the turn to the right keeps rings apart."""
    from collections import defaultdict

    out, rings = defaultdict(list), []
    for r1, c1, r2, c2 in zip(pdf.r1, pdf.c1, pdf.r2, pdf.c2):
        out[(r1, c1)].append((r2, c2))
    while out:
        start = min(out)
        ring, at, came = [start], start, None
        while True:
            options = out[at]
            if came and len(options) > 1:
                d = (at[0] - came[0], at[1] - came[1])
                options.sort(key=lambda p: (p[0] - at[0], p[1] - at[1]) != (d[1], -d[0]))
            nxt = options.pop(0)
            if not options:
                del out[at]
            came, at = at, nxt
            if at == start:
                break
            ring.append(at)
        corner = [p for i, p in enumerate(ring) if (ring[i - 1][0] - p[0]) * (ring[(i + 1) % len(ring)][1] - p[1]) != (ring[i - 1][1] - p[1]) * (ring[(i + 1) % len(ring)][0] - p[0])]
        rings.append([{"x": float(c), "y": float(-r)} for r, c in corner])
    return pd.DataFrame({"poly_id": [int(pdf.label.iloc[0])], "rings": [rings]})


def polygonize(labels: DataFrame, tile: int | None = None) -> DataFrame:
    """(row, col, label) areas -> polygons (poly_id, rings) in cell units, y up. Edges between cells of one area cancel,
    so only an area's outline is chained, not its cells. With a tile, areas are cut at the borders of tiles of so many cells,
    one polygon for each (poly_id, tile), so that no task gets the whole outline of a large one."""
    sides = {(0, 1): (1, 1, 0, 1), (0, -1): (0, 0, 1, 0), (1, 0): (1, 0, 1, 1), (-1, 0): (0, 1, 0, 0)}
    s = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("i", "j", "a", "b", "c", "d"), (*d, *e))]) for d, e in sides.items()])).alias("s")
    each = labels.select("row", "col", "label", s).withColumns({"nr": F.col("row") + F.col("s.i"), "nc": F.col("col") + F.col("s.j")})
    other = labels.select(F.col("row").alias("nr"), F.col("col").alias("nc"), "label")
    part = lambda r, c: F.struct(F.floor(F.col(r) / (tile or 1 << 31)), F.floor(F.col(c) / (tile or 1 << 31)))
    other, each = other.withColumn("part", part("nr", "nc")), each.withColumn("part", part("row", "col"))
    out = each.join(other, ["nr", "nc", "label", "part"], "left_anti")
    ring = "poly_id long, rings array<array<struct<x:double,y:double>>>"
    return out.select("label", "part", (F.col("row") + F.col("s.a")).alias("r1"), (F.col("col") + F.col("s.b")).alias("c1"), (F.col("row") + F.col("s.c")).alias("r2"), (F.col("col") + F.col("s.d")).alias("c2")).groupBy("label", "part").applyInPandas(_chain, ring)


def areas_of(labels: DataFrame) -> DataFrame:
    """(label, area, x, y) in cell units, y up: what ``area_and_centroid`` gives for the polygons, without building them."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("area"), F.avg(F.col("col") + 0.5).alias("x"), F.avg(-(F.col("row") + 0.5)).alias("y"))


def area_and_centroid(polygons: DataFrame) -> DataFrame:
    """By the shoelace formula over all rings."""
    e = polygons.select("poly_id", F.explode("rings").alias("ring"))
    follow = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    e = e.select("poly_id", F.explode(F.arrays_zip(F.col("ring").alias("a"), follow.alias("b"))).alias("e"))
    cross = F.col("e.a.x") * F.col("e.b.y") - F.col("e.b.x") * F.col("e.a.y")
    sums = e.groupBy("poly_id").agg(F.sum(cross).alias("s"), F.sum((F.col("e.a.x") + F.col("e.b.x")) * cross).alias("sx"), F.sum((F.col("e.a.y") + F.col("e.b.y")) * cross).alias("sy"))
    third = lambda c: F.try_divide(F.col(c), 3 * F.col("s"))
    return sums.select("poly_id", F.abs(F.col("s") / 2).alias("area"), third("sx").alias("x"), third("sy").alias("y"))


def bbox(points: DataFrame) -> DataFrame:
    return points.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def bbox_of_polygons(polygons: DataFrame) -> DataFrame:
    """(poly_id, xmin, ymin, xmax, ymax)."""
    flat = polygons.select("poly_id", F.explode(F.flatten("rings")).alias("p"))
    return flat.groupBy("poly_id").agg(F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))


def bbox_intersection(boxes: DataFrame) -> DataFrame:
    """What all boxes (xmin, ymin, xmax, ymax) share; no row if that has no area."""
    both = boxes.agg(F.max("xmin").alias("xmin"), F.max("ymin").alias("ymin"), F.min("xmax").alias("xmax"), F.min("ymax").alias("ymax"))
    return both.filter("xmax > xmin and ymax > ymin")


def distance_matrix(points: DataFrame, radius: float) -> DataFrame:
    """(a, b, distance) of the points (id, x, y) within the radius of each other, each pair once. A point meets its own tile and
    half of those around it, so nothing beyond two tiles is compared."""
    tile = lambda c: F.floor(F.col(c) / radius)
    at = points.select("id", "x", "y", tile("x").alias("tx"), tile("y").alias("ty"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))])).alias("n")
    sent = at.select("id", "x", "y", "tx", "ty", near).select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("tx") + F.col("n.i")).alias("tx"), (F.col("ty") + F.col("n.j")).alias("ty"), ((F.col("n.i") == 0) & (F.col("n.j") == 0)).alias("own"))
    met = at.join(sent, ["tx", "ty"]).filter(~F.col("own") | (F.col("a") < F.col("id")))
    d = F.sqrt((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2)
    return met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), d.alias("distance")).filter(F.col("distance") <= radius)


def clusters(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """The points (.., x, y) with the number of their cluster by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    at = VectorAssembler(inputCols=["x", "y"], outputCol="__at").transform(points)
    return KMeans(k=k, seed=seed, featuresCol="__at", predictionCol="cluster").fit(at).transform(at).drop("__at")


def drop_nodata_points(points: DataFrame, column: str = "value", nodata: float = -9999.0) -> DataFrame:
    return points.filter(F.col(column) != nodata).drop("z")


def _point_pairs(points: DataFrame, polygons: DataFrame, res: float) -> DataFrame:
    """(id, poly_id) of points within polygons. A polygon is dealt to bands of y, there to the tiles of its own extent, and a
    point counts the edges to its right of the polygons in its tile."""
    e = edges(polygons)
    rows = e.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / res), F.floor(F.greatest("y1", "y2") / res))))
    tile = lambda x: F.floor(x / (BLOCK * res))
    extent = rows.groupBy("poly_id", "band").agg(tile(F.min(F.least("x1", "x2"))).alias("first"), tile(F.max(F.greatest("x1", "x2"))).alias("last"))
    dealt = extent.withColumn("tile", F.explode(F.sequence("first", "last"))).select("poly_id", "band", "tile")
    near = points.select("id", "x", "y").withColumns({"band": F.floor(F.col("y") / res), "tile": tile(F.col("x"))}).join(dealt, ["band", "tile"])
    cross = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    met = near.join(rows, ["poly_id", "band"]).filter(cross)
    return met.groupBy("id", "poly_id").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("id", "poly_id")


def select_by_location(points: DataFrame, polygons: DataFrame, predicate: str = "within", res: float = 1.0) -> DataFrame:
    """Points (id, x, y) that are within any polygon, or, by the predicate disjoint, within none."""
    how = {"within": "left_semi", "intersects": "left_semi", "disjoint": "left_anti"}[predicate]
    return points.join(_point_pairs(points, polygons, res).select("id").distinct(), "id", how)


def join_by_location(points: DataFrame, polygons: DataFrame, value: str, res: float = 1.0, order: bool = False) -> DataFrame:
    """(poly_id, count, sum, mean, min, max) of a column of the points within each polygon; polygons without any have count 0.
    With order also unique, range, stddev, q1, median, q3, iqr, minority and majority."""
    at = _point_pairs(points, polygons, res).join(points.select("id", F.col(value).alias("v")), "id")
    got = at.groupBy("poly_id").agg(F.count(F.lit(1)).alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_pop("v").alias("stddev"))
    if order:
        more = ranks.order_statistics(at, ["poly_id"], F.col("v")).drop("count")
        got = got.withColumn("range", F.col("max") - F.col("min")).join(more, "poly_id")
    else:
        got = got.drop("stddev")
    return polygons.select("poly_id").join(got, "poly_id", "left").fillna(0, ["count"])


def clip_convex(polygons: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Each ring cut to a convex polygon, counter-clockwise, side by side: what of it lies inside, with the sides where it was
    cut (parts into which a ring that isn't convex falls touch along these). Polygons wholly outside go. Column functions
    only: no shuffle."""

    def cut(x1: float, y1: float, x2: float, y2: float):
        side = lambda p: (p["y"] - y1) * (x2 - x1) - (p["x"] - x1) * (y2 - y1)

        def step(a, b):
            t = side(a) / (side(a) - side(b))
            at = F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))
            return F.when((side(a) >= 0) & (side(b) >= 0), F.array(b)).when(side(a) >= 0, F.array(at)).when(side(b) >= 0, F.array(at, b)).otherwise(F.slice(F.array(b), 1, 0))

        return lambda ring: F.flatten(F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), step))

    for (x1, y1), (x2, y2) in zip(corners, [*corners[1:], corners[0]]):
        polygons = polygons.withColumn("rings", F.transform("rings", cut(x1, y1, x2, y2)))
    return polygons.withColumn("rings", F.filter("rings", lambda r: F.size(r) > 2)).filter(F.size("rings") > 0)


def clip_polygons(polygons: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Polygons cut to a box."""
    return clip_convex(polygons, [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)])


def intersection_of(polygons: DataFrame, others: list[list[tuple[float, float]]]) -> DataFrame:
    """What polygons share with each of several convex ones; those that share no area go."""
    for corners in others:
        polygons = clip_convex(polygons, corners)
    return polygons.join(area_and_centroid(polygons).filter("area > 0").select("poly_id"), "poly_id", "left_semi")


def confusion_labels(codes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each label of the confusion codes."""
    from tidecell.schemas import CONFUSION

    label = F.create_map(*[F.lit(x) for k, v in CONFUSION.items() for x in (v, k)])[F.col("code")]
    return codes.withColumn("label", label).groupBy(*(by or []), "label").agg(F.count(F.lit(1)).alias("n"))


