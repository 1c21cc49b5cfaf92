"""Shapes made from shapes: simplified outlines, convex hulls, and the points farthest inside.

``simplified`` splits a line at its farthest point, again and again, in rounds over a table of points: a round is one
aggregate and one join by stretch, so a long ring is worked on by as many tasks as it has points for. ``hulls`` takes the
hull of each task's points first, and of these the hull of each group: what is shuffled are corners. ``poles`` halves
squares, and keeps those that can still hold a point farther from the outline than the best so far.

Edge cases: a ring with fewer than four points stays as it is; points that are equal count once in a hull, and fewer than
three that aren't in line have the hull of their ends; a polygon without area has no pole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import discard, materialize

from . import relations, vector


def _off(x: Column, y: Column, a: Column, b: Column) -> Column:
    """The distance of a point from the stretch between two."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(size > 0, ((x - a["x"]) * dx + (y - a["y"]) * dy) / size).otherwise(0.0)))
    return F.sqrt((x - a["x"] - t * dx) ** 2 + (y - a["y"] - t * dy) ** 2)


def ring_points(polygons: DataFrame) -> DataFrame:
    """(poly_id, ring, seq, x, y) of all rings."""
    rings = polygons.select("poly_id", F.posexplode("rings").alias("ring", "points"))
    return rings.select("poly_id", "ring", F.posexplode("points").alias("seq", "p")).select("poly_id", "ring", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def simplified(points: DataFrame, tolerance: float) -> DataFrame:
    """Those of the points (poly_id, ring, seq, x, y) of closed rings that keep all others within the tolerance of the new
    outline. The first point of a ring stays, and the one farthest from it."""
    own = ["poly_id", "ring"]
    at = F.struct("seq", "x", "y")
    first = points.groupBy(*own).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    far = points.join(first, own).withColumn("d", (F.col("x") - F.col("first.x")) ** 2 + (F.col("y") - F.col("first.y")) ** 2)
    anchors = far.groupBy(*own).agg(F.max_by(at, F.struct(F.col("d"), -F.col("seq"))).alias("mid"), F.first("first").alias("first"), F.max("n").alias("n"))
    back = F.struct(F.lit(1 << 30).alias("seq"), F.col("first.x").alias("x"), F.col("first.y").alias("y"))
    out = points.join(anchors, own)
    small = out.filter("n < 4").select(*own, "seq", "x", "y")
    out = out.filter("n >= 4")
    later = F.col("seq") > F.col("mid.seq")
    ends = out.filter((F.col("seq") == F.col("first.seq")) | (F.col("seq") == F.col("mid.seq"))).select(*own, "seq", "x", "y")
    kept = [small, ends]
    open_ = out.filter((F.col("seq") != F.col("first.seq")) & (F.col("seq") != F.col("mid.seq")))
    open_ = materialize(open_.select(*own, "seq", "x", "y", F.when(later, F.col("mid")).otherwise(F.col("first")).alias("a"), F.when(later, back).otherwise(F.col("mid")).alias("b")), "simplify")
    while True:
        d = _off(F.col("x"), F.col("y"), F.col("a"), F.col("b"))
        split = open_.groupBy(*own, F.col("a.seq").alias("from")).agg(F.max_by(at, F.struct(d, -F.col("seq"))).alias("far"), F.max(d).alias("most")).filter(F.col("most") > tolerance).drop("most")
        split = materialize(split, "simplify-split")
        if split.isEmpty():
            break
        kept.append(split.select(*own, "far.seq", "far.x", "far.y"))
        met = open_.withColumn("from", F.col("a.seq")).join(split, [*own, "from"]).filter(F.col("seq") != F.col("far.seq"))
        later = F.col("seq") > F.col("far.seq")
        then = materialize(met.select(*own, "seq", "x", "y", F.when(later, F.col("far")).otherwise(F.col("a")).alias("a"), F.when(later, F.col("b")).otherwise(F.col("far")).alias("b")), "simplify")
        discard(open_)
        open_ = then
    every = kept[0]
    for part in kept[1:]:
        every = every.unionByName(part)
    return every


def polygons_of(points: DataFrame) -> DataFrame:
    """(poly_id, ring, seq, x, y) -> (poly_id, rings): one row for each polygon."""
    ring = points.groupBy("poly_id", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    return ring.groupBy("poly_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))


def _hull(x: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Corners counter-clockwise from the least point on."""
    points = sorted(set(zip(x.tolist(), y.tolist())))
    if len(points) < 3:
        return points

    def half(some: list) -> list:
        out: list[tuple[float, float]] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def hulls(points: DataFrame) -> DataFrame:
    """(poly_id, x, y) -> (poly_id, seq, x, y): the corners of each group's convex hull."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, x, y) for i, part in batch.groupby("poly_id") for x, y in _hull(part["x"].to_numpy(float), part["y"].to_numpy(float))]
            yield pd.DataFrame(rows, columns=["poly_id", "x", "y"])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = _hull(rows["x"].to_numpy(float), rows["y"].to_numpy(float))
        return pd.DataFrame({"poly_id": rows["poly_id"].iloc[0], "seq": range(len(out)), "x": [p[0] for p in out], "y": [p[1] for p in out]})

    typed = points.filter("x is not null and y is not null and poly_id is not null").select(F.col("poly_id").cast("long").alias("poly_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    some = typed.mapInPandas(partial, "poly_id long, x double, y double")
    return some.groupBy("poly_id").applyInPandas(whole, "poly_id long, seq int, x double, y double")


def poles(polygons: DataFrame, precision: float = 0.01) -> DataFrame:
    """(poly_id, x, y, distance): of each polygon the point inside that is farthest from its outline, within the precision."""
    boxes = vector.bbox_of_polygons(polygons).filter("xmax > xmin and ymax > ymin")
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    cells = boxes.select("poly_id", ((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"), (side / 2).alias("half"))
    best = None
    while True:
        cells = cells.withColumn("id", F.monotonically_increasing_id())
        cells = materialize(cells, "pole-cells")
        far = relations.distances(cells, polygons)
        inside = vector.inside_of(cells, polygons).withColumn("in", F.lit(True))
        told = cells.join(far, ["poly_id", "id"]).join(inside, ["poly_id", "id"], "left")
        told = materialize(told.withColumn("distance", F.when(F.coalesce("in", F.lit(False)), F.col("distance")).otherwise(-F.col("distance"))).drop("in"), "pole-told")
        here = told.groupBy("poly_id").agg(F.max_by(F.struct("x", "y", "distance"), F.struct(F.col("distance"), -F.col("x"), -F.col("y"))).alias("top"))
        if best is not None:
            both = best.unionByName(here)
            here = both.groupBy("poly_id").agg(F.max_by("top", F.struct(F.col("top.distance"), -F.col("top.x"), -F.col("top.y"))).alias("top"))
        best = materialize(here, "pole-best")
        open_ = told.join(best, "poly_id").filter(F.col("distance") + F.col("half") * float(np.sqrt(2)) > F.col("top.distance") + precision)
        quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-0.5, 0.5) for j in (-0.5, 0.5)])).alias("q")
        then = open_.select("poly_id", "x", "y", "half", quarter).select("poly_id", (F.col("x") + F.col("q.i") * F.col("half")).alias("x"), (F.col("y") + F.col("q.j") * F.col("half")).alias("y"), (F.col("half") / 2).alias("half"))
        if then.isEmpty():
            return best.filter("top.distance > 0").select("poly_id", "top.x", "top.y", "top.distance")
        cells = then
