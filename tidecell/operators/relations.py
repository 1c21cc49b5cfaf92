"""How polygons lie to one another, and selections by it.

For each pair whose boxes meet: whether the interiors share an area (ii), whether the first has area outside the second (ie)
and the second outside the first (ei), both from the areas of ``overlay``, and whether the boundaries meet (bb), from a join of
edges by tiles of the plane. All predicates between polygons follow from these four entries of the nine-intersection
matrix; the others are those of any two polygons. Pairs that have no row are disjoint. All this is found for shapes, as
``overlay.alike`` tells them, and then told of the polygons that have them.

Edge cases: areas that are a share of 1e-9 of the polygon's own count as none; boundaries meet within 1e-9 of the
coordinates; two polygons never cross, as that is for shapes of different dimensions; a polygon that lies in another's hole
is disjoint from it, or touches it; null polygons have no edges and are disjoint from all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import overlay, vector

_LEAST = 1e-9


def _edges(polygons: DataFrame, name: str, tile: float) -> DataFrame:
    """(name, a1, b1, a2, b2, tx, ty): all edges, level ones too, once for each tile that their box touches."""
    e = vector.edges_with_level(polygons).select(F.col("poly_id").cast("long").alias(name), *[F.col(n).cast("double").alias(f"{n}_{name}") for n in ("x1", "y1", "x2", "y2")])
    c = lambda n: F.col(f"{n}_{name}")
    tiles = lambda p, q: F.sequence(F.floor((F.least(p, q) - _LEAST) / tile), F.floor((F.greatest(p, q) + _LEAST) / tile))
    return e.withColumn("tx", F.explode(tiles(c("x1"), c("x2")))).withColumn("ty", F.explode(tiles(c("y1"), c("y2"))))


def boundaries_meet(a: DataFrame, b: DataFrame, tile: float = 64.0) -> DataFrame:
    """(a, b) of polygons whose outlines have a point in common."""
    met = _edges(a, "a", tile).join(_edges(b, "b", tile), ["tx", "ty"])
    v = lambda n: F.col(n)
    boxes = (F.least(v("x1_a"), v("x2_a")) <= F.greatest(v("x1_b"), v("x2_b")) + _LEAST) & (F.least(v("x1_b"), v("x2_b")) <= F.greatest(v("x1_a"), v("x2_a")) + _LEAST)
    boxes = boxes & (F.least(v("y1_a"), v("y2_a")) <= F.greatest(v("y1_b"), v("y2_b")) + _LEAST) & (F.least(v("y1_b"), v("y2_b")) <= F.greatest(v("y1_a"), v("y2_a")) + _LEAST)

    def side(p: str, q: str, n: str) -> Column:
        """On which side of the line from p to q a point lies: -1, 0 or 1, by its distance from the line."""
        dx, dy = v(f"x{q[0]}_{q[1]}") - v(f"x{p[0]}_{p[1]}"), v(f"y{q[0]}_{q[1]}") - v(f"y{p[0]}_{p[1]}")
        d = dx * (v(f"y{n[0]}_{n[1]}") - v(f"y{p[0]}_{p[1]}")) - dy * (v(f"x{n[0]}_{n[1]}") - v(f"x{p[0]}_{p[1]}"))
        return F.when(F.abs(d) <= _LEAST * F.sqrt(dx * dx + dy * dy), 0).otherwise(F.signum(d))

    cross = (side("1a", "2a", "1b") * side("1a", "2a", "2b") <= 0) & (side("1b", "2b", "1a") * side("1b", "2b", "2a") <= 0)
    return met.filter(boxes & cross).select("a", "b").distinct()


def _related(a: DataFrame, b: DataFrame, band: float) -> DataFrame:
    """(a, b, ii, ie, ei, bb) of shapes."""
    size = lambda p, n: overlay.areas(overlay.dissolve(p, "poly_id", band), "poly_id").select(F.col("poly_id").alias(n), F.col("area").alias(f"area_{n}"))
    shared = overlay.areas(overlay.shared(a, b, band), "a", "b").select("a", "b", F.col("area").alias("both"))
    every = shared.join(boundaries_meet(a, b, 4 * band).withColumn("bb", F.lit(True)), ["a", "b"], "full")
    every = every.join(size(a, "a"), "a", "left").join(size(b, "b"), "b", "left").withColumn("both", F.coalesce("both", F.lit(0.0)))
    own = lambda n: F.coalesce(f"area_{n}", F.lit(0.0))
    some = F.col("both") > _LEAST * F.least(own("a"), own("b"))
    left = lambda n: own(n) - F.col("both") > _LEAST * own(n)
    out = every.select("a", "b", some.alias("ii"), left("a").alias("ie"), left("b").alias("ei"), F.coalesce("bb", F.lit(False)).alias("bb"))
    return out.filter("ii or bb")


def relate(a: DataFrame, b: DataFrame, band: float = overlay.BAND) -> DataFrame:
    """(a, b, ii, ie, ei, bb) of the pairs that aren't disjoint."""
    (of_a, a), (of_b, b) = overlay.alike(a), overlay.alike(b)
    return overlay.each(_related(a, b, band), a=of_a, b=of_b)


#: Each predicate by the entries of ``relate``.
PREDICATES = {
    "intersects": "true", "touches": "not ii and bb", "contains": "ii and not ei", "within": "ii and not ie",
    "equals": "ii and not ie and not ei", "overlaps": "ii and ie and ei", "crosses": "false",
}


def select_by_location(a: DataFrame, b: DataFrame, predicate: str, band: float = overlay.BAND) -> DataFrame:
    """The polygons of a that have the relation to any of b, or, with disjoint, to none any."""
    (of_a, shapes), (_, others) = overlay.alike(a), overlay.alike(b)
    met = _related(shapes, others, band).filter("true" if predicate == "disjoint" else PREDICATES[predicate])
    met = overlay.each(met.select("a").distinct(), a=of_a).withColumnRenamed("a", "poly_id")
    return a.join(met, "poly_id", "left_anti" if predicate == "disjoint" else "left_semi").select(*a.columns)


def distances(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(poly_id, id, distance) of points (poly_id, id, x, y) from the outlines of their own polygons."""
    e = vector.edges_with_level(polygons)
    met = points.join(e, "poly_id")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / size).otherwise(0.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    d = F.sqrt((F.col("x") - F.col("x1") - t * dx) ** 2 + (F.col("y") - F.col("y1") - t * dy) ** 2)
    return met.groupBy("poly_id", "id").agg(F.min(d).alias("distance"))
