"""Overlay against counts of sample points, of shapes on a lattice exactly, and by identities of areas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidecell.operators import overlay, relations, vector

KIND = "poly_id long, rings array<array<struct<x:double,y:double>>>, kind string"


def frame(spark, shapes):
    return spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings], k) for i, rings, k in shapes], KIND)


def star(r, x, y, size, n):
    """A shape that is not convex."""
    return [(x + size * f * math.cos(2 * math.pi * i / n), y + size * f * math.sin(2 * math.pi * i / n)) for i in range(n) for f in [r.uniform(0.3, 1.0)]]


def holed(r, x, y, size, n):
    return [star(r, x, y, size, n), [(x + size * 0.2 * math.cos(t), y + size * 0.2 * math.sin(t)) for t in (0.1, 2.0, 4.0)]]


def square(x, y, s, t=None):
    return [(x, y), (x + s, y), (x + s, y + (t or s)), (x, y + (t or s))]


def within(rings, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def area(rings):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])) / 2)


def in_pieces(pieces, x, y):
    return any(p.y0 <= y < p.y1 and p.l0 + (y - p.y0) * (p.l1 - p.l0) / (p.y1 - p.y0) <= x < p.r0 + (y - p.y0) * (p.r1 - p.r0) / (p.y1 - p.y0) for p in pieces)


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(8)
    a = [(i, holed(r, r.uniform(-10, 10), r.uniform(-10, 10), r.uniform(2, 7), r.randint(5, 12)), "xy"[i % 2]) for i in range(7)]
    b = [(i, holed(r, r.uniform(-10, 10), r.uniform(-10, 10), r.uniform(2, 7), r.randint(5, 12)), "xy"[i % 2]) for i in range(6)]
    return a, b


@pytest.mark.parametrize("band", [1.5, 100.0])
def test_overlay_of_shapes_with_holes(spark, shapes, band):
    a, b = shapes
    fa, fb = frame(spark, a), frame(spark, b)
    r = random.Random(1)
    spots = [(r.uniform(-15, 15), r.uniform(-15, 15)) for _ in range(1500)]
    both, less, sym, union = (x.collect() for x in (overlay.intersection(fa, fb, band), overlay.difference(fa, fb, band), overlay.symmetric_difference(fa, fb, band), overlay.dissolve(fa, "kind", band)))
    for x, y in spots:
        ia, ib = {i for i, g, _ in a if within(g, x, y)}, {i for i, g, _ in b if within(g, x, y)}
        assert {(p.a, p.b) for p in both if in_pieces([p], x, y)} == {(i, j) for i in ia for j in ib}
        assert {p.a for p in less if in_pieces([p], x, y)} == (ia if not ib else set())
        assert {(p.side, p.poly_id) for p in sym if in_pieces([p], x, y)} == ({("a", i) for i in ia} if not ib else set()) | ({("b", i) for i in ib} if not ia else set())
        assert {p.kind for p in union if in_pieces([p], x, y)} == {k for i, _, k in a if i in ia}
    # what is shared with each polygon of b and what with none make up a polygon, where those of b are apart
    apart = frame(spark, [(i, [square(-12 + 6 * i, -20, 4, 40)], "k") for i in range(4)])
    sums = {x.a: x.area for x in overlay.areas(overlay.intersection(fa, apart, band), "a").collect()}
    rest = {x.a: x.area for x in overlay.areas(overlay.difference(fa, apart, band), "a").collect()}
    whole = {x.poly_id: x.area for x in overlay.areas(overlay.dissolve(fa, "poly_id", band), "poly_id").collect()}
    for i, _, _ in a:
        assert sums.get(i, 0) + rest.get(i, 0) == pytest.approx(whole[i], abs=1e-9)


def test_rings_of_results(spark, shapes):
    """The rings have the areas of the pieces, and no edge twice."""
    a, b = shapes
    for pieces, by in ((overlay.intersection(frame(spark, a), frame(spark, b), 2.0), ["a", "b"]), (overlay.difference(frame(spark, a), frame(spark, b), 2.0), ["a"]), (overlay.dissolve(frame(spark, a), "kind", 2.0), ["kind"])):
        want = {tuple(x[c] for c in by): x for x in overlay.areas(pieces, *by).collect()}
        got = {tuple(x[c] for c in by): [[(p["x"], p["y"]) for p in ring] for ring in x.rings] for x in overlay.polygons(pieces, *by).collect()}
        assert set(got) == set(want)
        for k, rings in got.items():
            assert sum(a[0] * b[1] - b[0] * a[1] for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])) / 2 == pytest.approx(want[k].area, abs=1e-6)
        each = overlay.outline(pieces, *by)
        assert each.groupBy(*by, F.least("x1", "x2"), F.least("y1", "y2"), F.greatest("x1", "x2"), F.greatest("y1", "y2")).count().filter("count > 1").count() == 0


def test_lattice(spark):
    """Exact: squares that touch, overlap, lie in holes and repeat."""
    frame_with_hole = [square(0, 0, 10), square(3, 3, 4)]
    a = frame(spark, [(0, frame_with_hole, "p"), (1, [square(10, 0, 5)], "p"), (2, [square(20, 20, 2)], "q"), (3, [square(20, 20, 2)], "q"), (4, [square(21, 22, 3)], None)])
    b = frame(spark, [(7, [square(4, 4, 2)], "z"), (8, [square(2, 2, 6)], "z"), (9, [square(40, 40, 1)], "z")])
    both = {(x.a, x.b): (x.area, x.x, x.y) for x in overlay.areas(overlay.intersection(a, b, 3.0), "a", "b").collect()}
    assert both == {(0, 8): (pytest.approx(20), pytest.approx(5), pytest.approx(5))}
    less = {x.a: x.area for x in overlay.areas(overlay.difference(a, b, 3.0), "a").collect()}
    assert less == {0: pytest.approx(64), 1: pytest.approx(25), 2: pytest.approx(4), 3: pytest.approx(4), 4: pytest.approx(9)}
    rings = {x.kind: sorted(sorted((p["x"], p["y"]) for p in ring) for ring in x.rings) for x in overlay.polygons(overlay.dissolve(a, "kind", 3.0), "kind").collect()}
    assert rings == {"p": [[(0, 0), (0, 10), (10, 5), (10, 10), (15, 0), (15, 5)], [(3, 3), (3, 7), (7, 3), (7, 7)]], "q": [[(20, 20), (20, 22), (22, 20), (22, 22)]], None: [[(21, 22), (21, 25), (24, 22), (24, 25)]]}
    none = frame(spark, [])
    assert overlay.intersection(a, none).count() == 0 == overlay.difference(none, b).count() and overlay.areas(overlay.difference(a, none), "a").count() == 5
    assert vector.area_and_centroid(a).filter("poly_id = 1").first().area == 25


def test_copies_are_one_shape(spark):
    """Copies are cut once, and the result has them all: rings in other rows or none, too."""
    rows = [(i, [square(0, 0, 4)], "") for i in range(60)] + [(100 + i, [square(0, 0, 4), square(1, 1, 1)], "") for i in range(40)] + [(200, [square(0, 0, 4)], ""), (200, [square(1, 1, 1)], ""), (300, None, "")]
    a = spark.createDataFrame([(i, rings and [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings], k) for i, rings, k in rows], KIND)
    b = frame(spark, [(i, [square(2, 0, 4)], "") for i in range(50)])
    members, one = overlay.alike(a)
    shape = {x.poly_id: x.shape for x in members.collect()}
    assert shape == {i: 0 if i < 100 else 100 if i < 200 else i for i in shape} and len(shape) == 102
    assert sorted(x.poly_id for x in one.collect()) == [0, 100, 200, 200, 300]
    got = overlay.shared_areas(a, b, 3.0)
    assert got.count() == 101 * 50 == overlay.intersection(a, b, 3.0).select("a", "b").distinct().count()
    assert all(x.area == pytest.approx(8.0) for x in got.collect())
    less = {x.a: x.area for x in overlay.areas(overlay.difference(a, b, 3.0), "a").collect()}
    assert less == {i: pytest.approx(8.0 if i < 100 else 7.0) for i in shape if i < 300}
    met = relations.relate(a, b, 3.0)
    assert met.count() == 101 * 50 and met.filter("not (ii and ie and ei and bb)").isEmpty()
    assert relations.select_by_location(a, b, "overlaps", 3.0).count() == 102
    assert [x.poly_id for x in relations.select_by_location(a, b, "disjoint", 3.0).collect()] == [300]
