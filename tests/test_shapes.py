"""Relations between polygons, simplified outlines, hulls and poles against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidecell.operators import relations, shapes
from test_overlay import frame, square, star, within


def segments(rings):
    return [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]


def meet(s, t):
    def side(p, q, c):
        d = (q[0] - p[0]) * (c[1] - p[1]) - (q[1] - p[1]) * (c[0] - p[0])
        return 0 if abs(d) < 1e-9 else math.copysign(1, d)

    (a, b), (c, d) = s, t
    boxes = all(min(a[k], b[k]) <= max(c[k], d[k]) + 1e-9 and min(c[k], d[k]) <= max(a[k], b[k]) + 1e-9 for k in (0, 1))
    return boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def test_relations(spark):
    """Shapes in every relation, named one by one, and random ones by points in them and outlines that meet."""
    base = [square(0, 0, 10), square(2, 2, 3)]
    named = {
        "equal": [square(0, 0, 10)[::-1], square(2, 2, 3)], "inside": [square(6, 6, 2)], "inside at the edge": [square(6, 6, 4)], "around": [square(-1, -1, 12)], "filled": [square(0, 0, 10)],
        "in the hole": [square(3, 3, 1)], "fills the hole": [square(2, 2, 3)], "across": [square(8, 8, 5)], "beside": [square(10, 0, 4)], "at a corner": [square(10, 10, 2)], "apart": [square(20, 20, 1)], "crossing": [square(-5, 7, 30, 1)],
    }
    want = {
        "equal": (True, False, False, True), "inside": (True, True, False, False), "inside at the edge": (True, True, False, True), "around": (True, False, True, False), "filled": (True, False, True, True),
        "fills the hole": (False, True, True, True), "across": (True, True, True, True), "beside": (False, True, True, True), "at a corner": (False, True, True, True), "crossing": (True, True, True, True),
    }
    a, b = frame(spark, [(1, base, "")]), frame(spark, [(i, rings, n) for i, (n, rings) in enumerate(named.items())])
    names = list(named)
    got = {names[x.b]: (x.ii, x.ie, x.ei, x.bb) for x in relations.relate(a, b, 3.0).collect()}
    assert got == want
    told = lambda p: {names[x.poly_id] for x in relations.select_by_location(b, a, p, 3.0).collect()}
    assert told("within") == {"equal", "inside", "inside at the edge"} and told("contains") == {"equal", "around", "filled"}
    assert told("touches") == {"fills the hole", "beside", "at a corner"} and told("disjoint") == {"in the hole", "apart"}
    assert told("overlaps") == {"across", "crossing"} and told("equals") == {"equal"} and told("crosses") == set()
    assert told("intersects") == set(names) - {"in the hole", "apart"}
    r = random.Random(3)
    sa = [(i, [star(r, r.uniform(-8, 8), r.uniform(-8, 8), r.uniform(1, 5), r.randint(4, 9))], "") for i in range(12)]
    sb = [(i, [star(r, r.uniform(-8, 8), r.uniform(-8, 8), r.uniform(1, 5), r.randint(4, 9))], "") for i in range(12)]
    got = {(x.a, x.b): (x.ii, x.ie, x.ei, x.bb) for x in relations.relate(frame(spark, sa), frame(spark, sb), 2.0).collect()}
    for i, g, _ in sa:
        for j, h, _ in sb:
            bb = any(meet(s, t) for s in segments(g) for t in segments(h))
            ii = bb or within(h, *g[0][0]) or within(g, *h[0][0])
            assert (got.get((i, j), (False,))[0], got.get((i, j), (0, 0, 0, False))[3]) == (ii, bb)
            if ii and not bb:
                assert got[(i, j)][1:3] == ((False, True) if within(h, *g[0][0]) else (True, False))


def off(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def split(points, i, j, tolerance):
    inner = [(off(points[k], points[i], points[j % len(points)]), -k) for k in range(i + 1, j)]
    if not inner or max(inner)[0] <= tolerance:
        return []
    k = -max(inner)[1]
    return split(points, i, k, tolerance) + [k] + split(points, k, j, tolerance)


def test_simplified(spark):
    r = random.Random(7)
    rings = {}
    for i in range(6):
        n = r.choice([3, 4, 30, 400])
        rings[i] = [(math.cos(2 * math.pi * k / n) * (5 + r.uniform(0, 0.6)) + r.choice([0, 0.001]), math.sin(2 * math.pi * k / n) * 5) for k in range(n)]
    points = spark.createDataFrame([(i, 0, k, float(x), float(y)) for i, ring in rings.items() for k, (x, y) in enumerate(ring)], "poly_id long, ring int, seq int, x double, y double")
    for tolerance in (0.05, 0.4):
        got = {}
        for x in shapes.simplified(points, tolerance).collect():
            got.setdefault(x.poly_id, []).append(x.seq)
        for i, ring in rings.items():
            kept = sorted(got[i])
            assert len(kept) == len(set(kept))
            if len(ring) < 4:
                assert kept == list(range(len(ring)))
                continue
            mid = max(range(len(ring)), key=lambda k: ((ring[k][0] - ring[0][0]) ** 2 + (ring[k][1] - ring[0][1]) ** 2, -k))
            assert kept == sorted([0, mid, *split(ring, 0, mid, tolerance), *split(ring, mid, len(ring), tolerance)])
            pairs = list(zip(kept, [*kept[1:], len(ring)]))
            assert all(off(ring[k], ring[a], ring[b % len(ring)]) <= tolerance for a, b in pairs for k in range(a, b))
    back = shapes.polygons_of(points).collect()
    assert {x.poly_id: [(p["x"], p["y"]) for p in x.rings[0]] for x in back} == rings
    assert shapes.simplified(points.limit(0), 1.0).count() == 0


def test_hulls(spark):
    r = random.Random(5)
    rows = [(i, float(r.randrange(30)), float(r.randrange(30))) for i in range(4) for _ in range(200)] + [(9, 1.0, 1.0), (9, 2.0, 2.0), (9, 3.0, 3.0), (9, None, 1.0), (10, 5.0, 5.0), (10, 5.0, 5.0)]
    got = {}
    for x in shapes.hulls(spark.createDataFrame(rows, "poly_id long, x double, y double").repartition(7)).orderBy("seq").collect():
        got.setdefault(x.poly_id, []).append((x.x, x.y))
    assert got[9] == [(1.0, 1.0), (3.0, 3.0)] and got[10] == [(5.0, 5.0)]
    for i in range(4):
        points, hull = {(x, y) for k, x, y in rows if k == i}, got[i]
        assert set(hull) <= points
        for a, b, c in zip(hull, hull[1:] + hull[:1], hull[2:] + hull[:2]):
            assert (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0
            assert all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in points)


def test_poles(spark):
    r = random.Random(2)
    some = [(0, [square(0, 0, 4)], ""), (1, [square(0, 0, 10, 4)], ""), (2, [square(0, 0, 10), square(4, 4, 2)], ""), (3, [star(r, 20, 20, 6, 9)], ""), (4, [[(0, 0), (1, 0), (2, 0)]], "")]
    got = {x.poly_id: x for x in shapes.poles(frame(spark, some), 0.02).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert (got[0].x, got[0].y, got[0].distance) == pytest.approx((2, 2, 2), abs=0.05) and got[1].distance == pytest.approx(2, abs=0.02)
    for i, rings, _ in some[:4]:
        inside = [(x, y) for x in (r.uniform(-1, 27) for _ in range(60)) for y in (r.uniform(-1, 27) for _ in range(60)) if within(rings, x, y)]
        assert max(min(off(p, a, b) for a, b in segments(rings)) for p in inside) <= got[i].distance + 0.02
        assert within(rings, got[i].x, got[i].y) and min(off((got[i].x, got[i].y), a, b) for a, b in segments(rings)) == pytest.approx(got[i].distance)


def test_reference_systems(spark):
    from tidecell.sources import tables

    g = spark.createDataFrame([("a", None), ("b", 3857)], "grid_id string, crs_epsg int")
    assert {x.crs_epsg for x in tables.with_crs(g, 3857).collect()} == {3857} == {x.crs_epsg for x in tables.with_crs(g, 3857, replace=True).collect()}
    assert {x.crs_epsg for x in tables.with_crs(g, 2953, replace=True).collect()} == {2953}
    with pytest.raises(Exception, match="another reference system"):
        tables.with_crs(g, 2953).collect()
