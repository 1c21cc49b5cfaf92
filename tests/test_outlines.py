"""Outlines with holes against a plain tracer, with tiles of a few cells, and eight-connected areas."""

import random

import numpy as np
import pytest

from tidecell.operators import neighbourhood, outlines

TURNS = {(0, 1): (-1, 0), (-1, 0): (0, -1), (0, -1): (1, 0), (1, 0): (0, 1)}  # to the left, y down


def traced(cells, connect):
    """label -> its rings of corners (x, y), each from its least corner on; edges run with the area on the left."""
    follow = {}
    for (r, c), v in cells.items():
        for (i, j), (a, b) in {(0, 1): ((r + 1, c + 1), (r, c + 1)), (-1, 0): ((r, c + 1), (r, c)), (0, -1): ((r, c), (r + 1, c)), (1, 0): ((r + 1, c), (r + 1, c + 1))}.items():
            if cells.get((r + i, c + j)) != v:
                follow.setdefault((v, a), []).append(b)
    rings = {}
    while follow:
        v, start = next(iter(follow))
        first = follow[(v, start)][0]
        ring, at, to = [], start, first
        while True:
            follow[(v, at)].remove(to)
            if not follow[(v, at)]:
                del follow[(v, at)]
            ahead = (to[0] - at[0], to[1] - at[1])
            options = follow.get((v, to), []) + ([first] if to == start and first not in follow.get((v, to), []) else [])
            left = TURNS[ahead]
            right = (-left[0], -left[1])
            order = [right, ahead, left] if connect == 8 else [left, ahead, right]
            nxt = next((to[0] + d[0], to[1] + d[1]) for d in order if (to[0] + d[0], to[1] + d[1]) in options)
            if (nxt[0] - to[0], nxt[1] - to[1]) != ahead:
                ring.append((to[1], -to[0]))
            if to == start and nxt == first:
                break
            at, to = to, nxt
        k = ring.index(min(ring))
        rings.setdefault(v, []).append(tuple(ring[k:] + ring[:k]))
    return {v: sorted(r) for v, r in rings.items()}


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def frame(spark, cells):
    return spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()], "row int, col int, label long")


def turned(ring):
    ring = [(p["x"], p["y"]) for p in ring]
    # a ring may pass its least corner twice: take the lesser of the ways to begin there
    return min(tuple(ring[k:] + ring[:k]) for k, p in enumerate(ring) if p == min(ring))


def least(ring):
    return min(tuple(ring[k:] + ring[:k]) for k, p in enumerate(ring) if p == min(ring))


@pytest.mark.parametrize("connect,tile,seed", [(8, 3, 0), (8, 5, 1), (4, 3, 2), (8, 64, 3), (4, 64, 4)])
def test_outlines(spark, connect, tile, seed):
    r = random.Random(seed)
    cells = {(i, j): r.choice([1, 1, 1, 2, 7]) for i in range(14) for j in range(17) if r.random() < 0.75}
    lines = outlines.outlines(frame(spark, cells), connect, tile)
    got = {x.poly_id: x.rings for x in outlines.polygons(lines).collect()}
    want = traced(cells, connect)
    assert {v: sorted(turned(q) for q in rings) for v, rings in got.items()} == {v: sorted(map(least, rings)) for v, rings in want.items()}
    sums = {x.poly_id: (x.area, x.perimeter, x.corners, x.holes) for x in outlines.summary(lines).collect()}
    edges = lambda ring: sum(abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in zip(ring, ring[1:] + ring[:1]))
    assert sums == {v: (sum(map(area, rings)), sum(map(edges, rings)), sum(map(len, rings)), sum(area(q) < 0 for q in rings)) for v, rings in want.items()}
    assert {v: s[0] for v, s in sums.items()} == {v: sum(x == v for x in cells.values()) for v in (1, 2, 7)}


def test_long_ring_over_many_tiles(spark):
    """A spiral of one cell's width, closed within tiles and over them."""
    n, cells, r, c, d, k = 41, set(), 0, 0, (0, 1), 0
    while k < 4:
        cells.add((r, c))
        a = (r + d[0], c + d[1])
        b = (r + 2 * d[0], c + 2 * d[1])
        if not (0 <= a[0] < n and 0 <= a[1] < n) or b in cells:
            d, k = (d[1], -d[0]), k + 1
        else:
            r, c, k = *a, 0
    cells = {p: 5 for p in cells}
    lines = outlines.outlines(frame(spark, cells), 8, 4)
    assert {v: sorted(turned(q) for q in x) for v, x in {x.poly_id: x.rings for x in outlines.polygons(lines).collect()}.items()} == {v: sorted(map(least, q)) for v, q in traced(cells, 8).items()}
    assert lines.groupBy("ring").count().agg({"count": "max"}).first()[0] > 100


def test_eight_connected_areas(spark, monkeypatch):
    r = random.Random(6)
    cells = {(i, j): r.choice([None, 1.0, 2.0]) for i in range(23) for j in range(19)}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in cells.items()], "row int, col int, value double")
    monkeypatch.setattr(neighbourhood, "TILE", 5)
    for by_value in (False, True):
        got = {(x.row, x.col): x.label for x in neighbourhood.clumps(df, 19, by_value, 8).collect()}
        label = {p: p[0] * 19 + p[1] for p, v in cells.items() if v is not None}
        while True:
            new = {p: min(label[q] for i in (-1, 0, 1) for j in (-1, 0, 1) if (q := (p[0] + i, p[1] + j)) in label and (not by_value or cells[q] == cells[p])) for p in label}
            if new == label:
                break
            label = new
        assert got == label
    shell = outlines.summary(outlines.outlines(neighbourhood.clumps(df, 19, False, 8), 8, 6))
    rings = outlines.outlines(neighbourhood.clumps(df, 19, False, 8), 8, 6).select("poly_id", "ring", "hole").distinct()
    assert rings.filter("not hole").count() == shell.count()  # one shell each


def test_edges_of_outlines(spark):
    assert outlines.polygons(outlines.outlines(frame(spark, {(0, 0): None}))).count() == 0
    many = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 0, 1), ("b", 0, 0, 1), ("b", 0, 1, 1), ("b", 5, 5, None)], "grid_id string, row int, col int, label long")
    got = {(x.grid_id, x.poly_id): (x.area, x.corners) for x in outlines.summary(outlines.outlines(many, 8, 1)).collect()}
    assert got == {("a", 1): (1.0, 4), ("b", 1): (2.0, 4)}


def test_ranks():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 50):
        for _ in range(20):
            p = r.permutation(n)
            succ = np.where(r.random(n) < 0.3, -1, p)
            head, rank = outlines._chained(succ)
            for i in range(n):
                at, steps = head[i], 0
                while at != i:
                    at, steps = succ[at], steps + 1
                assert steps == rank[i]
