"""Filled and breached terrains against one flood and one tree over the whole grid, with tiles of a few cells."""

import heapq
import random

import pytest

from tidecell.functions import stage
from tidecell.operators import drainage

AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def near(z, p):
    return [q for i, j in AROUND if (q := (p[0] + i, p[1] + j)) in z]


def flooded(z):
    """Levels by a flood from the outlets."""
    level = {p: v for p, v in z.items() if len(near(z, p)) < 8}
    heap = [(v, p) for p, v in level.items()]
    heapq.heapify(heap)
    while heap:
        v, p = heapq.heappop(heap)
        if v > level[p]:
            continue
        for q in near(z, p):
            w = max(v, z[q])
            if w < level.get(q, float("inf")):
                level[q] = w
                heapq.heappush(heap, (w, q))
    return level


def brute_breach(z):
    """Least values over the tree of all cells, by Kruskal."""
    key = lambda p: (z[p], p)
    edges = [(*key(p), (-1, -1), p, None) for p in z if len(near(z, p)) < 8]
    edges += [(*key(max(p, q, key=key)), min(p, q, key=key), p, q) for p in z for q in near(z, p) if p < q]
    root = {p: p for p in [*z, None]}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    tree = {p: [] for p in root}
    for *_, p, q in sorted(edges, key=lambda e: e[:3]):
        a, b = find(p), find(q)
        if a != b:
            root[a] = b
            tree[p].append(q), tree[q].append(p)
    order, up = [None], {}
    for x in order:
        for y in tree[x]:
            if y != up.get(x):
                up[y] = x
                order.append(y)
    out = dict(z)
    for p in reversed(order[1:]):
        if up[p] is not None:
            out[up[p]] = min(out[up[p]], out[p])
    return out


def frame(spark, z, more=()):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in z.items()] + [(r, c, None) for r, c in more], "row int, col int, value double")


def values(df):
    rows = df.collect()
    out = {(x.row, x.col): x.value for x in rows}
    assert len(rows) == len(out)
    return out


def drains(z):
    """Whether every cell has a way to an outlet that never rises."""
    done = {p for p in z if len(near(z, p)) < 8}
    todo = list(done)
    while todo:
        p = todo.pop()
        for q in near(z, p):
            if q not in done and z[q] >= z[p]:
                done.add(q)
                todo.append(q)
    return len(done) == len(z)


@pytest.mark.parametrize("tile,seed,levels", [(3, 0, 1000), (4, 1, 4), (5, 2, 30), (2, 3, 3), (64, 4, 20)])
def test_terrain(spark, tile, seed, levels):
    r = random.Random(seed)
    z = {(i, j): float(r.randrange(levels)) for i in range(17) for j in range(21) if r.random() < 0.97}
    gone = [(i, j) for i in range(17) for j in range(21) if (i, j) not in z][::2]
    df = frame(spark, z, gone)
    blank = {p: None for p in gone}
    assert values(drainage.filled(df, tile)) == flooded(z) | blank
    low = values(drainage.breached(df, tile))
    assert low == brute_breach(z) | blank
    assert drains({p: v for p, v in low.items() if v is not None}) and all(low[p] <= z[p] for p in z)


def test_bowl_over_many_tiles(spark):
    """One basin in the middle of a dome, and a winding valley that ends inside."""
    z = {(i, j): 100.0 - abs(i - 15) - abs(j - 15) for i in range(31) for j in range(31)}
    for i in range(8, 23):
        for j in range(8, 23):
            z[(i, j)] = float(abs(i - 15) + abs(j - 15))
    df = frame(spark, z)
    low = values(drainage.breached(df, 4))
    assert low == brute_breach(z) and drains(low) and not drains(z)
    assert 0 < sum(low[p] < z[p] for p in z) < 30  # one channel
    assert values(drainage.filled(df, 4)) == flooded(z)


def test_edges(spark):
    assert drainage.breached(frame(spark, {})).count() == 0
    assert values(drainage.breached(frame(spark, {(300, 7): 5.0}, [(0, 0)]))) == {(300, 7): 5.0, (0, 0): None}
    z = {(i, j): 9.0 - (i == 2 and j == 2) * 5 for i in range(5) for j in range(5)}
    both = frame(spark, z).selectExpr("'a' as grid_id", "*").unionByName(frame(spark, {p: v + 1 for p, v in z.items() if p[0] < 4}).selectExpr("'b' as grid_id", "*"))
    got = {(x.grid_id, x.row, x.col): x.value for x in drainage.breached(both, 2).collect()}
    want = {("a", *p): v for p, v in brute_breach(z).items()} | {("b", *p): v for p, v in brute_breach({p: v + 1 for p, v in z.items() if p[0] < 4}).items()}
    assert got == want


def test_groups_of_a_long_narrow_grid_do_not_grow(spark, monkeypatch):
    """Cells at the grid's own edge join nothing beyond it, so a region hands on no more of them the longer it is."""
    most = {}

    def noted(df, name):
        back = stage.materialize(df, name)
        if name == "flow-up":
            most[n] = max(most.get(n, 0), *(x["count"] for x in back.groupBy("rr", "rc").count().collect()))
        return back

    monkeypatch.setattr(drainage, "materialize", noted)
    r = random.Random(8)
    for n in (32, 128):
        z = {(i, j): float(r.randrange(1000)) for i in range(n) for j in range(3)}
        assert values(drainage.filled(frame(spark, z), 4)) == flooded(z)
    assert most[128] <= most[32] + 4
