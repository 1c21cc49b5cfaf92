"""The manifest against a plain tree, sources of several blocks, tampering, and nulls, lone leaves and repeated rows."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidecell.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, r int, n string, root string, block int, at int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(leaves):
    """(root, the siblings (left, right) of each leaf at each level)."""
    at, sides = list(leaves), [[] for _ in leaves]
    width = 1
    while len(at) > 1:
        for i, s in enumerate(sides):
            k = i // width
            b = k // 16 * 16
            s.append(("".join(at[b:k]), "".join(at[k + 1 : b + 16])))
        at, width = [h("".join(at[i : i + 16])) for i in range(0, len(at), 16)], width * 16
    return at[0], sides


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in names}
    root, above = tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        leaves, sub, sides = trees[s]
        for (_, _, leaf, row), side in zip(leaves, sides):
            path = side + up
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf_of(row, row[4].translate(LOWER) if changed and row[4] is not None else row[4])
            for left, right in path:
                node = h(left + node + right)
            out.append((row[0], leaf, sub, root, h("".join(a + b for a, b in path)), node, node == root))
    return out


def reported(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "n", "root", 0, 0) for r in rows], SCHEMA).repartition(5)
    got = merkle.report(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_paths_of_a_block():
    for n in (1, 2, 15, 16, 17, 33, 256, 257, 272, 600, 4096):
        leaves = [h(str(i)) for i in range(n)]
        root, sides = tree(leaves)
        assert list(merkle.paths(leaves, merkle.levels(n))) == sides
        assert merkle.Subtree(merkle.levels(n)).over(leaves).nodes == [root]


def test_manifest(spark):
    r = random.Random(3)
    rows = [(r.randint(-50, 3000), r.choice([None, "", "a", "é", "\U0001f600", "src1", "Z", *map(str, range(20))]), r.choice([None, "en", ""]), r.choice([None, 0, 17]), r.choice([None, "", "Some Text", "lower", "é" * 5, "A" * 200_000])) for _ in range(900)]
    rows += [(None, "a", None, None, "No Id"), (None, "a", None, None, None), (None, None, None, None, None), (7, "alone", "en", 1, "A lone leaf")]
    rows += [rows[0], rows[0], rows[-1 - 2]]
    assert reported(spark, rows) == sorted(brute(rows), key=repr)


def test_sources_of_several_blocks(spark):
    """Two tables of nodes, a last block of one leaf, and one source beside a hot one."""
    rows = [(i, "hot", "en", i % 3, f"Row {i}") for i in range(2 * merkle.BLOCK + 1)] + [(i, "cold", "de", 1, "Same") for i in range(20)]
    got = reported(spark, rows)
    assert got == sorted(brute(rows), key=repr) and {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("rows", [[(5, None, None, None, None)], [(5, "s", "en", 1, "One Row"), (5, "s", "en", 1, "One Row")], []])
def test_small(spark, rows):
    assert reported(spark, rows) == sorted(brute(rows) if rows else [], key=repr)


def test_one_source_is_the_root(spark):
    df = spark.createDataFrame([(i, "s", None, None, "x", *[None] * 6) for i in range(3)], SCHEMA)
    got = merkle.manifest(df).select("leaf", "subroot", "root", merkle.fold(F.col("leaf"), F.col("proof")).alias("folded"), F.size("proof").alias("steps")).collect()
    assert {(g.subroot == g.root, g.folded == g.root, g.steps) for g in got} == {(True, True, 1)}
