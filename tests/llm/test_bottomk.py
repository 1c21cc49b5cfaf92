"""Bottom-k near-duplicates against all pairs: common lines, hubs, groups of several blocks, and edge cases."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidecell.llm import bottomk, verify

SCHEMA = "doc_id long, text string, id long, root string, n int, key string"
SYLLABLES = "ka lo mi ne ru ta vo sha bri den fol gar".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))


def prose(r, n):
    return [word(r) for _ in range(n)]


def edited(r, words, share):
    out = list(words)
    for i in r.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = word(r)
    return out


def shingles(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        met = Counter(j for x in s for j in where[x] if j > i)
        for j, c in met.items():
            if 100 * c >= 80 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), ids.get(find(i)), r[0] == ids.get(find(i))) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def reported(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], SCHEMA).repartition(6)
    got = bottomk.report(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_mixed_corpus(spark):
    r = random.Random(11)
    phrase, rows = prose(r, 30), []
    for i in range(150):
        base = prose(r, r.randint(1, 260))
        rows.append((10 * i, " ".join(base + (phrase if i % 3 else []))))
        for k in range(r.choice([0, 0, 1, 3])):
            kind, share = r.randrange(4), r.uniform(0.0, 0.09)
            new = edited(r, base, share) if kind == 0 else base + prose(r, int(len(base) * 2 * share)) if kind == 1 else base[: len(base) - int(len(base) * 2 * share)] if kind == 2 else [w.upper() for w in base]
            rows.append((10 * i + k + 1, r.choice([" ", "  ", "\n", "\t\r\n"]).join(new)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "One Two"), (5004, "one  two"), (5005, "one"), (5006, "é x y z w"), (5007, "É x y z w")]
    rows += [(None, rows[3][1]), (None, "alone without an id here"), (None, None), (None, "twice without an id now"), (None, "twice without an id now"), (5008, "ab " * 50_000), (5009, " ".join(prose(r, 60_000)))]
    rows += [rows[5], rows[5], (7, rows[9][1]), (7, rows[20][1])]
    assert reported(spark, rows) == brute(rows)


def test_edges_of_the_similarity(spark):
    """Exactly 0.8 links, a little less does not: 80 of 100 shingles, and 79 of 100."""
    a = [f"w{i}" for i in range(93)]  # 90 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:83] + [f"x{i}" for i in range(10)])), (3, " ".join(f"v{i}" for i in range(92))), (4, " ".join([f"v{i}" for i in range(82)] + [f"y{i}" for i in range(11)]))]
    inter = [len(shingles(rows[i][1]) & shingles(rows[i + 1][1])) for i in (0, 2)]
    union = [len(shingles(rows[i][1]) | shingles(rows[i + 1][1])) for i in (0, 2)]
    assert (inter, union) == ([80, 79], [100, 100])
    got = {g[0]: g[2] for g in reported(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_large_groups(spark):
    """A phrase in more documents than a list may hold, and more near copies of one text than a task compares: each differs
    from the text by few words but from the other copies by too many; chains hang on some of them."""
    r = random.Random(4)
    common, base = prose(r, 25), prose(r, 160)
    rows = [(i, " ".join(prose(r, 30) + common)) for i in range(1300)]
    copies = [edited(r, base, 0.024) for _ in range(1200)]
    rows += [(9000, " ".join(base))] + [(10_000 + i, " ".join(c)) for i, c in enumerate(copies)]
    rows += [(20_000 + i, " ".join(edited(r, copies[i], 0.02))) for i in range(30)]
    assert reported(spark, rows) == brute(rows)


def test_parts():
    r = np.random.default_rng(1)
    for _ in range(200):
        universe = r.integers(0, 1 << 32, 400, dtype=np.uint32)
        a, b = (np.unique(universe[r.random(400) < r.choice([0.05, 0.5, 0.9])]) for _ in range(2))
        row = lambda x: np.concatenate([x[: bottomk.SKETCH], np.full(max(0, bottomk.SKETCH - len(x)), bottomk._PAD)]).astype(np.uint32)
        both = sorted(set(a.tolist()) | set(b.tolist()))[: bottomk.SKETCH]
        shared, of = bottomk.union_share(row(a), row(b)[None])
        assert (shared[0], of[0]) == (len(set(both) & set(a.tolist()) & set(b.tolist())), len(both))
        n = int(r.integers(1, 30))
        links = r.random((n, n)) < 0.1
        links |= links.T
        label = lambda edges: (lambda m: m)(_components(n, edges))
        found = verify.spanning(r.permutation(n), n, lambda i, others: links[i, others])
        assert label(found) == label(list(zip(*np.nonzero(links)))) and len(found) < n


def _components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_empty(spark):
    assert reported(spark, []) == []
    assert bottomk.report(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.col("kept")).collect()[0][0]
