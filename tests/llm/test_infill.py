"""Fill-in-middle against a version in plain Python, the way back, and on nulls, empty, long and repeated rows."""

import hashlib
import random
import re

import pytest

from tidecell.llm import infill

SCHEMA = "doc_id long, text string, n string, batch string"


def brute(doc_id, text, seed=1, rate=90, spm=20, marks=("<P>", "<S>", "<M>")):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    if not t or any(x in t for x in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    return (n, "spm", len(pre), len(mid), s + suf + p + pre + m + mid) if h4 % 100 < spm else (n, "psm", len(pre), len(mid), p + pre + s + suf + m + mid)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    letters = ["a", "Zz", " ", "\n", "\r", "\t", "\0", "é", "ß", "中", "\U0001f600", "é", "‍", "<", ">", "<P", "P>", "S>", "0", "'", '"', "\\", "İ", "﻿"]
    out = [(i, "".join(r.choice(letters) for _ in range(r.randint(0, 60))), "x", "y") for i in range(400)]
    out += [(1000 + i, f"one {m} two", "x", "y") for i, m in enumerate(("<P>", "<S>", "<M>", "<p>"))]
    out += [(2000, None, None, None), (2001, "", None, None), (None, "no id here", None, None), (None, None, None, None), (-5, "negative id", None, None)]
    out += [(3000, "word, " * 400_000, None, None), (3001, "x" * 3_000_000, None, None)]
    return out + [out[7], out[7]]


def test_transform(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cols = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted((tuple(r[c] for c in cols) for r in infill.transform(df).collect()), key=repr)
    assert got == sorted(((d, *brute(d, t)) for d, t, *_ in rows), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_way_back_and_digests(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    back = sorted(map(tuple, infill.restore(infill.transform(df)).collect()), key=repr)
    assert back == sorted(((d, t or "") for d, t, *_ in rows), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.report(df).collect()), key=repr)
    assert got == sorted(((d, sha(brute(d, t)[-1]), sha(t or "")) for d, t, *_ in rows), key=repr)


def test_other_parameters(spark):
    marks = ("[it's]", "{s}", "|m|")
    rows = [(i, f"text number {i} of some, with {{s}}" if i % 9 == 0 else f"text number {i} <P>", "", "") for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.form, r.output) for r in infill.transform(df, 7, 60, 50, marks).collect()}
    assert got == {d: (brute(d, t, 7, 60, 50, marks)[1], brute(d, t, 7, 60, 50, marks)[-1]) for d, t, *_ in rows}
    assert {r.text for r in infill.restore(infill.transform(df, 7, 60, 50, marks), marks).collect()} == {t for _, t, *_ in rows}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert infill.report(df).collect() == [] and infill.transform(df).columns[-1] == "output"
