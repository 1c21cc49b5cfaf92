"""Order statistics of groups against numpy, and regressions against the normal equations and a plain Newton search."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecell.operators import ranks, regression


def test_order_statistics(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "b", "b", "c", None]), r.choice([float(r.randrange(9)), r.uniform(0, 5), None, float("nan")])) for _ in range(3000)]
    rows += [("hot", float(r.randrange(700))) for _ in range(4000)] + [("none", None), ("one", 4.0)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    got = {x.g: x for x in ranks.order_statistics(df, ["g"], F.col("value")).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, x in got.items():
        v = np.array([b for a, b in rows if a == g and b is not None and b == b])
        assert x["count"] == len(v) and x.unique == len(set(v))
        if not len(v):
            assert (x.q1, x.median, x.iqr, x.minority) == (None,) * 4
            continue
        q = np.quantile(v, [0.25, 0.5, 0.75])
        assert (x.q1, x.median, x.q3, x.iqr) == pytest.approx((*q, q[2] - q[0]))
        n = Counter(v.tolist())
        assert x.minority == min(n, key=lambda k: (n[k], k)) and x.majority == min(n, key=lambda k: (-n[k], k))
    some = {(x.g, x.share): x.value for x in ranks.quantiles_by(df, ["g"], F.col("value"), [0.0, 0.1, 1.0]).collect()}
    hot = np.array([b for a, b in rows if a == "hot"])
    assert [some[("hot", s)] for s in (0.0, 0.1, 1.0)] == pytest.approx(list(np.quantile(hot, [0, 0.1, 1])))
    whole = ranks.order_statistics(df, [], F.col("value")).first()
    assert whole.median == pytest.approx(np.median([b for _, b in rows if b is not None and b == b]))
    assert ranks.order_statistics(df.limit(0), ["g"], F.col("value")).count() == 0


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(2)
    n = 900
    x, z, k = r.normal(1e6, 3, n), r.normal(0, 1, n), r.choice(["p", "q", "s"], n)
    y = 2.5 * (x - 1e6) - 1.5 * z + np.select([k == "q", k == "s"], [3.0, -2.0], 0.0) + r.normal(0, 0.7, n)
    score = np.column_stack([np.zeros(n), 0.8 * z - 0.3, -0.6 * z + 0.2 * (x - 1e6)])
    label = np.array(["one", "three", "two"])[(score + r.gumbel(size=score.shape)).argmax(axis=1)]
    rows = [(float(a), float(b), str(c), float(d), str(e)) for a, b, c, d, e in zip(x, z, k, y, label)]
    df = spark.createDataFrame([*rows, (None, 1.0, "p", 1.0, "one"), (1.0, float("nan"), "p", 1.0, "one"), (1.0, 1.0, None, 1.0, "one"), (1e6, 1.0, "p", None, None)], "x double, z double, k string, y double, label string")
    return df, rows


def test_least_squares(spark, table):
    df, rows = table
    x, z, k, y, _ = (np.array(c) for c in zip(*rows))
    fit = regression.least_squares(df, "y", ["x", "z"], ["k"])
    a = np.column_stack([x - 1e6, z, k == "q", k == "s", np.ones(len(x))]).astype(float)
    want, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
    want[-1] -= 1e6 * want[0]
    assert fit.names == ["x", "z", "k[q]", "k[s]", "intercept"] and fit.n == len(rows) and fit.dof == len(rows) - 5
    assert fit.coefs == pytest.approx(want, rel=1e-6)
    cov = rss[0] / fit.dof * np.linalg.inv(a.T @ a)
    assert np.sqrt(np.diag(fit.cov))[:4] == pytest.approx(np.sqrt(np.diag(cov))[:4], rel=1e-6)
    assert fit.r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    t = {r.name: r for r in fit.table(spark).collect()}
    assert t["z"].low < -1.5 < t["z"].high and t["k[q]"].p < 1e-6
    plain = regression.least_squares(df, "y", ["z"], intercept=False)
    assert plain.coefs[0] == pytest.approx((z * y).sum() / (z * z).sum(), abs=0.05)
    with pytest.raises(ValueError, match="determined"):
        regression.least_squares(df.withColumn("w", 2 * F.col("z") + 1), "y", ["z", "w"])
    with pytest.raises(ValueError, match="rows for"):
        regression.least_squares(df.limit(2), "y", ["x", "z"])


def test_multinomial(spark, table):
    df, rows = table
    x, z, _, _, label = (np.array(c) for c in zip(*rows))
    both = df.filter("k is not null and y is not null").withColumn("x", F.col("x") - 1e6)
    fit = regression.multinomial(both, "label", ["x", "z"])
    a = np.column_stack([x - 1e6, z, np.ones(len(x))])
    y = np.column_stack([label == v for v in ("three", "two")]).astype(float)
    beta = np.zeros((2, 3))
    for _ in range(30):
        e = np.exp(a @ beta.T)
        p = e / (1 + e.sum(axis=1, keepdims=True))
        info = np.block([[(a * (p[:, [c]] * ((c == d) - p[:, [d]]))).T @ a for d in range(2)] for c in range(2)])
        beta = beta + np.linalg.solve(info, ((y - p).T @ a).ravel()).reshape(2, 3)
    assert fit.names == [f"{v}:{c}" for v in ("three", "two") for c in ("x", "z", "intercept")]
    assert fit.coefs == pytest.approx(beta.ravel(), rel=1e-5, abs=1e-7) and fit.n == len(rows)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-4)
    t = {r.name: r for r in fit.table(spark).collect()}
    assert t["three:z"].low < 0.8 < t["three:z"].high and t["two:z"].p < 1e-3
    with pytest.raises(ValueError, match="fewer than two"):
        regression.multinomial(both.filter("label = 'one'"), "label", ["z"])
