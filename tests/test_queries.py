"""Every registered query of the grid engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tidecell.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ""
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    """Without the subpackage of training-data operators the rest still imports."""
    import __spark_entry__

    assert "inundation_metrics" in __spark_entry__.queries() and __spark_entry__.entry(spark).count() == 1


def test_headline_values(spark):
    got = catalog.queries()["inundation_metrics"](spark, SF).first()
    assert (got.TP, got.TN, got.FP, got.FN) == (179, 601, 356, 364)
