"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one minimum per node and one join; hubs are combined before the shuffle, and the join's sides are tables,
so Spark can split a hub's rows. Edges are cut to the shared folder after each step, and what a step no longer needs is
deleted. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(pairs: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, root): every node of a link with the smallest node that it reaches."""
    edges = materialize(pairs.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "cc")
    before, now = None, _state(edges)
    while now[0] and now != before:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-min")
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        larger = materialize(large.distinct(), "cc-large")
        discard(edges, least)
        edges = larger
        least = materialize(edges.groupBy("hi").agg(F.min("lo").alias("m")), "cc-min")
        small = edges.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        smaller = materialize(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "cc-small")
        discard(edges, least)
        edges = smaller
        before, now = now, _state(edges)
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(roots)
