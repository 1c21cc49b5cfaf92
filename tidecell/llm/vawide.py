"""Exact top-k inner products where components are too large for longs: the search of ``vafile`` on scaled floats.

The file's cells and bounds are those of the components over a power of two that brings all within 1; bounds give way by
what rounding can be off. Exact scores are sums of whole numbers of any size, floor(SCALE x) each, in tasks; a score ranks
by its digits, and saturates at the ends of long in the result only.

Edge cases are those of ``vafile``; the largest doubles are held exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vafile import CELLS, K, QUERY_BLOCK, SCALE, _LONG, bounds

#: Digits that a score, made positive by adding 10^_DIGITS, is written with: 2 x 317 for the largest product, and many terms.
_DIGITS = 660


def whole(x: float) -> int:
    """floor(SCALE x), exactly."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def _floats(column: pa.Array, dim: int, power: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return np.ldexp(out, -power)


def _cells(vectors: DataFrame, power: int) -> tuple[np.ndarray, np.ndarray]:
    rows = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()
    low, width = np.zeros(len(rows)), np.zeros(len(rows))
    for r in rows:
        a, b = math.ldexp(min(r["a"], 0.0), -power), math.ldexp(max(r["b"], 0.0), -power)
        low[r["i"]], width[r["i"]] = a, max((b - a) / CELLS, 2.0**-1000)
    return low, width


def approximate(vectors: DataFrame, low: np.ndarray, width: np.ndarray, power: int) -> DataFrame:
    """(row, vec_id, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.clip(np.floor((_floats(batch.column(2), len(low), power) - low) / width), 0, CELLS - 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in cells], pa.binary())], ["row", "vec_id", "cells"])

    return vectors.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, cells binary")


def _scores(pairs: DataFrame, pool: DataFrame, queries: DataFrame, power: int) -> DataFrame:
    """(query, query_id, vec_id, times, digits, score, least): digits rank the scores, least is the score on the bounds' scale,
    rounded down."""
    q = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("n").alias("m"))
    both = pairs.select("query", "row").join(pool, "row").join(F.broadcast(q), "query")  # one block of queries
    both = both.select("query", "query_id", "vec_id", (F.col("n") * F.col("m")).alias("times"), "q", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list[int]] = {}
            exact = lambda v: held.setdefault(tuple(v), [whole(x) for x in v])  # noqa: B023, E731
            sums = [sum(a * b for a, b in zip(exact(q), exact(v))) for q, v in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            digits = [f"{s + 10**_DIGITS:0{_DIGITS + 1}d}" for s in sums]
            score = [max(min(s, _LONG), -_LONG - 1) for s in sums]
            least = [math.nextafter(s / (SCALE * SCALE << 2 * power), -math.inf) for s in sums]
            columns = [*batch.columns[:4], pa.array(digits, pa.string()), pa.array(score, pa.int64()), pa.array(least, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["query", "query_id", "vec_id", "times", "digits", "score", "least"])

    return both.mapInArrow(run, "query long, query_id long, vec_id long, times long, digits string, score long, least double")


def search(vectors: DataFrame, queries: DataFrame, most: float, k: int = K) -> DataFrame:
    """vectors, queries (vec_id, v doubles), all within most -> (query_id, rank, vec_id, score): each query's k best other rows."""
    power = math.frexp(most)[1]
    equal = lambda rows: rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id())
    vectors, queries = materialize(equal(vectors), "va-exact"), materialize(equal(queries), "va-queries")
    same = Window.partitionBy("v").orderBy("vec_id")
    pool = materialize(vectors.withColumn("__n", F.row_number().over(same)).filter(f"__n <= {k + 1}").drop("__n"), "va-pool")
    low, width = _cells(vectors, power)
    reach, off = np.maximum(np.abs(low), np.abs(low + width * CELLS)), math.ldexp(1.0, -8 - power)
    file = materialize(approximate(pool, low, width, power), "va-file")
    blocks, found = math.ceil(queries.count() / QUERY_BLOCK), None
    per = lambda by, *order: Window.partitionBy(by).orderBy(*order)
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = block.collect()
        if not rows:
            continue
        q = _floats(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), len(low), power)
        # rounding of bounds and cells, and what rounding components down to whole numbers takes from a product
        loose = (np.abs(q) @ reach) * (len(low) + 16) * 2.0**-50 + (np.abs(q).sum(axis=1) + reach.sum() + len(low) * off) * off * 1.01 + 2.0**-1000
        near = materialize(bounds(file, np.array([r["row"] for r in rows]), np.array([r["vec_id"] for r in rows]), q, low, width, k, loose), "va-bounds")
        sure = near.withColumn("n", F.row_number().over(per("query", F.desc("lb")))).filter(f"n <= {k}").groupBy("query").agg(F.min("lb").alias("floor"))
        order = near.join(sure, "query").filter("ub >= floor").withColumn("n", F.row_number().over(per("query", F.desc("ub"), "vec_id")))
        order = materialize(order.select("query", "row", "ub", F.col("n").alias("nth")), "va-order")
        first = materialize(_scores(order.filter(f"nth <= {2 * k}"), pool, block, power), "va-first")
        kth = first.withColumn("n", F.row_number().over(per("query", F.desc("digits"), "vec_id"))).filter(f"n = {k}").select("query", F.col("least").alias("kth"))
        rest = _scores(order.filter(f"nth > {2 * k}").join(kth, "query").filter("ub >= kth"), pool, block, power)
        each = first.unionAll(rest).withColumn("__i", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
        ranked = each.withColumn("rank", F.row_number().over(per("query_id", F.desc("digits"), "vec_id"))).filter(f"rank <= {k}")
        part = ranked.select("query_id", "rank", "vec_id", "score")
        found = part if found is None else found.unionAll(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
