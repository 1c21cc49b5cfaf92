"""Exact top-k inner products with a vector-approximation file.

The file holds one byte per component: its cell among CELLS equal cells of the component's range. A scan of the file
bounds each candidate's score from below and above; a candidate whose upper bound is under the k-th best lower bound
can't be among the k best. Exact vectors are then read in the order of their bounds: first those of the 2 k best, and
of the rest only those whose bound still reaches the k-th exact score, which makes the result certain.

Of candidates whose vectors are equal only the k + 1 smallest ids can ever be in a result; Spark applies that limit
before the shuffle, so a vector that many rows share costs no more than any other. Queries go in blocks of QUERY_BLOCK,
each of which scans the file once; that block is all that is broadcast.

Edge cases: a null vector, one with a null or non-finite component, and a null id take no part; a shorter vector is
filled up with zeros; where components reach 2^50 after scaling, or more, the search is the one of ``vawide``, whose scores
are whole numbers of any size, which rank as they are and saturate at the ends of long in the result; rows that repeat an id are excluded together when that id is the query; equal rows are searched
as one, and ranked as often as they stand there, times the rows of the query, as a join of the rows would; ties go to the
smaller id; fewer than k candidates are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, CELLS, SCALE, QUERY_BLOCK, QUERY_EVERY, _SCAN = 5, 64, 256, 2048, 50, 2048
#: From here on, after scaling, components are no longer held as longs.
MOST, _LONG = 1 << 50, (1 << 63) - 1


def numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the components as doubles, of rows that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.filter(ok).select(F.col("vec_id").cast("long"), x.alias("v"))


def integers(rows: DataFrame) -> DataFrame:
    """(vec_id, v): v the components times SCALE, rounded down; all within +-MOST."""
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _cells(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each component's least value and the width of its cells."""
    rows = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()
    low, width = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
    for r in rows:
        low[r["i"]], width[r["i"]] = min(r["a"], 0), -(-(max(r["b"], 0) - min(r["a"], 0) + 1) // CELLS)
    return low, width


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def approximate(vectors: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """(row, vec_id, cells): the approximation file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = ((_matrix(batch.column(2), len(low)) - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in cells], pa.binary())], ["row", "vec_id", "cells"])

    return vectors.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, cells binary")


def bounds(file: DataFrame, keys: np.ndarray, ids: np.ndarray, queries: np.ndarray, low: np.ndarray, width: np.ndarray, k: int, loose: np.ndarray | None = None) -> DataFrame:
    """(query, row, vec_id, lb, ub) of all that one task can't rule out by what it has scanned. loose: what each query's
    bounds give way by where vectors aren't whole numbers."""
    plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
    reach = np.maximum(np.abs(low), np.abs(low + width * CELLS)).astype(np.float64)
    sums = np.abs(queries).astype(np.float64) @ reach
    # sums below 2^53 are exact; beyond, the bounds give way by what float sums can be off
    slack = (np.where(sums < 2.0**53, 0.0, sums * (len(low) + 2) * 2.0**-52) if loose is None else loose)[:, None]
    reaches = width - 1 if loose is None else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), k), -np.inf)
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            place, every = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(every), len(low))
            for i in range(0, len(every), _SCAN):
                vec, floor = every[i : i + _SCAN], (low + packed[i : i + _SCAN].astype(np.int64) * width).astype(np.float64)
                ceil = floor + reaches
                lb, ub = plus @ floor.T + minus @ ceil.T - slack, plus @ ceil.T + minus @ floor.T + slack
                own = ids[:, None] == vec[None, :]
                lb[own] = ub[own] = -np.inf
                best = -np.partition(-np.concatenate([best, lb], axis=1), k - 1, axis=1)[:, :k]
                q, c = np.nonzero((ub >= best.min(axis=1)[:, None]) & ~own)
                held.append((q, place[i : i + _SCAN][c], vec[c], lb[q, c], ub[q, c]))
            if sum(len(h[0]) for h in held) > 1_000_000:  # what the later batches have ruled out goes
                held = [_still(held, best)]
        if held:
            q, row, vec, lb, ub = _still(held, best)
            for i in range(0, len(q), 100_000):
                s = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[q[s]]), pa.array(row[s]), pa.array(vec[s]), pa.array(lb[s]), pa.array(ub[s])], ["query", "row", "vec_id", "lb", "ub"])

    return file.mapInArrow(run, "query long, row long, vec_id long, lb double, ub double")


def _still(held: list, best: np.ndarray) -> tuple:
    q, row, vec, lb, ub = (np.concatenate(x) for x in zip(*held))
    ok = ub >= best.min(axis=1)[q]
    return q[ok], row[ok], vec[ok], lb[ok], ub[ok]


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """vectors, queries (vec_id, v) -> (query_id, rank, vec_id, score): each query's k best other rows."""
    equal = lambda rows: rows.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id())
    vectors, queries = materialize(equal(vectors), "va-exact"), materialize(equal(queries), "va-queries")
    same = Window.partitionBy("v").orderBy("vec_id")
    pool = materialize(vectors.withColumn("__n", F.row_number().over(same)).filter(f"__n <= {k + 1}").drop("__n"), "va-pool")
    low, width = _cells(vectors)
    exact = "long" if float(np.square(np.maximum(np.abs(low), np.abs(low + width * CELLS)).astype(float)).sum()) < 2.0**62 else "decimal(38,0)"
    file = materialize(approximate(pool, low, width), "va-file")
    blocks = math.ceil(queries.count() / QUERY_BLOCK)
    found = None
    for b in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        rows = block.collect()
        if not rows:
            continue
        q = _matrix(pa.array([r["v"] for r in rows], pa.list_(pa.int64())), len(low))
        near = materialize(bounds(file, np.array([r["row"] for r in rows]), np.array([r["vec_id"] for r in rows]), q, low, width, k), "va-bounds")
        part = _exact(near, pool, block, k, exact)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _exact(near: DataFrame, pool: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """kind: a type that holds every product and sum."""

    # two factors of 51 bits and a sign make 31 digits, and decimal(19,0) holds each: no sum of up to 10^7 products is rounded
    wide = lambda x: x if kind == "long" else x.cast("decimal(19,0)")
    product = lambda a, b: F.coalesce((wide(a) * wide(b)).cast(kind), F.lit(0).cast(kind))

    def score(pairs: DataFrame) -> DataFrame:
        q = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("n").alias("m"))
        both = pairs.select("query", "row").join(pool, "row").join(F.broadcast(q), "query")  # one block of queries
        return both.select("query", "query_id", "vec_id", (F.col("n") * F.col("m")).alias("times"), F.aggregate(F.zip_with("q", "v", product), F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind)).alias("score"))

    per = lambda by, *order: Window.partitionBy(by).orderBy(*order)
    sure = near.withColumn("n", F.row_number().over(per("query", F.desc("lb")))).filter(f"n <= {k}").groupBy("query").agg(F.min("lb").alias("least"))
    order = near.join(sure, "query").filter("ub >= least").withColumn("n", F.row_number().over(per("query", F.desc("ub"), "vec_id")))
    order = materialize(order.select("query", "row", "ub", F.col("n").alias("nth")), "va-order")
    first = materialize(score(order.filter(f"nth <= {2 * k}")), "va-first")
    kth = first.withColumn("n", F.row_number().over(per("query", F.desc("score"), "vec_id"))).filter(f"n = {k}").select("query", F.col("score").alias("kth"))
    rest = score(order.filter(f"nth > {2 * k}").join(kth, "query").filter("ub >= kth"))
    each = first.unionAll(rest).withColumn("__i", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int"))))
    ranked = each.withColumn("rank", F.row_number().over(per("query_id", F.desc("score"), "vec_id"))).filter(f"rank <= {k}")
    value = F.col("score") if kind == "long" else F.greatest(F.least("score", F.lit(_LONG)), F.lit(-_LONG - 1)).cast("long")
    return ranked.select("query_id", "rank", "vec_id", value.alias("score"))


def report(embeddings: DataFrame) -> DataFrame:
    from . import vawide

    rows = numbers(embeddings)
    most = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    wide = most * SCALE >= MOST
    vectors = rows if wide else integers(rows)
    queries = vectors.filter(f"vec_id % {QUERY_EVERY} = 0")
    return vawide.search(vectors, queries, most) if wide else search(vectors, queries)
