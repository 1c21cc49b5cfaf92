"""The driver's tables seen as grids: orders as terrain, its blocks as a coarse water surface, customers as marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecell.operators import resample

K, WIDTH = 5, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("row"), (F.col("o_orderkey") % WIDTH).cast("int").alias("col"), (F.col("o_totalprice").cast("double") / 1000).alias("value"))


def wse2(terrain: DataFrame, k: int = K, a: int = 7, b: int = 3) -> DataFrame:
    """Block means raised by 50, wet in six of ten blocks of a pattern; a, b shift the pattern."""
    blocks = resample.block_reduce(terrain, k)
    return blocks.select("row", "col", F.when((F.col("row") * a + F.col("col") * b) % 10 < 6, F.col("value") + 50).alias("value"))


def wse1(terrain: DataFrame, k: int = K, a: int = 7, b: int = 3) -> DataFrame:
    """The nearest coarse level where it tops the terrain."""
    near = resample.nearest_onto(terrain, wse2(terrain, k, a, b), k)
    return terrain.select("row", "col", F.col("value").alias("d")).join(near, ["row", "col"]).select("row", "col", F.when(F.col("value") > F.col("d"), F.col("value")).alias("value"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points; y grows downwards with the row."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("id"), (F.col("c_custkey") % WIDTH + 0.5).alias("x"), (-(F.floor(F.col("c_custkey") / WIDTH) + 0.5)).alias("y"), F.greatest(F.col("c_acctbal").cast("double") / 100, F.lit(0.0)).alias("water_depth"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as square polygons of whole sizes with a square hole near a corner, y down from 0 like the grids; name and
    nation are attributes."""
    s = table(spark, sf_dir, "supplier")
    k, size = F.col("s_suppkey"), 6 + F.col("s_nationkey") % 5
    x, y = (k * 37) % 90, -((k * 11) % 12) - 12
    p = lambda a, b: F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y"))
    ring = F.array(p(0, 0), p(size, 0), p(size, size), p(0, size))
    hole = F.array(p(1, 1), p(1, 3), p(3, 3), p(3, 1))  # the other way round
    return s.select(k.cast("long").alias("poly_id"), F.array(ring, hole).alias("rings"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
