"""Random grids and points that come out alike on every run: values are hashes of the cell or id."""

from __future__ import annotations

from math import ceil, pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecell.operators import metrics


def uniform(*keys, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def constant_grid(spark: SparkSession, height: int, width: int, value: float | None = 0.0) -> DataFrame:
    i = F.col("id")
    return spark.range(height * width).select(F.floor(i / width).cast("int").alias("row"), (i % width).cast("int").alias("col"), F.lit(value).cast("double").alias("value"))


def random_grid(spark: SparkSession, height: int, width: int, null_share: float = 0.1, seed: int = 42) -> DataFrame:
    v = F.when(uniform("row", "col", seed=seed + 1) >= null_share, uniform("row", "col", seed=seed))
    return constant_grid(spark, height, width).select("row", "col", v.alias("value"))


def normal_grid(spark: SparkSession, height: int, width: int, mean: float = 0.0, sd: float = 1.0, seed: int = 42) -> DataFrame:
    """Normal values, from two hashes of the cell each."""
    v = F.sqrt(-2 * F.log(F.greatest(uniform("row", "col", seed=seed), F.lit(1e-12)))) * F.cos(2 * pi * uniform("row", "col", seed=seed + 1))
    return constant_grid(spark, height, width).select("row", "col", (mean + sd * v).alias("value"))


def random_depths(reference: DataFrame, zero_share: float = 0.5, seed: int = 42) -> DataFrame:
    """Depths like the reference's: scaled by the range of its 2nd to 98th percentile, the ceil(n * share) least set to
    0. The bound is the value of that rank, found by histograms; of values equal to it the first cells are set to 0."""
    low, high = metrics.quantiles(reference, "value", [0.02, 0.98])
    rows = reference.select("row", "col", uniform("row", "col", seed=seed).alias("u"))
    n = reference.count()
    zeros = ceil(n * zero_share)
    bound = metrics.ranked(rows, "u", [zeros - 1])[0] if zeros else -1.0
    below = rows.filter(F.col("u") < bound).count() if zeros else 0
    ties = rows.filter(F.col("u") == bound).orderBy("row", "col").limit(zeros - below).select("row", "col", F.lit(True).alias("tie"))
    zero = (F.col("u") < bound) | F.coalesce("tie", F.lit(False))
    return rows.join(ties, ["row", "col"], "left").select("row", "col", F.when(zero, F.lit(0.0)).otherwise(F.col("u") * ((high or 0.0) - (low or 0.0))).alias("value"))


def random_points(spark: SparkSession, bbox: tuple[float, float, float, float], n: int, depth: float = 2.0, seed: int = 42) -> DataFrame:
    x = bbox[0] + uniform("id", seed=seed) * (bbox[2] - bbox[0])
    y = bbox[1] + uniform("id", seed=seed + 1) * (bbox[3] - bbox[1])
    return spark.range(n).select("id", x.alias("x"), y.alias("y"), (uniform("id", seed=seed + 2) * depth).alias("water_depth"))
