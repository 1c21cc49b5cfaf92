"""Grids, masks, stages and metadata as parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecell.operators.algebra import grid_of
from tidecell.schemas import NODATA


def write_grid(cells: DataFrame, path: str) -> None:
    """Partitioned by grid and sorted by cell, so that windows prune row groups."""
    by = ["grid_id"] if "grid_id" in cells.columns else []
    sorted_ = cells.repartitionByRange(*by, "row").sortWithinPartitions(*by, "row", "col")
    (sorted_.write.partitionBy(*by) if by else sorted_.write).parquet(path)


def read_grid(spark: SparkSession, path: str, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.filter(F.col("row").between(window[0], window[1] - 1) & F.col("col").between(window[2], window[3] - 1)) if window else df


def filled(cells: DataFrame, nodata: float = NODATA) -> DataFrame:
    """With the sentinel, as files want it."""
    return cells.withColumn("value", F.coalesce("value", F.lit(nodata)).cast("float"))


def mask_values(masked: DataFrame, kind: str = "binary") -> DataFrame:
    """(.., masked boolean) -> 0 where masked, else 1; the native kind has no data in place of 0."""
    v = F.when(F.col("masked"), F.lit(0.0 if kind == "binary" else None).cast("double")).otherwise(F.lit(1.0))
    return masked.select(*[c for c in masked.columns if c != "masked"], v.alias("value"))


def read_mask(cells: DataFrame, kind: str = "binary") -> DataFrame:
    masked = F.col("value") != 1 if kind == "binary" else F.col("value").isNull()
    return cells.select(*[c for c in cells.columns if c != "value"], masked.alias("masked"))


def extract_mask(cells: DataFrame, invert: bool = False, require_some: bool = False) -> DataFrame:
    """(.., masked): cells without data, or with invert those with data. A grid without any masked cell can be an error."""
    masked = F.col("value").isNull()
    if require_some and not cells.filter(masked).limit(1).count():
        raise ValueError("no cell is masked")
    return cells.select(*[c for c in cells.columns if c != "value"], (~masked if invert else masked).alias("masked"))


def inundation_values(wet: DataFrame) -> DataFrame:
    """As inundation rasters are stored: 0 is wet."""
    return wet.select(*[c for c in wet.columns if c != "wet"], F.when(F.col("wet"), 0.0).otherwise(1.0).alias("value"))


def profile(cells: DataFrame, res: float = 1.0, x0: float = 0.0, y0: float = 0.0, crs_epsg: int | None = None, nodata: float = NODATA) -> DataFrame:
    """A row of GRIDS for each grid of a table of cells."""
    by = grid_of(cells)
    size = cells.groupBy(*by).agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"))
    name = F.col("grid_id") if by else F.lit(None).cast("string").alias("grid_id")
    return size.select(name, F.lit(crs_epsg).cast("int").alias("crs_epsg"), "height", "width", F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(res).alias("res"), F.lit(nodata).alias("nodata"))


def with_crs(grids: DataFrame, crs_epsg: int, replace: bool = False) -> DataFrame:
    """Grids that are told their reference system; one that has another already is an error, unless it is to be replaced."""
    own = F.col("crs_epsg")
    other = F.raise_error(F.concat(F.lit("the grid has another reference system: "), own.cast("string"))).cast("int")
    return grids.withColumn("crs_epsg", F.lit(crs_epsg) if replace else F.when(own.isNull() | (own == crs_epsg), F.lit(crs_epsg)).otherwise(other))


def write_meta(meta: DataFrame, path: str) -> None:
    meta.write.partitionBy("tab").parquet(path)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built first if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
