"""Grids stored by tile, so that grids of one layout meet without a shuffle and windows read few files.

A tile is SIDE x SIDE cells and has a place on the Z-order curve (``morton``); SPAN consecutive tiles on the curve, a square
again, are a part. The table is bucketed by part, one file a bucket, and sorted by tile and cell. Two tables with the same
layout are joined on (part, tile, row, col) bucket by bucket: no exchange. A window is a list of parts, which prunes
buckets, and a range of tiles, which prunes row groups. ``algebra.pair`` uses the layout wherever both sides have it, and
keeps it, so chains of map algebra stay free of shuffles. As the buckets go by the first of the join's keys alone,
reading sets spark.sql.requireAllClusterKeysForCoPartition to false for the session.

Edge cases: null rows or columns are in no tile and are refused; a grid without cells is a table without rows; tables are known
to the session's catalog, and ``open_tiled`` makes them known again in another session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecell.operators.algebra import grid_of

SIDE, SPAN, BUCKETS = 256, 64, 64
_SPEC = "_tiles"  # Spark's readers leave out what begins with an underscore


def _spread(x: Column) -> Column:
    """The lower 31 bits of a number, each followed by an empty bit."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def morton(row: Column, col: Column) -> Column:
    """The place of a tile on the Z-order curve; rows and columns from 0 to 2^31 - 1."""
    return F.shiftleft(_spread(row.cast("long")), 1).bitwiseOR(_spread(col.cast("long")))


def _morton(row: int, col: int) -> int:
    return sum((row >> b & 1) << (2 * b + 1) | (col >> b & 1) << 2 * b for b in range(31))


def placed(cells: DataFrame, side: int = SIDE, span: int = SPAN) -> DataFrame:
    """Adds part and tile; span is a power of 4."""
    bad = F.col("row").isNull() | F.col("col").isNull() | (F.col("row") < 0) | (F.col("col") < 0)
    at = F.when(bad, F.raise_error(F.lit("a cell without a row and a column from 0 on is in no tile")).cast("long")).otherwise(morton(F.floor(F.col("row") / side), F.floor(F.col("col") / side)))
    return cells.withColumn("tile", at).withColumn("part", F.floor(F.col("tile") / span))


def write_tiled(cells: DataFrame, name: str, path: str, side: int = SIDE, span: int = SPAN, buckets: int = BUCKETS) -> None:
    """Writes the table ``name`` at path. Grids that are to meet want the same side, span and buckets."""
    spark, by = cells.sparkSession, grid_of(cells)
    out = placed(cells, side, span).select(*by, "part", "tile", "row", "col", "value")
    order = ["part", "tile", *by, "row", "col"]
    out.repartition(buckets, "part").sortWithinPartitions(*order).write.bucketBy(buckets, "part").sortBy(*order).format("parquet").option("path", path).saveAsTable(name)
    spark.createDataFrame([(side, span, buckets)], "side int, span int, buckets int").coalesce(1).write.json(f"{path}/{_SPEC}")


def layout(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(side, span, buckets) of the table at path."""
    return tuple(spark.read.schema("side int, span int, buckets int").json(f"{path}/{_SPEC}").first())


def open_tiled(spark: SparkSession, name: str, path: str) -> None:
    """Makes a table that another session has written known as ``name``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    by = "grid_id, " if "grid_id" in fields else ""
    spark.sql(f"create table {name} ({fields}) using parquet clustered by (part) sorted by (part, tile, {by}row, col) into {layout(spark, path)[2]} buckets location '{path}'")


def _overlapping(window: tuple[int, int, int, int], side: int, span: int) -> tuple[list[int], int, int]:
    """The parts that a window meets, and the first and last tile they can need."""
    r0, r1, c0, c1 = window
    wide = side * int(round(span**0.5))
    parts = [_morton(r, c) for r in range(r0 // wide, (r1 - 1) // wide + 1) for c in range(c0 // wide, (c1 - 1) // wide + 1)]
    return parts, _morton(r0 // side, c0 // side), _morton((r1 - 1) // side, (c1 - 1) // side)


#: A window that meets more parts than this reads by its range of tiles alone.
MOST_PARTS = 10_000


def read_tiled(spark: SparkSession, name: str, window: tuple[int, int, int, int] | None = None, spec: tuple[int, int, int] | None = None) -> DataFrame:
    """(.., part, tile, row, col, value); a window is (first row, row behind, first col, col behind) and wants the layout."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    df = spark.table(name).hint("merge")
    if not window:
        return df
    r0, r1, c0, c1 = window
    if r0 >= r1 or c0 >= c1:
        return df.limit(0)
    side, span, _ = spec
    inside = F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1)
    wide = side * int(round(span**0.5))
    many = ((r1 - 1) // wide - r0 // wide + 1) * ((c1 - 1) // wide - c0 // wide + 1)
    if many <= MOST_PARTS:
        parts, first, last = _overlapping(window, side, span)
        inside = F.col("part").isin(parts) & F.col("tile").between(first, last) & inside
    return df.filter(inside)
