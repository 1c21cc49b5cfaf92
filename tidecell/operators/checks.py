"""Preconditions of each kind of grid, as one aggregate each; ``require`` raises where one doesn't hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def facts(cells: DataFrame) -> DataFrame:
    """One row of truths: whether the grid may be a DEM, WSE, WSH or inundation raster."""
    v = F.col("value")
    whole, some = F.count(v) == F.count(F.lit(1)), (F.count(v) > 0) & (F.count(v) < F.count(F.lit(1)))
    return cells.agg(
        whole.alias("is_dem"), some.alias("is_wse"), (whole & (F.min(v) == 0) & (F.max(v) > 0)).alias("is_wsh"),
        (whole & (F.count_if(~v.isin(0.0, 1.0)) == 0) & (F.count_if(v == 0) > 0)).alias("is_inun"),
        (whole & (F.count_if(~v.isin(0.0, 1.0)) == 0)).alias("is_binary_mask"), (F.count_if(v != 1) == 0).alias("is_native_mask"),
    )


def polygon_facts(polygons: DataFrame) -> DataFrame:
    """One row of truths: whether there are polygons, each with rings, and each ring with three points or more."""
    ok = (F.size("rings") > 0) & F.forall("rings", lambda r: F.size(r) > 2)
    return polygons.agg(((F.count(F.lit(1)) > 0) & (F.count_if(~F.coalesce(ok, F.lit(False))) == 0)).alias("is_poly"))


KINDS = {"DEM": "is_dem", "WSE": "is_wse", "WSH": "is_wsh", "INUN_RLAY": "is_inun"}


def require(cells: DataFrame, kind: str) -> DataFrame:
    if not (polygon_facts(cells).first()["is_poly"] if kind == "INUN_POLY" else facts(cells).first()[KINDS[kind]]):
        raise ValueError(f"not a {kind}")
    return cells


def partial_wet(wet: DataFrame) -> DataFrame:
    """Not all wet and not all dry."""
    return wet.agg((F.bool_or("wet") & ~F.bool_and("wet")).alias("partial"))


def identical(true_wet: DataFrame, pred_wet: DataFrame, keys: list[str]) -> DataFrame:
    """Whether no cell differs: such a pair says nothing and is rejected."""
    both = true_wet.join(pred_wet.withColumnRenamed("wet", "other"), keys)
    return both.agg((F.count_if(F.col("wet") != F.col("other")) == 0).alias("identical"))


def attributes_match(grids: DataFrame, **wanted) -> DataFrame:
    """Whether all grids have the wanted attributes."""
    return grids.agg((F.count_if(~F.coalesce(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items()], F.lit(True)), F.lit(False))) == 0).alias("match"))


SPATIAL = ("crs_epsg", "height", "width", "xmin", "ymin", "xmax", "ymax", "res")
EXTENT = ("crs_epsg", "xmin", "ymin", "xmax", "ymax")


def bounds(grids: DataFrame) -> DataFrame:
    return grids.withColumns({"xmin": F.col("x0"), "ymax": F.col("y0"), "xmax": F.col("x0") + F.col("width") * F.col("res"), "ymin": F.col("y0") - F.col("height") * F.col("res")})


def same(grids: DataFrame, columns: tuple[str, ...] = SPATIAL) -> DataFrame:
    """Whether all grids agree in the columns."""
    b = bounds(grids)
    return b.agg((F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])) == 1).alias("same"))


def simple_pixels(grids: DataFrame) -> DataFrame:
    """Whether each grid's pixels have a positive whole size."""
    return grids.select("grid_id", ((F.col("res") > 0) & (F.col("res") == F.floor("res"))).alias("simple"))


def points_only(features: DataFrame) -> DataFrame:
    return features.agg((F.count_if(F.col("geometry.type") != "Point") == 0).alias("points_only"))


def vocabulary(results: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """The values of the column that aren't allowed."""
    return results.filter(~F.col(column).isin(*allowed)).select(column).distinct()
