"""High-water marks that arrive as a stream, scored against a depth grid in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scored(points: DataFrame, wsh: DataFrame, late: str = "10 minutes", window: str = "1 hour", time: str = "ts", x0: float = 0.0, y0: float = 0.0, res: float = 1.0) -> DataFrame:
    """points (ts, x, y, water_depth), streaming or not. The grid is the static side of an equi-join on the cell; state
    is one row of sums for each open window, and windows older than the watermark leave it."""
    p = points.withWatermark(time, late) if points.isStreaming else points
    p = p.withColumns({"row": F.floor((y0 - F.col("y")) / res).cast("int"), "col": F.floor((F.col("x") - x0) / res).cast("int")})
    met = p.join(wsh.select("row", "col", F.col("value").alias("pred")), ["row", "col"])
    e = F.col("pred") - F.col("water_depth")
    agg = met.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("meanError"), F.sqrt(F.avg(e * e)).alias("RMSE"))
    return agg.select(F.col("w.start").alias("window_start"), "n", "meanError", "RMSE")
