"""Result libraries as long tables: nested dicts come in, filters and pivots replace index surgery."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def flatten(nested: dict, depth: int) -> list[tuple]:
    """A dict of dicts to rows of keys and the value, so many levels deep."""
    if depth == 1:
        return [(str(k), None if v is None else str(v)) for k, v in nested.items()]
    return [(str(k), *rest) for k, sub in nested.items() for rest in flatten(sub, depth - 1)]


def to_long(spark: SparkSession, nested: dict, levels: list[str]) -> DataFrame:
    rows = flatten(nested, len(levels))
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*levels, "val"]))


def library(spark: SparkSession, nested: dict) -> DataFrame:
    """sim -> analysis -> data_type -> var -> value, levels in the order of a result table."""
    return to_long(spark, nested, ["sim_name", "analysis", "data_type", "var_name"]).select("analysis", "data_type", "sim_name", "var_name", "val")


#: What a result library may hold.
ANALYSES, DATA_TYPES = ("hwm", "inun", "grid", "clip", "raw"), ("metric", "fp", "meta")


def load(results: DataFrame, analyses: list[str] | None = None, moved: tuple[str, str] | None = None) -> DataFrame:
    """Without the metadata of the inputs. A row of an unknown analysis or data type, or without a simulation or variable, is
    an error where it is read; with moved (old, new) folders, files' paths are led to the new one."""
    known = F.col("analysis").isin(*ANALYSES) & F.col("data_type").isin(*DATA_TYPES) & F.col("sim_name").isNotNull() & F.col("var_name").isNotNull()
    bad = F.raise_error(F.concat(F.lit("not a result: "), F.concat_ws("/", "analysis", "data_type", "sim_name", "var_name")))
    out = results.withColumn("analysis", F.when(F.coalesce(known, F.lit(False)), F.col("analysis")).otherwise(bad.cast("string")))
    out = out.filter(~((F.col("data_type") == "meta") & F.col("analysis").isin("clip", "raw")))
    if moved:
        path = F.when((F.col("data_type") == "fp") & F.startswith("val", F.lit(moved[0])), F.concat(F.lit(moved[1]), F.expr(f"substring(val, {len(moved[0]) + 1})")))
        out = out.withColumn("val", F.coalesce(path, "val"))
    return out.filter(F.col("analysis").isin(*analyses)) if analyses else out


def collect(results: DataFrame, **where: str) -> DataFrame:
    for c, v in where.items():
        results = results.filter(F.col(c) == v)
    return results


def wide(df: DataFrame, keys: list[str], names: str, values: str, known: list | None = None) -> DataFrame:
    return df.groupBy(*keys).pivot(names, known).agg(F.first(values, ignorenulls=True))


def _all_of(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns], F.lit(True))


def inundation_files(results: DataFrame, names: list[str]) -> DataFrame:
    """A row for each simulation that has all of the named files."""
    return wide(results.filter("analysis = 'inun'"), ["sim_name"], "var_name", "val", names).filter(_all_of(names))


def sim_points(points: DataFrame, sims: list[str]) -> DataFrame:
    """(id, sim, true, pred) -> a column of predictions for each simulation, the truth, and whether all agree on it."""
    preds = [F.max(F.when(F.col("sim") == s, F.col("pred"))).alias(s) for s in sims]
    return points.groupBy("id").agg(*preds, F.max("true").alias("true"), (F.countDistinct("true") <= 1).alias("agree"))


def metric_set(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """(run, metric, val) -> a row for each metric that every run has."""
    return wide(metrics, ["metric"], "run", "val", runs).filter(_all_of(runs))


def multires(stats: DataFrame, scales: list[int], value: str = "vol") -> DataFrame:
    return wide(stats, ["sim"], "dscale", value, scales)


def runtimes(meta: DataFrame) -> DataFrame:
    return meta.filter("var_name = 'tdelta'").select("sim_name", F.expr("try_cast(val as double)").alias("tdelta"))


def relative(paths: DataFrame, column: str, base: str) -> DataFrame:
    return paths.withColumn(column, F.when(F.startswith(column, F.lit(base)), F.ltrim(F.expr(f"substring({column}, {len(base) + 1})"), F.lit("/"))).otherwise(F.col(column)))


def with_level(df: DataFrame, **levels: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in levels.items()})


def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    out = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    return df.orderBy(F.array_position(F.lit(order), F.col(column)))


def scale_key(scale: float) -> str:
    return f"d{scale * 10:.0f}"


def grid_table(cells: DataFrame, columns: list[int], digits: int = 1) -> DataFrame:
    """A small grid as a printed table: a row each, values rounded."""
    return cells.groupBy("row").pivot("col", columns).agg(F.round(F.first("value"), digits))
