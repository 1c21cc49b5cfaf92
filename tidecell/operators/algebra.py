"""Cell-wise map algebra over cell tables (row, col, value), or (grid_id, row, col, value): joins by cell and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecell.schemas import CONFUSION


def key(*grids: DataFrame) -> list[str]:
    """The columns that address a cell in all of the grids."""
    return [c for c in ("grid_id", "row", "col") if all(c in g.columns for g in grids)]


def grid_of(cells: DataFrame) -> list[str]:
    """The column that tells grids apart, where a table holds several."""
    return [c for c in ("grid_id",) if c in cells.columns]


def place(*grids: DataFrame) -> list[str]:
    """The columns of the layout that grids stored by tile share."""
    return ["part", "tile"] if all({"part", "tile"} <= {*g.columns} for g in grids) else []


def pair(a: DataFrame, b: DataFrame, left: str = "a", right: str = "b", how: str = "inner") -> DataFrame:
    """Two grids side by side: one equi-join on the cell, bucket by bucket if both are stored by tile."""
    k = [*place(a, b), *key(a, b)]
    return a.select(*k, F.col("value").alias(left)).join(b.select(*k, F.col("value").alias(right)), k, how)


def _of(pairs: DataFrame, value: Column) -> DataFrame:
    return pairs.select(*place(pairs), *key(pairs), value.alias("value"))


def terrain_filter(wse: DataFrame, dem: DataFrame) -> DataFrame:
    """Water at or below the terrain becomes dry."""
    return _of(pair(wse, dem, "w", "d"), F.when(F.col("w") > F.col("d"), F.col("w")))


def violations(wse: DataFrame, dem: DataFrame) -> DataFrame:
    """One row: wet cells before and after the terrain filter, and how many it takes."""
    p = pair(wse, dem, "w", "d")
    return p.agg(F.count("w").alias("wet_before"), F.count_if(F.col("w") > F.col("d")).alias("wet_after"), F.count_if(F.col("w") <= F.col("d")).alias("violations"))


def depth(wse: DataFrame, dem: DataFrame) -> DataFrame:
    """Water surface less terrain; dry and negative are 0."""
    return _of(pair(wse, dem, "w", "d"), F.greatest(F.coalesce(F.col("w") - F.col("d"), F.lit(0.0)), F.lit(0.0)))


def wse_from_depth(wsh: DataFrame, dem: DataFrame) -> DataFrame:
    return _of(pair(wsh, dem, "h", "d"), F.when(F.col("h") > 0, F.col("h") + F.col("d")))


def wet_of_wse(wse: DataFrame) -> DataFrame:
    return wse.select(*key(wse), F.col("value").isNotNull().alias("wet"))


def wet_of_depth(wsh: DataFrame) -> DataFrame:
    return wsh.select(*key(wsh), (F.col("value") > 0).alias("wet"))


def dry_of_depth(wsh: DataFrame) -> DataFrame:
    return wsh.select(*key(wsh), (F.col("value") == 0).alias("dry"))


def clean_depth(wsh: DataFrame) -> DataFrame:
    """Negative depths become 0; no-data stays."""
    return _of(wsh, F.when(F.col("value") >= 0, F.col("value")).when(F.col("value").isNotNull(), F.lit(0.0)))


def apply_mask(cells: DataFrame, mask: DataFrame, replace: bool = False, fill: float = 0.0) -> DataFrame:
    """mask (.., masked boolean). Masked cells lose their value; with replace the mask alone decides, and fill shows what it uncovers."""
    k = key(cells, mask)
    joined = cells.join(mask.select(*k, "masked"), k)
    return _of(joined, F.when(~F.col("masked"), F.coalesce(F.col("value"), F.lit(fill)) if replace else F.col("value")))


def mosaic(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two rasters that don't overlap; a cell with data in both is an error (see ``overlap``)."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return _of(pair(a, b, how="full"), F.when(both, F.raise_error(F.lit("the grids overlap")).cast("double")).otherwise(F.coalesce("a", "b")))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    return pair(a, b).agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap"))


def calc(cells: DataFrame, expression: str) -> DataFrame:
    """Any SQL expression of value; NaN becomes no-data."""
    x = F.expr(expression)
    return _of(cells, F.when(~F.isnan(x.cast("double")), x))


def confusion_code(true: Column, pred: Column) -> Column:
    c = {k: F.lit(v) for k, v in CONFUSION.items()}
    return F.when(true & pred, c["TP"]).when(true & ~pred, c["FN"]).when(~true & pred, c["FP"]).when(~true & ~pred, c["TN"])


def confusion_grid(true_wet: DataFrame, pred_wet: DataFrame) -> DataFrame:
    k = key(true_wet, pred_wet)
    both = true_wet.select(*k, F.col("wet").alias("t")).join(pred_wet.select(*k, F.col("wet").alias("p")), k)
    return both.select(*k, confusion_code(F.col("t"), F.col("p")).alias("code"))


def element_bias(true: Column, pred: Column) -> Column:
    """pred / true; both zero give 1, one zero gives NULL."""
    return F.when((true == 0) & (pred == 0), F.lit(1.0)).when((true != 0) & (pred != 0), pred / true)


def display(cells: DataFrame, kind: str) -> DataFrame:
    """What a map of the kind shows: depths without 0, confusion without TN, terrain below 130."""
    show = {"WSH": F.col("value") != 0, "CONFU": F.col("value") != CONFUSION["TN"], "DEM": F.col("value") < 130, "WSE": F.lit(True)}[kind]
    return _of(cells, F.when(show, F.col("value")))


def round_to(cells: DataFrame, multiple: float) -> DataFrame:
    """To a multiple, halves to the even one."""
    return _of(cells, F.lit(multiple) * F.bround(F.col("value") / multiple))


def threshold(cells: DataFrame, low: float | None = None, high: float | None = None, strict: bool = False, slack: float = 0.001) -> DataFrame:
    """1 where the value is within the bounds, NULL elsewhere; bounds that aren't strict have some slack."""
    v, ok = F.col("value"), F.col("value").isNotNull()
    if low is not None:
        ok = ok & ((v > low) if strict else (v >= low - slack))
    if high is not None:
        ok = ok & ((v < high) if strict else (v <= high + slack))
    return _of(cells, F.when(ok, F.lit(1.0)))


def value_mask(cells: DataFrame, value: float) -> DataFrame:
    return _of(cells, F.when(F.col("value") == value, F.lit(1.0)))


def data_mask(cells: DataFrame) -> DataFrame:
    return _of(cells, F.when(F.col("value").isNotNull(), F.lit(1.0)))


def invert_mask(cells: DataFrame) -> DataFrame:
    return _of(cells, F.when(F.col("value").isNull(), F.lit(1.0)))


def masked_by(cells: DataFrame, mask: DataFrame) -> DataFrame:
    return _of(pair(cells, mask), F.when(F.col("b") == 1, F.col("a")))


def select_where(df: DataFrame, conditions: dict, any_of: bool = False) -> DataFrame:
    """Rows by column: value, or list of values; all conditions, or any."""
    terms = [F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c).eqNullSafe(v) for c, v in conditions.items()]
    return df.filter(reduce(lambda x, y: x | y if any_of else x & y, terms)) if terms else df


#: How one kind of grid becomes another: (from, to) -> function of the grid and the terrain.
CONVERSIONS = {
    ("WSE", "WSH"): lambda cells, dem: depth(cells, dem),
    ("WSH", "WSE"): lambda cells, dem: wse_from_depth(cells, dem),
    ("WSE", "INUN"): lambda cells, dem: wet_of_wse(cells),
    ("WSH", "INUN"): lambda cells, dem: wet_of_depth(cells),
}


def convert(cells: DataFrame, kind: str, to: str, dem: DataFrame | None = None) -> DataFrame:
    if kind == to:
        return cells
    if (kind, to) not in CONVERSIONS:
        raise KeyError(f"no conversion from {kind} to {to}")
    return CONVERSIONS[kind, to](cells, dem)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to as many tasks as there are partitions of a shuffle: small ones, which Spark would put together, can
    be much work or become many."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
