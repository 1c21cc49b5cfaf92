"""Order statistics of many groups at once, exact and without a buffer that holds a group.

Equal values of a group are counted first, before the shuffle. What is left is sorted in ranges of (group, value); within a
range sums run over rows that one task has sorted, and what a group has in earlier ranges is added from one number for each
range and group. So each value knows which ranks it takes, a rank is a filter, and a group may span any number of tasks.

Edge cases: nulls and NaN have no rank; a group without values has null statistics and count 0; a null group is a group;
of values that are equally frequent the least is minority and majority; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecell.functions.stage import materialize


def counted(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(.., v, n): how often each value stands in its group."""
    v = value.cast("double")
    return df.select(*by, F.when(~F.isnan(v), v).alias("v")).groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))


def placed(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds before, how many lesser values there are in the group, and total; values that are null go."""
    sort = [F.col(c).asc_nulls_first() for c in (*by, "v")]
    cut = counts.filter("v is not null").repartitionByRange(*sort).sortWithinPartitions(*sort)
    cut = materialize(cut.withColumn("__range", F.spark_partition_id()), "rank-ranges")
    in_range = Window.partitionBy("__range", *by)
    here = F.sum("n").over(in_range.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rows = cut.withColumn("__here", here)
    of = Window.partitionBy(*[f"__{c}" for c in by]) if by else Window.partitionBy(F.lit(0))
    sizes = cut.groupBy(F.col("__range").alias("__r"), *[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum("n").alias("__n"))
    sizes = sizes.select("__r", *[f"__{c}" for c in by], (F.sum("__n").over(of.orderBy("__r")) - F.col("__n")).alias("__earlier"), F.sum("__n").over(of).alias("total"))
    same = rows["__range"] == sizes["__r"]
    for c in by:
        same = same & rows[c].eqNullSafe(sizes[f"__{c}"])
    return rows.join(sizes, same).select(*by, "v", "n", (F.col("__here") + F.col("__earlier")).alias("before"), "total")


def quantile(share: float) -> Column:
    """An aggregate over what ``placed`` gives: the quantile, interpolated between the values that hold the two ranks."""
    place = share * (F.col("total") - 1)
    low = F.floor(place)
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
    lower, upper = F.max(F.when(holds(low), F.col("v"))), F.max(F.when(holds(F.ceil(place)), F.col("v")))
    return lower + (F.max(place) - F.max(low)) * (upper - lower)


def order_statistics(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(.., count, unique, q1, median, q3, iqr, minority, majority) of each group's values."""
    counts = materialize(counted(df, by, value), "rank-counts")
    ranks = placed(counts, by).groupBy(*by).agg(quantile(0.25).alias("q1"), quantile(0.5).alias("median"), quantile(0.75).alias("q3"))
    real = F.col("v").isNotNull()
    rest = counts.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).alias("count"), F.count("v").alias("unique"),
        F.min_by(F.col("v"), F.when(real, F.struct("n", "v"))).alias("minority"), F.max_by(F.col("v"), F.when(real, F.struct(F.col("n"), -F.col("v")))).alias("majority"),
    )
    named = ranks.select(*[F.col(c).alias(f"__{c}") for c in by], "q1", "median", "q3")
    same = F.lit(True)
    for c in by:
        same = same & rest[c].eqNullSafe(named[f"__{c}"])
    both = rest.join(named, same, "left")
    return both.select(*by, "count", "unique", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "minority", "majority")


def quantiles_by(df: DataFrame, by: list[str], value: Column, shares: list[float]) -> DataFrame:
    """(.., share, value): exact quantiles of each group, one row for each share."""
    ranks = placed(counted(df, by, value), by).groupBy(*by).agg(F.array(*[F.struct(F.lit(s).alias("share"), quantile(s).alias("value")) for s in shares]).alias("q"))
    return ranks.select(*by, F.explode("q").alias("q")).select(*by, "q.share", "q.value")
