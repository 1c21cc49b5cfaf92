"""Scores, statistics and regressions: each is one aggregate, so partial sums meet and nothing else is shuffled."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecell.functions.stage import materialize

from .algebra import key, pair


def confusion_counts(both: DataFrame, true: str = "t", pred: str = "p") -> DataFrame:
    """TN, FP, FN, TP of two boolean columns."""
    t, p = F.col(true), F.col(pred)
    return both.agg(F.count_if(~t & ~p).alias("TN"), F.count_if(~t & p).alias("FP"), F.count_if(t & ~p).alias("FN"), F.count_if(t & p).alias("TP"))


def inundation_scores(counts: DataFrame) -> DataFrame:
    """The counts with hit rate, false alarms, critical success index and error bias; a ratio over 0 is NULL."""
    c = F.col
    return counts.select(
        "TP", "TN", "FP", "FN",
        F.try_divide(c("TP"), c("TP") + c("FN")).alias("hitRate"),
        F.try_divide(c("FP"), c("TP") + c("FP")).alias("falseAlarms"),
        F.try_divide(c("TP"), c("TP") + c("FP") + c("FN")).alias("criticalSuccessIndex"),
        F.try_divide(c("FP"), c("FN")).alias("errorBias"),
    )


def inundation_metrics(true_wet: DataFrame, pred_wet: DataFrame) -> DataFrame:
    k = key(true_wet, pred_wet)
    both = true_wet.select(*k, F.col("wet").alias("t")).join(pred_wet.select(*k, F.col("wet").alias("p")), k)
    return inundation_scores(confusion_counts(both))


def confusion_selfcheck(codes: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, by_grid, by_count, equal): the confusion grid against the counts."""
    from .vector import confusion_labels

    long = counts.unpivot([], ["TN", "FP", "FN", "TP"], "label", "by_count")
    return long.join(confusion_labels(codes), "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("by_grid"), "by_count", (F.coalesce("n", F.lit(0)) == F.col("by_count")).alias("equal"))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; NULL where either is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def error_metrics(df: DataFrame, true: str = "true", pred: str = "pred", by: list[str] | None = None, normed: bool = False) -> DataFrame:
    """Bias, its shift, errors, correlation and wet/dry counts (wet: above 0) of pairs; normed turns counts to shares."""
    t, p = F.col(true), F.col(pred)
    count = lambda x: (F.count_if(x) / F.count(F.lit(1)) if normed else F.count_if(x))
    bias = F.try_divide(F.sum(p), F.sum(t))
    return df.groupBy(*(by or [])).agg(
        bias.alias("bias"), (bias - 1).alias("bias_shift"), F.avg(p - t).alias("meanError"), F.avg(F.abs(p - t)).alias("meanErrorAbs"),
        F.sqrt(F.avg((p - t) * (p - t))).alias("RMSE"), correlation(t, p).alias("pearson"),
        count((t > 0) & (p > 0)).alias("TP"), count((t <= 0) & (p > 0)).alias("FP"), count((t <= 0) & (p <= 0)).alias("TN"), count((t > 0) & (p <= 0)).alias("FN"),
    )


#: Each metric by its own name, as an aggregate of (true, pred).
RETRIEVE: dict = {
    "bias": lambda t, p: F.try_divide(F.sum(p), F.sum(t)),
    "bias_shift": lambda t, p: F.try_divide(F.sum(p), F.sum(t)) - 1,
    "meanError": lambda t, p: F.avg(p - t),
    "meanErrorAbs": lambda t, p: F.avg(F.abs(p - t)),
    "RMSE": lambda t, p: F.sqrt(F.avg((p - t) * (p - t))),
    "pearson": correlation,
}


def retrieve(df: DataFrame, name: str, true: str = "true", pred: str = "pred") -> DataFrame:
    return df.agg(RETRIEVE[name](F.col(true), F.col(pred)).alias(name))


def basic_stats(df: DataFrame, column: str = "value") -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.avg(column).alias("mean"), F.max(column).alias("max"))


def wsh_stats(wsh: DataFrame, res: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Mean over all cells, wet area, volume."""
    area = res * res
    return wsh.groupBy(*(by or [])).agg(F.avg("value").alias("mean"), (F.count_if(F.col("value") > 0) * area).alias("posi_area"), (F.sum("value") * area).alias("vol"))


def raster_stats(cells: DataFrame, res: float = 1.0) -> DataFrame:
    v = F.col("value")
    return cells.agg(
        F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.count_if(v.isNull()).alias("null_cnt"), F.count(v).alias("real_cnt"), F.count(F.lit(1)).alias("size"), F.sum(v).alias("sum"), (F.sum(v) * res * res).alias("volume")
    )


def unique_values(cells: DataFrame, digits: int = 0) -> DataFrame:
    return cells.filter("value is not null").select(F.round("value", digits).alias("value")).distinct()


def set_report(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Sizes of the differences, union, intersection and symmetric difference of two key sets, by one aggregate."""
    both = left.select(F.col(column).alias("k"), F.lit(1).alias("s")).unionAll(right.select(F.col(column).alias("k"), F.lit(2).alias("s")))
    sides = both.groupBy("k").agg(F.bit_or("s").alias("s"))
    n = lambda *v: F.count_if(F.col("s").isin(*v))
    return sides.agg(n(1).alias("diff_left"), n(2).alias("diff_right"), n(1, 2, 3).alias("union"), n(3).alias("intersection"), n(1, 2).alias("symdiff"))


#: Steps of Simpson's rule, and tails that are summed together.
_STEPS, _TAILS = 2000, 512


def student_tails(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided tails of Student's t, by Simpson's rule on the angle of its tangent form, many at a time."""
    t, dof = np.abs(np.asarray(t, float)), np.asarray(dof, float)
    weights, out = np.full(_STEPS + 1, 2.0), np.empty(len(t))
    weights[1::2], weights[[0, -1]] = 4.0, 1.0
    for i in range(0, len(t), _TAILS):
        n = dof[i : i + _TAILS]
        low = np.arctan(t[i : i + _TAILS] / np.sqrt(n))
        h = (math.pi / 2 - low) / _STEPS
        area = h / 3 * ((np.maximum(np.cos(low[:, None] + h[:, None] * np.arange(_STEPS + 1)), 0.0) ** (n - 1)[:, None]) @ weights)
        scale = np.array([math.exp(math.lgamma((k + 1) / 2) - math.lgamma(k / 2)) for k in n.tolist()])
        out[i : i + _TAILS] = np.minimum(1.0, 2 * area * scale / math.sqrt(math.pi))
    return out


def _student_p(t: float, dof: float) -> float:
    return float(student_tails(np.array([t]), np.array([dof]))[0])


def linear_regression(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, intercept, rvalue, stderr, n of a least-squares line."""
    X, Y = F.col(x), F.col(y)
    r2, n = F.regr_r2(Y, X), F.regr_count(Y, X)
    return df.groupBy(*(by or [])).agg(
        F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"), correlation(X, Y).alias("rvalue"),
        F.sqrt(F.try_divide((1 - r2) * F.regr_syy(Y, X), F.regr_sxx(Y, X) * (n - 2))).alias("stderr"), n.alias("n"),
    )


def through_origin(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """slope, n of the least-squares line through the origin that doesn't fall."""
    X, Y = F.col(x), F.col(y)
    both = df.filter(X.isNotNull() & Y.isNotNull())
    return both.groupBy(*(by or [])).agg(F.greatest(F.try_divide(F.sum(X * Y), F.sum(X * X)), F.lit(0.0)).alias("slope"), F.count(F.lit(1)).alias("n"))


def with_pvalue(regression: DataFrame) -> DataFrame:
    """Adds pvalue: the chance of such a slope if there were none."""
    @F.pandas_udf("double")
    def p(slope: pd.Series, stderr: pd.Series, n: pd.Series) -> pd.Series:
        known = (stderr.notna() & (stderr != 0) & slope.notna() & (n > 2)).to_numpy()
        out = np.full(len(n), np.nan)
        out[known] = student_tails((slope / stderr)[known].to_numpy(), (n - 2)[known].to_numpy())
        return pd.Series(out).where(known, None)

    return regression.withColumn("pvalue", p("slope", "stderr", "n"))


def ols(df: DataFrame, label: str, numeric: list[str], dummies: list[str] | None = None, intercept: bool = True):
    """Least squares with dummy columns; the fitted pipeline has coefficients, standard errors and r2 in its last stage."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    steps = [s for d in dummies or [] for s in (StringIndexer(inputCol=d, outputCol=f"{d}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{d}_i", outputCol=f"{d}_v"))]
    steps += [VectorAssembler(inputCols=[*numeric, *[f"{d}_v" for d in dummies or []]], outputCol="features"), LinearRegression(featuresCol="features", labelCol=label, fitIntercept=intercept, solver="normal")]
    return Pipeline(stages=steps).fit(df)


def multinomial(df: DataFrame, label: str, numeric: list[str]):
    """Multinomial logit on a string label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="label_i"), VectorAssembler(inputCols=numeric, outputCol="features"), LogisticRegression(featuresCol="features", labelCol="label_i", family="multinomial")]).fit(df)


def label_confusion(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """A row for each true label and a column for each predicted one."""
    return df.groupBy(F.col(true).alias("true")).pivot(pred, labels).agg(F.count(F.lit(1))).na.fill(0)


def histogram(df: DataFrame, value: Column, width: float, bins: int, low: float = 0.0) -> DataFrame:
    """(bin, n): bins of equal width from low on; the last takes what lies beyond."""
    b = F.greatest(F.least(F.floor((value - low) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    return df.filter(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Values that are sorted at once, and bins that a wider range is cut into.
SORTED, BINS = 100_000, 1024


def ranked(df: DataFrame, column: str, ranks: list[int]) -> list[float | None]:
    """The values of ranks 0, 1, ... in order. A histogram tells which bin holds a rank, and that bin is cut again until few
    enough values are left to sort: no task or buffer holds all distinct values. Nulls and NaN have no rank."""
    values = materialize(df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "ranked")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()

    def at(rank: int) -> float:
        a, b, before, inside = low, high, 0, n
        while a < b:
            part = values.filter(F.col("v").between(a, b))
            if inside <= SORTED:
                return sorted(r["v"] for r in part.collect())[rank - before]
            bin_ = F.least(F.floor((F.col("v") - a) / ((b - a) / BINS)), F.lit(BINS - 1)).alias("bin")
            for r in sorted(part.groupBy(bin_).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()):
                if rank < before + r["n"]:
                    a, b, inside = r["a"], r["b"], r["n"]
                    break
                before += r["n"]
        return a

    known = {rank: at(rank) for rank in {*ranks} if 0 <= rank < n}
    return [known.get(rank) for rank in ranks]


def quantiles(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between ranks; None if there is no value."""
    n = df.agg(F.count_if(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))).first()[0]
    if not n:
        return [None] * len(probs)
    places = [p * (n - 1) for p in probs]
    got = ranked(df, column, [r for x in places for r in (math.floor(x), math.ceil(x))])
    return [a + (x - math.floor(x)) * (b - a) for x, a, b in zip(places, got[::2], got[1::2])]


def quantile_range(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    a, b = quantiles(df, column, [low, high])
    return df.sparkSession.createDataFrame([(a, b, None if a is None else b - a)], "low double, high double, spread double")


def kde(df: DataFrame, column: str, at: list[float], bandwidth: float, by: list[str] | None = None) -> DataFrame:
    """(.., x, density): a Gaussian kernel density at a few places, as violins draw it; partial sums before the shuffle."""
    x = F.explode(F.array(*[F.lit(float(v)) for v in at])).alias("x")
    each = df.filter(F.col(column).isNotNull()).select(*(by or []), F.col(column).cast("double").alias("v"), x)
    kernel = F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / bandwidth, F.lit(2.0))) / (bandwidth * math.sqrt(2 * math.pi))
    return each.groupBy(*(by or []), "x").agg(F.avg(kernel).alias("density"))


def student_quantile(level: float, dof: float) -> float:
    """The t that a share level of Student's distribution lies within, on both sides together."""
    low, high = 0.0, 1e3
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _student_p(mid, dof) > 1 - level else (low, mid)
    return low


def ols_intervals(model, names: list[str], level: float = 0.95) -> list[dict]:
    """A row for each coefficient of a fitted ``ols``, the intercept last: coef, stderr, t, p, and the confidence interval."""
    s = model.stages[-1].summary
    coefs = [*model.stages[-1].coefficients, *([model.stages[-1].intercept] if len(s.tValues) > len(model.stages[-1].coefficients) else [])]
    reach = student_quantile(level, s.degreesOfFreedom)
    rows = zip([*names, "intercept"], coefs, s.coefficientStandardErrors, s.tValues, s.pValues)
    return [{"name": n, "coef": c, "stderr": e, "t": t, "p": p, "low": c - reach * e, "high": c + reach * e} for n, c, e, t, p in rows]
