"""Regression from sufficient statistics: each pass over the data is one aggregate of sums, and only these come to the driver.

Least squares needs the Gram matrix of the columns, dummies of categories among them, once; its size is the square of the
number of columns, whatever the rows. The multinomial logit takes Newton steps, each with one aggregate for the gradient
and the information. Sums are taken around the columns' means, so they keep their digits.

Edge cases: rows with a null or NaN in a used column play no part; the first level of a category, in order, is the
base; a column that others determine (singular Gram matrix) and fewer rows than columns are errors; levels that the data
lacks are not known.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import _student_p, student_quantile


@dataclass
class Fit:
    """names, coefs and their covariance; n rows, dof degrees of freedom, and what the kind of fit adds."""

    names: list[str]
    coefs: np.ndarray
    cov: np.ndarray
    n: int
    dof: float
    r2: float | None = None
    sigma: float | None = None
    loglik: float | None = None
    steps: int | None = None

    def table(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        """(name, coef, stderr, t, p, low, high): a row for each coefficient, with the interval of that level."""
        reach = student_quantile(level, self.dof) if math.isfinite(self.dof) else _normal_quantile(level)
        rows = []
        for name, b, v in zip(self.names, self.coefs.tolist(), np.diag(self.cov).tolist()):
            e = math.sqrt(max(v, 0.0))
            t = b / e if e else None
            p = None if t is None else _student_p(t, self.dof) if math.isfinite(self.dof) else math.erfc(abs(t) / math.sqrt(2))
            rows.append((name, b, e, t, p, b - reach * e, b + reach * e))
        return spark.createDataFrame(rows, "name string, coef double, stderr double, t double, p double, low double, high double")


def _normal_quantile(level: float) -> float:
    low, high = 0.0, 40.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < level else (low, mid)
    return low


def design(df: DataFrame, numeric: list[str], categories: list[str], intercept: bool) -> tuple[DataFrame, list[str], list[Column]]:
    """(complete rows, names, columns): the numbers, a dummy for each level but the first of each category, and 1."""
    ok = F.lit(True)
    for c in numeric:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    for c in categories:
        ok = ok & F.col(c).isNotNull()
    rows = df.filter(ok)
    names, columns = list(numeric), [F.col(c).cast("double") for c in numeric]
    if categories:
        found = rows.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(f"c{i}") for i, c in enumerate(categories)]).first()
        for i, c in enumerate(categories):
            for v in found[i][1:]:
                names.append(f"{c}[{v}]")
                columns.append((F.col(c).cast("string") == v).cast("double"))
    if intercept:
        names.append("intercept")
        columns.append(F.lit(1.0))
    return rows, names, columns


def _sums(rows: DataFrame, terms: list[Column]) -> np.ndarray:
    got = rows.agg(*[F.coalesce(F.sum(t), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(terms)]).first()
    return np.array([float(x) for x in got])


def _solved(matrix: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.diag(matrix))
    if not (scale > 0).all() or np.linalg.matrix_rank(unit := matrix / np.outer(scale, scale), tol=1e-10) < len(matrix):
        raise ValueError("some columns are determined by others")
    return np.linalg.inv(unit) / np.outer(scale, scale)


def least_squares(df: DataFrame, label: str, numeric: list[str], categories: list[str] | None = None, intercept: bool = True) -> Fit:
    """Ordinary least squares."""
    y = F.col(label).cast("double")
    rows, names, columns = design(df.filter(y.isNotNull() & ~F.isnan(y)), numeric, categories or [], intercept)
    k = len(columns)
    first = _sums(rows, [F.lit(1.0), y, *columns])
    n = int(first[0])
    if n <= k:
        raise ValueError(f"{n} rows for {k} coefficients")
    # around the means if there is an intercept: the sums of products then are those of the spreads
    mean = first[1:] / n if intercept else np.zeros(k + 1)
    if intercept:
        mean[-1] = 0.0
    around = [y - float(mean[0]), *[c - float(m) for c, m in zip(columns, mean[1:])]]
    at = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    gram = np.zeros((k + 1, k + 1))
    for (i, j), s in zip(at, _sums(rows, [around[i] * around[j] for i, j in at])):
        gram[i, j] = gram[j, i] = s
    inverse = _solved(gram[1:, 1:])
    coefs = inverse @ gram[1:, 0]
    rss = float(gram[0, 0] - coefs @ gram[1:, 0])
    back = np.eye(k)  # from coefficients around the means to those of the columns
    if intercept:
        back[-1, :-1] = -mean[1:-1]
        coefs = back @ coefs
        coefs[-1] += mean[0]
    sigma2 = max(rss, 0.0) / (n - k)
    total = float(gram[0, 0])
    return Fit(names, coefs, sigma2 * back @ inverse @ back.T, n, n - k, None if total == 0 else 1 - rss / total, math.sqrt(sigma2))


def multinomial(df: DataFrame, label: str, numeric: list[str], categories: list[str] | None = None, most: int = 50, close: float = 1e-10) -> Fit:
    """Logit of a label with two or more values, the first in order as the base. names are value:column."""
    rows, columns_names, columns = design(df.filter(F.col(label).isNotNull()), numeric, categories or [], True)
    values = [r[0] for r in rows.select(F.col(label).cast("string")).distinct().orderBy(label).collect()]
    k, m = len(columns), len(values) - 1
    if m < 1:
        raise ValueError("the label has fewer than two values")
    spread = [s or 1.0 for s in rows.agg(*[F.stddev_pop(c) for c in columns[:-1]]).first()] if k > 1 else []
    mean = [float(x) for x in rows.agg(*[F.avg(c) for c in columns[:-1]]).first()] if k > 1 else []
    scaled = [(c - a) / float(s) for c, a, s in zip(columns, mean, spread)] + [columns[-1]]
    is_ = [(F.col(label).cast("string") == v).cast("double") for v in values[1:]]
    rows = rows.select(F.array(*scaled).alias("__x"), F.array(*is_).alias("__y"))
    x, y = [F.col("__x")[i] for i in range(k)], [F.col("__y")[i] for i in range(m)]
    beta, last, step = np.zeros((m, k)), -np.inf, 0
    while True:
        score = F.array(*[sum((x[i] * float(beta[c, i]) for i in range(k)), F.lit(0.0)) for c in range(m)])
        with_p = rows.withColumn("__s", score).withColumn("__top", F.greatest(F.array_max("__s"), F.lit(0.0)))
        with_p = with_p.withColumn("__e", F.transform("__s", lambda s: F.exp(s - F.col("__top")))).withColumn("__all", F.exp(-F.col("__top")) + F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
        p = [F.col("__e")[c] / F.col("__all") for c in range(m)]
        loglik = F.aggregate(F.zip_with("__y", "__s", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - F.col("__top") - F.log("__all")
        pairs = [(c, d, i, j) for c in range(m) for d in range(c, m) for i in range(k) for j in range(i, k)]
        got = _sums(with_p, [loglik, *[(y[c] - p[c]) * x[i] for c in range(m) for i in range(k)], *[p[c] * ((1 if c == d else 0) - p[d]) * x[i] * x[j] for c, d, i, j in pairs], F.lit(1.0)])
        gradient, info = got[1 : 1 + m * k], np.zeros((m * k, m * k))
        for (c, d, i, j), s in zip(pairs, got[1 + m * k : -1]):
            for a, b in {(c * k + i, d * k + j), (c * k + j, d * k + i)}:
                info[a, b] = info[b, a] = s
        inverse = _solved(info)
        if got[0] - last < close * (1 + abs(got[0])) or step >= most:
            break
        beta, last, step = beta + (inverse @ gradient).reshape(m, k), got[0], step + 1
    one = np.eye(k)
    for i in range(k - 1):
        one[i, i] = 1 / spread[i]
        one[-1, i] = -mean[i] / spread[i]
    back = np.kron(np.eye(m), one)
    names = [f"{v}:{c}" for v in values[1:] for c in columns_names]
    return Fit(names, back @ beta.ravel(), back @ inverse @ back.T, int(got[-1]), math.inf, loglik=float(got[0]), steps=step)
