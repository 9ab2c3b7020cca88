"""Distributions and tests that neither Spark nor numpy has, on numpy and the standard library; and their column forms."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = NormalDist()
EULER = 0.5772156649015329


def phi(x: np.ndarray) -> np.ndarray:
    """Normal distribution function."""
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) if v == v else math.nan for v in np.ravel(x)]).reshape(np.shape(x))


#: Numerator and denominator, highest power first, of Hart's rational form of the normal tail below 5 * sqrt(2).
HART = (
    (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376),
    (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752),
)


def phi_column(x: Column) -> Column:
    """Normal distribution function of a column, without Python: a rational form near the middle, a continued fraction beyond."""

    def of(v: Column) -> Column:
        z = F.least(F.abs(v), F.lit(37.0))
        top, bottom = (reduce(lambda out, c: out * z + c, row[1:], F.lit(row[0])) for row in HART)
        far = reduce(lambda out, k: z + k / out, (4, 3, 2, 1), z + 0.65) * math.sqrt(2 * math.pi)
        tail = F.exp(-z * z / 2) * F.when(z < 7.07106781186547, top / bottom).otherwise(1 / far)
        return F.when(F.isnan(v), v).when(v > 0, 1 - tail).when(v <= 0, tail)  # of null, null

    return F.transform(F.array(x), of)[0]  # the argument is computed once, however long its expression is


def phi_inverse_column(p: Column) -> Column:
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: NORMAL.inv_cdf(x) if x == x and 0 < x < 1 else math.nan)

    return run(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t < 0 else 1 - tail


#: MacKinnon's (1994, 2010) response surface for the Dickey-Fuller test with a constant, one variable.
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRIT_5 = (-2.86154, -2.8903, -4.234, -40.040)


def adf_p_value(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    terms = ADF_SMALL_P if stat <= ADF_STAR else ADF_LARGE_P
    return NORMAL.cdf(sum(c * stat**i for i, c in enumerate(terms)))


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and their covariance; NaN where the regressors do not determine them."""
    n, k = x.shape
    xx = x.T @ x
    if n <= k or np.linalg.matrix_rank(xx) < k:
        return np.full(k, np.nan), np.full((k, k), np.nan)
    inv = np.linalg.inv(xx)
    b = inv @ (x.T @ y)
    e = y - x @ b
    return b, e @ e / (n - k) * inv


def adf(x: np.ndarray, lags: int = 1) -> tuple[float, float, int, float]:
    """(statistic, p value, observations, 5 % critical value) of the augmented Dickey-Fuller test with a constant."""
    d = np.diff(x)
    y = d[lags:]
    columns = [x[lags:-1], *(d[lags - i : len(d) - i] for i in range(1, lags + 1)), np.ones(len(y))]
    b, v = ols(y, np.column_stack(columns))
    stat = float(b[0] / math.sqrt(v[0, 0]))
    n = len(y)
    return stat, adf_p_value(stat), n, sum(c / n**i for i, c in enumerate(ADF_CRIT_5))


def bounded_minimum(f, low: float, high: float, tolerance: float = 1e-8) -> float:
    """Place of the minimum of a function with one minimum, by golden sections after a coarse grid."""
    grid = np.linspace(low, high, 65)
    k = int(np.argmin([f(g) for g in grid]))
    a, b = grid[max(k - 1, 0)], grid[min(k + 1, 64)]
    ratio = (math.sqrt(5) - 1) / 2
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    while b - a > tolerance:
        if f(c) < f(d):
            b, d = d, c
            c = b - ratio * (b - a)
        else:
            a, c = c, d
            d = a + ratio * (b - a)
    return float((a + b) / 2)
