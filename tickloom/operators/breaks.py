"""Tests for structural breaks and bubbles.

The regressions of a series share running sums of products, so each window's
moments are a difference of two of them and all windows that end at one row are
solved in one batch. End rows are dealt over tasks, each with the whole (short)
series; the tests are quadratic in the length, which ``LONGEST`` bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.statistics import ols
from tickloom.operators.labeling import indexed
from tickloom.operators.ordered import Names, per_series

LONGEST = 20_000
PARTS = 16


def design(x: np.ndarray, constant: str, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Changes, and their regressors: the level before, ``lags`` changes before, and the terms of nc, c, ct or ctt."""
    d = np.diff(x)
    y = d[lags:]
    columns = [x[lags:-1], *(d[lags - i : len(d) - i] for i in range(1, lags + 1))]
    n = len(y)
    if constant != "nc":
        columns.append(np.ones(n))
    if constant[:2] == "ct":
        columns.append(np.arange(n, dtype=float))
    if constant == "ctt":
        columns.append(np.arange(n, dtype=float) ** 2)
    return y, np.column_stack(columns)


def adf_statistics(x: np.ndarray, min_sl: int, constant: str, lags: int, ends: np.ndarray) -> list[np.ndarray]:
    """For each end row, the t values of the level over all windows of at least ``min_sl`` rows that end there; NaN where not determined."""
    y, z = design(x - x.mean() if constant != "nc" else x, constant, lags)
    k = z.shape[1]
    outer = np.concatenate((np.zeros((1, k, k)), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)))
    cross = np.concatenate((np.zeros((1, k)), np.cumsum(z * y[:, None], axis=0)))
    square = np.concatenate(([0.0], np.cumsum(y * y)))
    out = []
    for end in ends:
        n = end - lags  # rows of the regression up to this end
        first = np.arange(0, n + lags - min_sl + 1)
        first = first[n - first >= k + 1]
        if n < 1 or not len(first):
            out.append(np.empty(0))
            continue
        xx, xy, yy = outer[n] - outer[first], cross[n] - cross[first], square[n] - square[first]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", xx), 1e-300))
        ss = xx / scale[:, :, None] / scale[:, None, :]
        good = np.linalg.cond(ss) < 1e12
        stat = np.full(len(first), np.nan)
        if good.any():
            inv = np.linalg.inv(ss[good]) / scale[good][:, :, None] / scale[good][:, None, :]
            b = np.einsum("nij,nj->ni", inv, xy[good])
            rss = np.maximum(yy[good] - np.einsum("ni,ni->n", b, xy[good]), 0)
            sd = np.sqrt(rss / (n - first[good] - k) * np.abs(inv[:, 0, 0]))
            stat[good] = np.divide(b[:, 0], sd, out=np.zeros(len(sd)), where=sd > 0)
        out.append(stat)
    return out


def over_ends(series: DataFrame, min_sl: int, constant: str, lags: int, keys: Names, column: str, summary, schema: str) -> DataFrame:
    """``summary`` of the statistics at each end row; the ends of a series are dealt into PARTS tasks of about equal work."""
    rows = series.select(*keys, "ts", F.col(column).cast("double").alias("x"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, part = pdf["x"].to_numpy(), int(pdf["part"].iloc[0])
        if len(x) > LONGEST:
            raise ValueError(f"a series of {len(x)} rows; the test is quadratic and takes up to {LONGEST}")
        ends = np.arange(min_sl, len(x))[part::PARTS]
        got = [summary(s) for s in adf_statistics(x, min_sl, constant, lags, ends)]
        return pd.DataFrame({"ts": pdf["ts"].to_numpy()[ends], **{c: [g[i] for g in got] for i, c in enumerate(x.split()[0] for x in schema.split(", "))}})

    return per_series(rows, [*keys, "part"], ["ts"], run, f"ts timestamp, {schema}").drop("part")


def sadf_test(series: DataFrame, min_sl: int, constant: str = "c", lags: int = 1, keys: Names = (), column: str = "log_p") -> DataFrame:
    """keys, ts, sadf: the largest statistic at each end row; windows that determine none are left out."""
    return over_ends(series, min_sl, constant, lags, keys, column, lambda s: (float(np.nanmax(s)) if np.isfinite(s).any() else None,), "sadf double")


def qadf_test(series: DataFrame, min_sl: int, q: float = 0.95, constant: str = "c", lags: int = 1, keys: Names = (), column: str = "log_p") -> DataFrame:
    """keys, ts, qadf: the q quantile of the statistics."""
    return over_ends(series, min_sl, constant, lags, keys, column, lambda s: (float(np.quantile(t, q)) if len(t := s[np.isfinite(s)]) else float("nan"),), "qadf double")


def cadf_test(series: DataFrame, min_sl: int, q: float = 0.95, constant: str = "c", lags: int = 1, keys: Names = (), column: str = "log_p") -> DataFrame:
    """keys, ts, cadf_mean, cadf_var: mean and variance of the statistics from the q quantile on."""

    def tail(s: np.ndarray) -> tuple[float, float]:
        t = s[np.isfinite(s)]
        if not len(t):
            return float("nan"), float("nan")
        t = t[t >= np.quantile(t, q)]
        return float(t.mean()), float(t.var())

    return over_ends(series, min_sl, constant, lags, keys, column, tail, "cadf_mean double, cadf_var double")


def chow_type_dickey_fuller(series: DataFrame, min_sl: int, constant: str = "c", lags: int = 1, keys: Names = (), column: str = "log_p") -> DataFrame:
    """keys, tau, dfc: t value of the level from each possible break on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, z = design(pdf["x"].to_numpy(), constant, lags)
        n, rows = len(y), []
        for tau in range(min_sl, n - min_sl):
            b, v = ols(y, np.column_stack([z, z[:, 0] * (np.arange(n) >= tau)]))
            sd = np.sqrt(abs(v[-1, -1]))
            if np.isfinite(b[-1]):
                rows.append((tau / n, float(b[-1] / sd) if sd > 0 else 0.0))
        return pd.DataFrame(rows, columns=["tau", "dfc"], dtype=float)

    return per_series(series.select(*keys, "ts", F.col(column).cast("double").alias("x")), keys, ["ts"], run, "tau double, dfc double")


def brown_durbin_evans_cusum(series: DataFrame, lags: int = 1, keys: Names = (), column: str = "close") -> DataFrame:
    """keys, step, s_t, upper, lower: running sum of standardised one-step errors of growing regressions, and its bounds.

    The first regression has two rows more than regressors, so that its errors are determined.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, z = design(pdf["x"].to_numpy(), "c", lags)
        k, errors = z.shape[1], []
        for t in range(k + 2, len(y)):
            b, v = ols(y[:t], z[:t])
            if np.isfinite(b).all():
                s2 = ((y[:t] - z[:t] @ b) ** 2).sum() / (t - k)
                errors.append((y[t] - z[t] @ b) / np.sqrt(s2 + z[t] @ v @ z[t]) if s2 > 0 else 0.0)
        e = np.array(errors)
        sd = e.std(ddof=1) if len(e) > 1 else 1.0
        s, t = np.cumsum(e / sd if sd > 0 else e), np.arange(1, len(e) + 1)
        bound = 0.948 * np.sqrt(len(e)) + 2 * 0.948 * t / max(len(e), 1)
        return pd.DataFrame({"step": t, "s_t": s, "upper": bound, "lower": -bound})

    return per_series(series.select(*keys, "ts", F.col(column).cast("double").alias("x")), keys, ["ts"], run, "step long, s_t double, upper double, lower double")


def chu_stinchcombe_white_cusum(series: DataFrame, critical_value: float = 4.6, keys: Names = (), column: str = "close") -> DataFrame:
    """keys, ts, s_t, critical: the largest departure of a level from an earlier one, in units of its deviation. Quadratic in the length: pairs of positions by series."""
    bars = indexed(series.select(*keys, "ts", F.col(column).alias("close")), keys)
    w = Window.partitionBy(*keys).orderBy("i")
    d = F.col("close") - F.lag("close").over(w)
    bars = bars.withColumn("__d2", F.coalesce(d * d, F.lit(0.0))).withColumn("var", F.sum("__d2").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("i"))
    before = bars.select(*keys, F.col("i").alias("s"), F.col("close").alias("c0"))
    on = F.col("i") > F.col("s")
    # Bars of a series are dealt into stretches of s, so that a series' pairs are spread over tasks.
    late = bars.where("i >= 2").withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("i") - 1) / 256))))
    pairs = late.join(before.withColumn("stretch", F.floor(F.col("s") / 256)), [*keys, "stretch"]).where(on)
    best = pairs.groupBy(*keys, "ts", "i", "var").agg(F.max((F.col("close") - F.col("c0")) / F.sqrt(F.col("i") - F.col("s"))).alias("m"))
    moved = F.col("var") > 0
    return best.select(*keys, "ts", F.when(moved, F.col("m") / F.sqrt("var")).otherwise(F.lit(0.0)).alias("s_t"), F.when(moved, critical_value + F.log(F.col("i").cast("double"))).otherwise(F.lit(float(critical_value))).alias("critical"))
