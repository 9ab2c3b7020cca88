"""Fractional differentiation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.statistics import adf
from tickloom.operators.ordered import Names, per_series

LONGEST = 10_000
DIRECT = 4096  # rows up to which sums are taken one by one; the same sums by transforms beyond


def get_weights(d: float, size: int) -> np.ndarray:
    """The first ``size`` binomial weights, oldest first."""
    k = np.arange(1, size)
    return np.concatenate(([1.0], np.cumprod(-(d - k + 1) / k)))[::-1]


def get_weights_ffd(d: float, thres: float = 1e-5, longest: int = LONGEST) -> np.ndarray:
    """The weights of at least ``thres`` in size, oldest first; an error if there are more than ``longest``. A ``thres`` of 0 asks for ``longest`` weights."""
    w = get_weights(d, longest + 1)[::-1]
    small = np.flatnonzero(np.abs(w) < thres)
    if not thres:
        return w[:longest][::-1]
    if not len(small):
        raise ValueError(f"more than {longest} weights reach {thres}; raise longest or thres")
    return w[: small[0]][::-1]


def frac_diff(series: DataFrame, d: float, thres: float = 0.01, column: str = "close", keys: Names = ()) -> DataFrame:
    """keys, ts, value: with weights over all rows so far; rows whose weights leave out more than ``thres`` of the total are skipped, and so are rows from the first one without a finite value on, which have no sum."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[column].to_numpy(float)
        n, odd = len(x), np.flatnonzero(~np.isfinite(x))
        x = x[: odd[0]] if len(odd) else x
        w = get_weights(d, n)[::-1]  # newest first
        share = np.cumsum(np.abs(w[::-1]))
        skip = int((share / share[-1] > thres).sum()) if n else 0
        m, size = len(x), 1 << (2 * n).bit_length()
        if n > DIRECT:
            values = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(w, size), size)[:m]
        else:
            values = np.convolve(x, w)[:m] if m else x
        return pd.DataFrame({"ts": pdf["ts"].iloc[min(skip, m) : m], "value": values[min(skip, m) :]})

    return per_series(series.select(*keys, "ts", column), keys, ["ts"], fold, "ts timestamp, value double")


def ffd(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Dot products of the weights (oldest first) with every full window."""
    return np.convolve(x, w[::-1], "valid") if len(x) >= len(w) else np.empty(0)


def frac_diff_ffd(series: DataFrame, d: float, thres: float = 1e-5, column: str = "close", keys: Names = (), longest: int = LONGEST) -> DataFrame:
    """keys, ts, value: with a window of fixed width; rows without a full window are left out."""
    w = get_weights_ffd(d, thres, longest)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        v = ffd(pdf[column].to_numpy(float), w)
        out = pd.DataFrame({"ts": pdf["ts"].iloc[len(w) - 1 :] if len(v) else pdf["ts"].iloc[:0], "value": v})
        return out[np.isfinite(out["value"])]

    return per_series(series.select(*keys, "ts", column), keys, ["ts"], fold, "ts timestamp, value double")


def min_ffd(series: DataFrame, d_values: list[float], thres: float = 0.01, column: str = "close", keys: Names = ()) -> DataFrame:
    """keys, d, corr, adf_stat, p_value, lags, n_obs, crit_5: for each d, how stationary the series gets and how much of it is kept. One task per series and d."""
    rows = series.select(*keys, "ts", F.col(column).cast("double").alias("x")).withColumn("d", F.explode(F.array(*[F.lit(float(d)) for d in d_values])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        v = ffd(x, get_weights_ffd(float(pdf["d"].iloc[0]), thres))
        if len(v) < 20:
            return pd.DataFrame({"corr": [], "adf_stat": [], "p_value": [], "lags": [], "n_obs": [], "crit_5": []}, dtype=float)
        stat, p, n, crit = adf(v, 1)
        return pd.DataFrame({"corr": [np.corrcoef(x[-len(v) :], v)[0, 1]], "adf_stat": [stat], "p_value": [p], "lags": [1], "n_obs": [n], "crit_5": [crit]})

    return per_series(rows, [*keys, "d"], ["ts"], run, "corr double, adf_stat double, p_value double, lags long, n_obs long, crit_5 double")


def weight_decay(spark: SparkSession, d_range: tuple[float, float], n_plots: int, size: int) -> DataFrame:
    """d, k, weight: the weights of ``n_plots`` orders between two, for a chart of their decay."""
    rows = [(float(d), k, float(w)) for d in np.linspace(*d_range, n_plots) for k, w in enumerate(get_weights(d, size)[::-1])]
    return spark.createDataFrame(rows, "d double, k long, weight double")

