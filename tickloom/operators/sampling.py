"""Choosing rows of series: events of a cumulative sum, every n-th row, random rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import Names, per_series, position, whole


class Cusum:
    """Symmetric filter on price changes: says whether the sum of rises or falls since the last event is beyond the threshold."""

    def __init__(self, threshold: float, state=None) -> None:
        self.threshold, self.state = threshold, list(state or [0.0, 0.0, float("nan")])

    def event(self, price: float) -> bool:
        up, down, before = self.state
        if before != before:
            self.state[2] = price
            return False
        up, down = max(0.0, up + price - before), min(0.0, down + price - before)
        fell, rose = down < -self.threshold, up > self.threshold
        if fell:
            down = 0.0
        elif rose:
            up = 0.0
        self.state = [up, down, price]
        return fell or rose


def get_t_events(close: DataFrame, threshold: float, keys: Names = (), order: Names = ("ts",), price: str = "close") -> DataFrame:
    """keys, ts of the rows where the filter fires; a fall is tested first and only the side that fires starts anew."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Cusum(threshold)
        hit = [c.event(p) for p in pdf[price].tolist()]
        return pdf.loc[hit, ["ts"]]

    return per_series(close.select(*dict.fromkeys([*keys, *order, "ts", price])), keys, order, fold, "ts timestamp")


def sampling_linspace(df: DataFrame, num_samples: int | None = None, step: int | None = None, keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """Every k-th row from the first; k is ``step``, or the number of rows over ``num_samples``."""
    if step is None and num_samples is None:
        raise ValueError("num_samples or step is needed")
    rows = df.withColumn("__at", position(keys, order))
    k = F.lit(step) if step is not None else F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole(keys)) / num_samples))
    return rows.withColumn("__k", k).where("__at % __k = 0").drop("__at", "__k")


def sampling_uniform(df: DataFrame, num_samples: int, seed: int, order: Names = ("ts",)) -> DataFrame:
    """``num_samples`` rows of one series without replacement, in order: the rows that numpy's generator draws for this seed."""
    n = df.count()
    drawn = np.sort(np.random.default_rng(seed).choice(n, min(num_samples, n), replace=False))
    picked = df.sparkSession.createDataFrame([(int(i),) for i in drawn], "__at long")
    return df.withColumn("__at", position((), order).cast("long")).join(F.broadcast(picked), "__at", "left_semi").drop("__at")


def sampling_random(df: DataFrame, num_samples: int, seed: int) -> DataFrame:
    """``num_samples`` random rows without ordering the table: a top-k of random numbers."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(num_samples).drop("__r")
