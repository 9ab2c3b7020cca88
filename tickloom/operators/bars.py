"""Bars of ticks: by time, count, volume, money, imbalance and runs.

Input: keys, ``ts``, ``seq`` (order among equal times), ``price``, ``volume``.
Output: keys, ``bar_id``, ``ts``, open, high, low, close, volume, vwap. Time and
count bars are plain aggregations. The others close where a running state says
so; their rules (``Rule``) are small folds that batch and streaming share.
Bars that the data leave unfinished are not emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import Names, need, per_batch, position

ORDER = ("ts", "seq")
BAR = "bar_id long, ts timestamp, open double, high double, low double, close double, volume double, vwap double"


def ohlcv(price: str = "price", volume: str = "volume") -> list[Column]:
    """Aggregates of the ticks of one bar; ties in time are ordered by seq."""
    at, v = F.struct("ts", "seq"), F.sum(volume)
    return [
        F.max("ts").alias("ts"),
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        v.alias("volume"),
        F.when(v > 0, F.sum(F.col(price) * F.col(volume)) / v).otherwise(F.lit(0.0)).alias("vwap"),
    ]


def time_bars(ticks: DataFrame, every: str, keys: Names = ()) -> DataFrame:
    """One bar per tumbling window with volume, labelled by the window's start. ``every``: a Spark interval, or ``1 month``."""
    need(ticks, *keys, "ts", "seq", "price", "volume")
    if "month" in every:
        start = F.date_trunc("month", "ts")
    elif "week" in every:
        start = F.window("ts", every, every, "4 days").start  # weeks begin on Mondays, the epoch was a Thursday
    else:
        start = F.window("ts", every).start
    bars = ticks.groupBy(*keys, start.alias("start")).agg(*ohlcv()).drop("ts").withColumnRenamed("start", "ts")
    return bars.where("volume > 0").select(*keys, "ts", "open", "high", "low", "close", "volume", "vwap")


def tick_bars(ticks: DataFrame, threshold: int, keys: Names = ()) -> DataFrame:
    """One bar per ``threshold`` ticks."""
    need(ticks, *keys, "ts", "seq", "price", "volume")
    dealt = ticks.withColumn("bar_id", F.floor(position(keys, ORDER) / threshold))
    return dealt.groupBy(*keys, "bar_id").agg(F.count(F.lit(1)).alias("n"), *ohlcv()).where(F.col("n") == threshold).drop("n")


class Rule:
    """Says of one tick after the other whether a bar closes with it. ``state`` is what carries over, as floats."""

    def __init__(self, state: Iterable[float] | None = None) -> None:
        if state is not None:
            self.state = list(state)

    def closes(self, price: float, volume: float, sign: float) -> bool:
        raise NotImplementedError


class Sum(Rule):
    """Closes once the measure's sum reaches the threshold; what exceeds it is forgotten."""

    def __init__(self, threshold: float, measure: str, state=None) -> None:
        self.threshold, self.money, self.state = threshold, measure == "money", [0.0]
        super().__init__(state)

    def closes(self, price, volume, sign):
        total = self.state[0] + (price * volume if self.money else volume)
        done = total >= self.threshold
        self.state[0] = 0.0 if done else total
        return done


class Imbalance(Rule):
    """Closes once the signed sum is beyond what the moving averages of bar length and signed measure per tick lead one to expect."""

    def __init__(self, measure: str, expected_ticks: float = 100, span: int = 20, state=None) -> None:
        self.of = {"ticks": lambda p, v: 1.0, "volume": lambda p, v: v, "money": lambda p, v: p * v}[measure]
        self.alpha, self.state = 2.0 / (span + 1), [0.0, 0.0, float(expected_ticks), 0.0]
        super().__init__(state)

    def closes(self, price, volume, sign):
        total, n, length, each = self.state
        total, n = total + sign * self.of(price, volume), n + 1
        done = abs(total) >= max(abs(length * each), 1.0)
        if done:
            a = self.alpha
            length, each = a * n + (1 - a) * length, a * (total / n) + (1 - a) * each
            total = n = 0.0
        self.state = [total, n, length, each]
        return done


class TickRuns(Rule):
    """Closes once buys or sells number more than the moving averages of bar length and share of buys lead one to expect."""

    def __init__(self, expected_ticks: float = 100, span: int = 20, state=None) -> None:
        self.alpha, self.state = 2.0 / (span + 1), [0.0, 0.0, float(expected_ticks), 0.5]
        super().__init__(state)

    def closes(self, price, volume, sign):
        n, buys, length, share = self.state
        n, buys = n + 1, buys + (sign > 0)
        done = max(buys, n - buys) >= max(length * max(share, 1 - share), 1.0)
        if done:
            a = self.alpha
            length, share = a * n + (1 - a) * length, a * (buys / n) + (1 - a) * share
            n = buys = 0.0
        self.state = [n, buys, length, share]
        return done


class Runs(Rule):
    """As TickRuns, on the volume or money of buys and sells; the average of a side moves only with bars that have it."""

    def __init__(self, measure: str, expected_ticks: float = 100, span: int = 20, state=None) -> None:
        self.money, self.alpha = measure == "money", 2.0 / (span + 1)
        self.state = [0.0, 0.0, 0.0, 0.0, float(expected_ticks), 0.5, 1.0, 1.0]
        super().__init__(state)

    def closes(self, price, volume, sign):
        bought, sold, n, buys, length, share, per_buy, per_sell = self.state
        x, n = price * volume if self.money else volume, n + 1
        if sign > 0:
            bought, buys = bought + x, buys + 1
        else:
            sold += x
        done = max(bought, sold) >= max(length * max(share * per_buy, (1 - share) * per_sell), 1.0)
        if done:
            a, sells = self.alpha, n - buys
            length, share = a * n + (1 - a) * length, a * (buys / n) + (1 - a) * share
            per_buy = a * (bought / buys) + (1 - a) * per_buy if buys else per_buy
            per_sell = a * (sold / sells) + (1 - a) * per_sell if sells else per_sell
            bought = sold = n = buys = 0.0
        self.state = [bought, sold, n, buys, length, share, per_buy, per_sell]
        return done


class Fold:
    """Bars of the ticks of one series, batch by batch: keeps the rule, the open bar's figures, the last price and its sign."""

    def __init__(self, rule: Rule) -> None:
        self.closes, self.bar, self.bar_id, self.before, self.sign = rule.closes, None, 0, np.nan, 1.0

    def signs(self, price: np.ndarray) -> np.ndarray:
        """The sign of the last price change that was not zero; 1 before any."""
        step = np.sign(np.diff(price, prepend=self.before))
        moved = np.maximum.accumulate(np.where(np.abs(step) > 0, np.arange(len(step)), -1))
        sign = np.where(moved >= 0, step[moved], self.sign)
        self.before, self.sign = price[-1], sign[-1]
        return sign

    def __call__(self, pdf: pd.DataFrame) -> pd.DataFrame:
        p, v = pdf["price"].to_numpy(float), pdf["volume"].to_numpy(float)
        ends = np.array([i for i, x in enumerate(zip(p.tolist(), v.tolist(), self.signs(p).tolist(), strict=True)) if self.closes(*x)], np.int64)
        first, n = np.concatenate(([0], ends + 1)), len(ends)
        first = first[first < len(p)]
        figures = np.stack([p[first], np.maximum.reduceat(p, first), np.minimum.reduceat(p, first), np.add.reduceat(v, first), np.add.reduceat(p * v, first)])
        if self.bar is not None:
            (open_, high, low, volume, money), now = self.bar, figures[:, 0]
            figures[:, 0] = open_, np.maximum(high, now[1]), np.minimum(low, now[2]), volume + now[3], money + now[4]
        self.bar = figures[:, n].copy() if n < len(first) else None
        open_, high, low, volume, money = figures[:, :n]
        vwap = np.divide(money, volume, out=np.zeros(n), where=volume > 0)
        ids, self.bar_id = np.arange(self.bar_id, self.bar_id + n), self.bar_id + n
        return pd.DataFrame({"bar_id": ids, "ts": pdf["ts"].to_numpy()[ends], "open": open_, "high": high, "low": low, "close": p[ends], "volume": volume, "vwap": vwap})


def ruled_bars(ticks: DataFrame, rule: Callable[[], Rule], keys: Names = ()) -> DataFrame:
    """Bars that a rule closes, folded along each series; only finished bars leave the fold."""
    need(ticks, *keys, "ts", "seq", "price", "volume")
    rows = ticks.select(*keys, "ts", "seq", F.col("price").cast("double"), F.col("volume").cast("double"))
    return per_batch(rows, keys, ORDER, lambda: Fold(rule()), BAR)


def volume_bars(ticks: DataFrame, threshold: float, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: Sum(threshold, "volume"), keys)


def dollar_bars(ticks: DataFrame, threshold: float, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: Sum(threshold, "money"), keys)


def tick_imbalance_bars(ticks: DataFrame, expected_ticks: float = 100, span: int = 20, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: Imbalance("ticks", expected_ticks, span), keys)


def volume_imbalance_bars(ticks: DataFrame, expected_ticks: float = 100, span: int = 20, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: Imbalance("volume", expected_ticks, span), keys)


def dollar_imbalance_bars(ticks: DataFrame, expected_ticks: float = 100, span: int = 20, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: Imbalance("money", expected_ticks, span), keys)


def tick_runs_bars(ticks: DataFrame, expected_ticks: float = 100, span: int = 20, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: TickRuns(expected_ticks, span), keys)


def volume_runs_bars(ticks: DataFrame, expected_ticks: float = 100, span: int = 20, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: Runs("volume", expected_ticks, span), keys)


def dollar_runs_bars(ticks: DataFrame, expected_ticks: float = 100, span: int = 20, keys: Names = ()) -> DataFrame:
    return ruled_bars(ticks, lambda: Runs("money", expected_ticks, span), keys)
