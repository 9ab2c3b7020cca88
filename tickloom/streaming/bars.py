"""Bars and events of streams, by the rules that the batch operators use.

Ticks must be of type TIMESTAMP. Time bars are watermarked windows. The bars
that a rule closes keep, per series, the rule's state and the open bar's
figures; ticks of a micro-batch are folded in order of time and sequence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.bars import BAR, Rule, ohlcv
from tickloom.operators.ordered import Names
from tickloom.operators.sampling import Cusum

STATE = "rule array<double>, bar array<double>, last array<double>, bar_id long"


def time_bars(ticks: DataFrame, every: str, late: str, keys: Names = ()) -> DataFrame:
    """keys, ts and the figures of a bar once its window is past the watermark; later ticks are left out."""
    bars = ticks.withWatermark("ts", late).groupBy(*keys, F.window("ts", every).alias("w")).agg(*ohlcv()[1:])
    return bars.where("volume > 0").select(*keys, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "vwap")


def ruled_bars(ticks: DataFrame, rule: Callable[..., Rule], key: str) -> DataFrame:
    """key, bar_id and the figures of each bar that the rule closes. ``rule(state)`` gives a rule with the state, or a new one for None."""

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, bar, last, bar_id = state.get if state.exists else (None, [], [float("nan"), 1.0], 0)
        r, bar, (before, sign) = rule(list(kept) if kept is not None else None), list(bar), list(last)
        out = []
        ticks_ = pd.concat(list(batches)).sort_values(["ts", "seq"], kind="stable")
        for ts, price, volume in zip(ticks_["ts"], ticks_["price"].astype(float), ticks_["volume"].astype(float), strict=True):
            if before == before and price != before:
                sign = 1.0 if price > before else -1.0
            before = price
            if bar:
                bar = [bar[0], max(bar[1], price), min(bar[2], price), bar[3] + volume, bar[4] + price * volume]
            else:
                bar = [price, price, price, volume, price * volume]
            if r.closes(price, volume, sign):
                out.append((name[0], bar_id, ts, bar[0], bar[1], bar[2], price, bar[3], bar[4] / bar[3] if bar[3] > 0 else 0.0))
                bar, bar_id = [], bar_id + 1
        state.update((r.state, bar, [before, sign], bar_id))
        yield pd.DataFrame(out, columns=[key, "bar_id", "ts", "open", "high", "low", "close", "volume", "vwap"])

    schema = f"`{key}` {ticks.schema[key].dataType.simpleString()}, {BAR}"
    return ticks.select(key, "ts", "seq", "price", "volume").groupBy(key).applyInPandasWithState(fold, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def cusum_events(close: DataFrame, threshold: float, key: str) -> DataFrame:
    """key, ts at which the symmetric filter fires."""

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        c = Cusum(threshold, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        hit = [c.event(float(p)) for p in rows["close"]]
        state.update((c.state,))
        yield pd.DataFrame({key: name[0], "ts": rows.loc[hit, "ts"]})

    schema = f"`{key}` {close.schema[key].dataType.simpleString()}, ts timestamp"
    return close.select(key, "ts", "close").groupBy(key).applyInPandasWithState(fold, schema, "s array<double>", "append", GroupStateTimeout.NoTimeout)
