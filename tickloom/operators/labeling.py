"""Labels of events: volatility targets, barriers, fixed horizons, trends, meta-labels.

A path is a range of bar positions, so barrier and trend searches are joins of
events with bars on series and block of positions: an event meets only the
blocks that its path touches, whatever the length of the series.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.ordered import Names, need, over, per_series, position, whole

BLOCK = 64


def validate_close(close: DataFrame) -> None:
    need(close, "ts", "close")


def validate_t1(events: DataFrame) -> None:
    need(events, "t1")
    if not events.where("t1 IS NULL").isEmpty():
        raise ValueError("t1 has null values")


def daily_volatility(close: DataFrame, span: int = 100, keys: Names = ()) -> DataFrame:
    """keys, ts, volatility: exponentially weighted standard deviation of returns, bias corrected; null in the first row, 0 in the second."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf["close"].astype(float).pct_change()
        v = r.ewm(span=span).std()
        if len(v) > 1:
            v.iloc[1] = 0.0
        return pd.DataFrame({"ts": pdf["ts"], "volatility": v})

    return per_series(close.select(*keys, "ts", "close"), keys, ["ts"], fold, "ts timestamp, volatility double")


def indexed(close: DataFrame, keys: Names) -> DataFrame:
    """keys, ts, close, i (position) and last (that of the series' last bar)."""
    rows = close.select(*keys, "ts", F.col("close").cast("double").alias("close")).withColumn("i", position(keys, ["ts"]).cast("long"))
    return rows.withColumn("last", F.count(F.lit(1)).over(whole(keys)) - 1)


def located(events: DataFrame, bars: DataFrame, keys: Names, ts: str = "ts", name: str = "i", strict: bool = False) -> DataFrame:
    """Adds the position of the first bar at or after (``strict``: after) ``ts``; one past the last bar if there is none.

    Events and bars are merged in one ordered pass per series.
    """
    kinds = [(f.name, f.dataType) for f in events.schema if f.name not in keys]
    row = F.struct(*[F.col(k) for k, _ in kinds]).alias("row")
    # Of equal times, events come before bars (or after them if strict), as they look ahead.
    asked = events.select(*keys, F.col(ts).alias("at"), F.lit(2 if strict else 0).alias("kind"), row, F.lit(None).cast("long").alias("i"))
    there = bars.select(*keys, F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), "i")
    w = over(keys, ["at", "kind"]).rowsBetween(0, Window.unboundedFollowing)
    merged = asked.unionByName(there).withColumn("next", F.first("i", ignorenulls=True).over(w)).withColumn("n", F.count("i").over(whole(keys)))
    return merged.where("kind <> 1").select(*keys, "row.*", F.coalesce("next", "n").alias(name))


def add_vertical_barrier(events: DataFrame, close: DataFrame, num_bars: int, keys: Names = ()) -> DataFrame:
    """keys, ts, t1: the time ``num_bars`` bars after the first bar at or after the event, at most the last bar's."""
    bars = indexed(close, keys)
    at = located(events.select(*keys, "ts"), bars, keys).withColumnRenamed("i", "e")
    ends = bars.groupBy(*keys).agg(F.max("i").alias("last"))
    at = (at.join(ends, list(keys)) if keys else at.crossJoin(F.broadcast(ends))).withColumn("j", F.least(F.col("e") + num_bars, "last"))
    return at.join(bars.select(*keys, F.col("i").alias("j"), F.col("ts").alias("t1")), [*keys, "j"]).select(*keys, "ts", "t1")


def fixed_time_horizon(close: DataFrame, horizon: int, threshold: float, keys: Names = ()) -> DataFrame:
    """keys, ts, ret (to ``horizon`` bars ahead), label; the last bars have none and are left out."""
    ret = F.lead("close", horizon).over(over(keys, ["ts"])) / F.col("close") - 1
    rows = close.select(*keys, "ts", ret.alias("ret")).where("ret IS NOT NULL")
    return rows.withColumn("label", F.when(F.col("ret") > threshold, 1).when(F.col("ret") < -threshold, -1).otherwise(0).cast("tinyint"))


def blocks(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / BLOCK), F.floor(last / BLOCK)))


def paths(events: DataFrame, bars: DataFrame, keys: Names, first: str, last: str) -> DataFrame:
    """Each event with the bars at positions ``first`` to ``last``, joined by series and block of positions."""
    asked = events.where(F.col(last) >= F.col(first)).withColumn("block", blocks(F.col(first), F.col(last)))
    path = bars.select(*keys, F.col("i").alias("at"), F.col("ts").alias("at_ts"), F.col("close").alias("at_close"), F.floor(F.col("i") / BLOCK).alias("block"))
    return asked.join(path, [*keys, "block"]).where((F.col("at") >= F.col(first)) & (F.col("at") <= F.col(last))).drop("block")


def apply_pt_sl_on_t1(events: DataFrame, close: DataFrame, pt: float, sl: float, keys: Names = (), exact_vertical: bool = False) -> DataFrame:
    """Adds the times at which the path of an event first goes beyond a barrier: ``sl_ts`` below -sl * trgt, ``pt_ts`` above pt * trgt.

    events: keys, event_id, ts, t1, trgt, side. The path runs from the event's bar to the first bar after t1 (``exact_vertical``:
    to t1), at most the last bar; multipliers of 0 or less switch a barrier off; a path of one bar hits nothing.
    Also ``end_ts``, the path's last bar.
    """
    bars = indexed(close, keys)
    at = located(located(events, bars, keys, "ts", "e"), bars, keys, "t1", "z", strict=True)
    n = bars.groupBy(*keys).agg((F.max("i")).alias("last"))
    at = at.join(n, list(keys)) if keys else at.crossJoin(F.broadcast(n))
    stop = F.col("z") - 1 if exact_vertical else F.col("z")
    at = at.withColumn("z", F.least(stop, "last"))
    start = bars.select(*keys, F.col("i").alias("e"), F.col("close").alias("p0"))
    p = paths(at.join(start, [*keys, "e"]), bars, keys, "e", "z")
    r = (F.col("at_close") / F.col("p0") - 1) * F.col("side")
    hit = lambda on, cond: F.min(F.when(cond & (F.col("z") > F.col("e")), F.col("at_ts"))) if on > 0 else F.min(F.lit(None).cast("timestamp"))
    found = p.groupBy(*keys, "event_id").agg(hit(sl, r < -sl * F.col("trgt")).alias("sl_ts"), hit(pt, r > pt * F.col("trgt")).alias("pt_ts"), F.max("at_ts").alias("end_ts"))
    return events.join(found, [*keys, "event_id"], "left")


def get_events_meta(close: DataFrame, t_events: DataFrame, pt_sl: tuple[float, float], trgt: DataFrame, min_ret: float, t1: DataFrame | None = None, side: DataFrame | None = None, keys: Names = ()) -> DataFrame:
    """keys, event_id, ts, t1 (first barrier touched), trgt, side.

    Events need a volatility of over ``min_ret``. Without ``t1`` the path runs to the last bar. Without ``side``
    it is 1 and both barriers take the first multiplier.
    """
    on = [*keys, "ts"]
    rows = t_events.select(*on).withColumn("event_id", position(keys, ["ts"]).cast("long")).join(trgt.select(*on, F.col("volatility").alias("trgt")), on, "left").where(F.col("trgt") > min_ret)
    rows = rows.join(t1.select(*on, "t1"), on, "left") if t1 is not None else rows.withColumn("t1", F.lit(None).cast("timestamp"))
    end = close.groupBy(*keys).agg(F.max("ts").alias("end"))
    rows = rows.join(end, list(keys)) if keys else rows.crossJoin(F.broadcast(end))
    rows = rows.withColumn("t1", F.coalesce("t1", "end")).drop("end")
    rows = rows.join(side.select(*on, F.col("side").cast("double")), on, "left") if side is not None else rows.withColumn("side", F.lit(1.0))
    pt, sl = (pt_sl[0], pt_sl[1]) if side is not None else (pt_sl[0], pt_sl[0])
    out = apply_pt_sl_on_t1(rows, close, pt, sl, keys)
    return out.select(*keys, "event_id", "ts", F.least("t1", "sl_ts", "pt_ts").alias("t1"), "trgt", "side")


def get_events(close: DataFrame, t_events: DataFrame, pt_sl: float, trgt: DataFrame, min_ret: float, t1: DataFrame | None = None, keys: Names = ()) -> DataFrame:
    """keys, event_id, ts, t1, trgt with symmetric barriers."""
    return get_events_meta(close, t_events, (pt_sl, pt_sl), trgt, min_ret, t1, None, keys).drop("side")


def returned(events: DataFrame, close: DataFrame, keys: Names) -> DataFrame:
    at = lambda name, ts: close.select(*keys, F.col("ts").alias(ts), F.col("close").cast("double").alias(name))
    rows = events.join(at("p0", "ts"), [*keys, "ts"], "left").join(at("p1", "t1"), [*keys, "t1"], "left")
    return rows.withColumn("ret", F.try_divide("p1", "p0") - 1).drop("p0", "p1")


def get_bins(events: DataFrame, close: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, ts, t1, ret, label (sign of the return between the two times)."""
    return returned(events, close, keys).select(*keys, "ts", "t1", "ret", F.signum("ret").cast("tinyint").alias("label"))


def get_bins_meta(events: DataFrame, close: DataFrame, keys: Names = ()) -> DataFrame:
    """As get_bins; with ``side``, returns are taken in its direction and the label is 1 for gains and 0 otherwise."""
    rows = returned(events, close, keys)
    if "side" not in events.columns:
        return rows.select(*keys, "ts", "t1", "ret", F.signum("ret").cast("tinyint").alias("label"))
    rows = rows.withColumn("ret", F.col("ret") * F.col("side"))
    return rows.select(*keys, "ts", "t1", "ret", F.when(F.col("ret") > 0, 1).otherwise(0).cast("tinyint").alias("label"), "side")


def triple_barrier_labels(close: DataFrame, t_events: DataFrame, pt_sl: float, num_bars: int, vol_span: int = 100, min_ret: float = 0.0, keys: Names = ()) -> DataFrame:
    """keys, ts, t1, ret, label: volatility targets, vertical barriers, first touches and their signs."""
    trgt = daily_volatility(close, vol_span, keys)
    t1 = add_vertical_barrier(t_events, close, num_bars, keys)
    return get_bins(get_events(close, t_events, pt_sl, trgt, min_ret, t1, keys), close, keys)


def t_value(y: Column, x: Column) -> Column:
    """t value of the slope of y on x, as an aggregate."""
    slope, n = F.regr_slope(y, x), F.regr_count(y, x)
    rss = F.greatest(F.regr_syy(y, x) - slope * slope * F.regr_sxx(y, x), F.lit(0.0))
    return slope / F.sqrt(rss / (n - 2) / F.regr_sxx(y, x))


def t_value_linear_trend(close: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, t_value of the slope of close on position."""
    rows = indexed(close, keys)
    return rows.groupBy(*keys).agg(t_value(F.col("close"), F.col("i").cast("double")).alias("t_value"))


def trend_scanning_labels(close: DataFrame, t_events: DataFrame, horizons: list[int], keys: Names = ()) -> DataFrame:
    """keys, ts, t1, t_val, label: of the horizons, the one whose trend has the largest absolute t value (the first of equal ones).

    Events too close to the end for the longest horizon are left out.
    """
    bars = indexed(close, keys)
    at = located(t_events.select(*keys, "ts"), bars, keys, "ts", "e")
    n = bars.groupBy(*keys).agg((F.max("i") + 1).alias("n"))
    at = at.join(n, list(keys)) if keys else at.crossJoin(F.broadcast(n))
    at = at.where(F.col("e") + max(horizons) <= F.col("n")).withColumn("h", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    at = at.withColumn("z", F.col("e") + F.col("h")).where("z < n")
    p = paths(at, bars, keys, "e", "z")
    tv = p.groupBy(*keys, "ts", "h").agg(t_value(F.col("at_close"), (F.col("at") - F.col("e")).cast("double")).alias("t_val"), F.max("at_ts").alias("t1"))
    tv = tv.where("t_val IS NOT NULL AND NOT isnan(t_val)")
    best = tv.groupBy(*keys, "ts").agg(F.max_by(F.struct("t1", "t_val"), F.struct(F.abs("t_val"), -F.col("h"))).alias("b"))
    return best.where("b.t_val <> 0").select(*keys, "ts", "b.t1", "b.t_val", F.signum("b.t_val").cast("tinyint").alias("label"))

