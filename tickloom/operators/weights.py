"""Weights of overlapping labels: concurrency, uniqueness, returns, decay, class balance, sequential bootstrap.

Labels are closed intervals [ts, t1] over the bars of a series. Counts are
running sums of starts and ends, and averages over an interval are differences
of running sums, so no label is joined with the bars it spans.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.labeling import indexed, located
from tickloom.operators.ordered import Names, over, whole


def spans(events: DataFrame, bars: DataFrame, keys: Names) -> DataFrame:
    """Adds e, the position of the first bar at or after ts, and z, that of the first bar after t1."""
    return located(located(events, bars, keys, "ts", "e"), bars, keys, "t1", "z", strict=True)


def running(of: Column, w) -> Column:
    return F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, 0))


def num_co_events(close: DataFrame, events: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, ts, num_co_events of the bars from the first start to the first bar after the last end."""
    bars = indexed(close, keys)
    at = spans(events.select(*keys, "ts", "t1"), bars, keys)
    steps = at.select(*keys, F.col("e").alias("i"), F.lit(1).alias("d")).unionByName(at.select(*keys, F.col("z").alias("i"), F.lit(-1).alias("d")))
    steps = steps.groupBy(*keys, "i").agg(F.sum("d").alias("d"))
    w = over(keys, ["i"])
    reach = at.groupBy(*keys).agg(F.min("e").alias("first"), F.max("z").alias("final"))
    rows = bars.join(steps, [*keys, "i"], "left").withColumn("num_co_events", running(F.coalesce("d", F.lit(0)), w).cast("double"))
    rows = rows.join(F.broadcast(reach), list(keys)) if keys else rows.crossJoin(F.broadcast(reach))
    return rows.where("i >= first AND i <= final").select(*keys, "ts", "num_co_events")


def summed_over_spans(close: DataFrame, events: DataFrame, counts: DataFrame, value: Column, keys: Names) -> DataFrame:
    """Adds to events (with event_id) total and n: the sum of ``value`` over the bars of the interval, and their number.

    ``value`` may use close, ret (log return, 0 in the first row) and num_co_events (0 where there is none).
    """
    w = over(keys, ["i"])
    bars = indexed(close, keys)
    rows = bars.join(counts, [*keys, "ts"], "left").withColumn("num_co_events", F.coalesce("num_co_events", F.lit(0.0)))
    rows = rows.withColumn("ret", F.coalesce(F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.0)))
    rows = rows.withColumn("sums", running(F.coalesce(value, F.lit(0.0)), w)).select(*keys, F.col("i").alias("at"), "sums")
    at = spans(events, bars, keys)
    before, until = rows.select(*keys, (F.col("at") + 1).alias("e"), F.col("sums").alias("a")), rows.select(*keys, (F.col("at") + 1).alias("z"), F.col("sums").alias("b"))
    both = at.join(before, [*keys, "e"], "left").join(until, [*keys, "z"], "left")
    return both.withColumn("n", F.col("z") - F.col("e")).withColumn("total", F.when(F.col("n") > 0, F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).otherwise(F.lit(0.0)))


def sample_tw(close: DataFrame, events: DataFrame, counts: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, ts, uniqueness: mean of one over the number of concurrent labels in the label's interval."""
    inverse = F.when(F.col("num_co_events") > 0, 1 / F.col("num_co_events")).otherwise(F.lit(0.0))
    rows = summed_over_spans(close, events.select(*keys, "ts", "t1"), counts, inverse, keys)
    return rows.select(*keys, "ts", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(0.0)).alias("uniqueness"))


def sample_w(close: DataFrame, events: DataFrame, counts: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, ts, weight: absolute sum of log returns over concurrent labels in the label's interval; a series' first return counts as 0."""
    value = F.when(F.col("num_co_events") > 0, F.col("ret") / F.col("num_co_events")).otherwise(F.lit(0.0))
    return summed_over_spans(close, events.select(*keys, "ts", "t1"), counts, value, keys).select(*keys, "ts", F.abs("total").alias("weight"))


def get_ind_matrix(close: DataFrame, events: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, i (bar), event_id: the ones of the matrix of bars by labels, as rows."""
    at = spans(events.select(*keys, "event_id", "ts", "t1"), indexed(close, keys), keys).where("z > e")
    return at.select(*keys, F.explode(F.sequence("e", F.col("z") - 1)).alias("i"), "event_id")


def get_avg_uniqueness(ones: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, event_id, uniqueness of the labels of a sparse indicator matrix."""
    rows = ones.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy(*keys, "i")))
    return rows.groupBy(*keys, "event_id").agg(F.avg(1 / F.col("c")).alias("uniqueness"))


def seq_bootstrap(starts: np.ndarray, ends: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Labels drawn one after the other, each in proportion to its average uniqueness given those drawn so far.

    Labels are [start, end) in bars; uniqueness comes from running sums, so a draw costs bars plus labels.
    """
    count = np.zeros(int(ends.max()) if len(ends) else 0)
    out = np.empty(draws, np.int64)
    length = np.maximum(ends - starts, 1)
    for k in range(draws):
        sums = np.concatenate(([0.0], np.cumsum(1 / (count + 1))))
        u = np.where(ends > starts, (sums[ends] - sums[starts]) / length, 0.0)
        out[k] = rng.choice(len(starts), p=u / u.sum())
        count[starts[out[k]] : ends[out[k]]] += 1
    return out


def seq_bootstraps(close: DataFrame, events: DataFrame, replicates: int, seed: int, draws: int | None = None, keys: Names = ()) -> DataFrame:
    """keys, replicate, draw, event_id: ``replicates`` sequential bootstraps per series, one task each, with seeds of their own."""
    at = spans(events.select(*keys, "event_id", "ts", "t1"), indexed(close, keys), keys)
    rows = at.select(*keys, "event_id", "e", "z").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        rng = np.random.default_rng([seed, int(pdf["replicate"].iloc[0])])
        got = seq_bootstrap(pdf["e"].to_numpy(), pdf["z"].to_numpy(), draws or len(pdf), rng)
        out = pd.DataFrame({"replicate": int(pdf["replicate"].iloc[0]), "draw": np.arange(len(got)), "event_id": pdf["event_id"].to_numpy()[got]})
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    schema = ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), "replicate long, draw long, event_id long"])
    return rows.groupBy(*keys, "replicate").applyInPandas(run, schema)


def get_time_decay(tw: DataFrame, last_weight: float = 1.0, keys: Names = ()) -> DataFrame:
    """keys, ts, weight: linear in the running uniqueness, 1 for the newest label, ``last_weight`` for the oldest; below 0, the oldest share gets none."""
    if last_weight <= -1:
        raise ValueError("last_weight must be over -1")
    u, total = running(F.col("uniqueness"), over(keys, ["ts"])), F.sum("uniqueness").over(whole(keys))
    slope = (1 - last_weight) / total if last_weight >= 0 else 1 / ((last_weight + 1) * total)
    weight = F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - slope * total + slope * u))
    return tw.select(*keys, "ts", weight.alias("weight"))


def drop_labels(events: DataFrame, min_pct: float = 0.05) -> DataFrame:
    """``events`` without rare labels: the rarest goes while its share is not over ``min_pct`` and more than one is left.

    Labels are counted once; there are few classes.
    """
    counts = {r["label"]: r["count"] for r in events.groupBy("label").count().collect()}
    gone = []
    while len(counts) > 1:
        rarest = min(counts, key=lambda k: (counts[k], str(k)))
        if counts[rarest] / sum(counts.values()) > min_pct:
            break
        gone.append(rarest)
        del counts[rarest]
    return events.where(~F.col("label").isin(gone)) if gone else events


def get_class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, weight: number of rows over number of classes times the class's rows."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return counts.select(label, (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"))

