"""Rolled futures series and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.ordered import Names, over, whole


def roll_gaps(df: DataFrame, instrument: str = "instrument", open_col: str = "open", close_col: str = "close", match_end: bool = True, keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """``df`` with ``gap``: the running sum of open minus last close where an instrument is seen first; ``match_end`` makes the last gap 0."""
    w = over(keys, order)
    first = (F.row_number().over(over([*keys, instrument], order)) == 1) & (F.row_number().over(w) > 1)
    jump = F.when(first, F.col(open_col) - F.lag(close_col).over(w)).otherwise(F.lit(0.0))
    rows = df.withColumn("__jump", jump).withColumn("gap", F.sum("__jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if match_end:
        rows = rows.withColumn("gap", F.col("gap") - F.sum("__jump").over(whole(keys)))
    return rows.drop("__jump")


def roll_and_rebase(df: DataFrame, instrument: str = "instrument", open_col: str = "open", close_col: str = "close", keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """Adds rolled_open, rolled_close, returns (changes of the rolled close over the raw one before) and r_prices (their product; null in the first row)."""
    w = over(keys, order)
    rows = roll_gaps(df, instrument, open_col, close_col, True, keys, order)
    rows = rows.withColumn("rolled_open", F.col(open_col) - F.col("gap")).withColumn("rolled_close", F.col(close_col) - F.col("gap"))
    rows = rows.withColumn("returns", F.try_divide(F.col("rolled_close") - F.lag("rolled_close").over(w), F.lag(close_col).over(w)))
    product = F.product(1 + F.col("returns")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("r_prices", F.when(F.col("returns").isNotNull(), product))


def etf_trick(prices: DataFrame, weights: DataFrame, assets: Names, keys: Names = (), ts: str = "ts") -> DataFrame:
    """keys, ts, value: what one unit is worth if split by the weights of the first time and held."""
    long = lambda df, name: df.unpivot([*keys, ts], list(assets), "asset", name)
    both = long(prices, "price").join(long(weights, "weight"), [*keys, ts, "asset"])
    w = over([*keys, "asset"], [ts])
    both = both.withColumn("p0", F.first("price").over(w)).withColumn("w0", F.first("weight").over(w))
    total = F.sum(F.abs("w0")).over(whole([*keys, ts]))
    held = both.withColumn("gain", F.col("w0") / (F.col("p0") * total) * (F.col("price") - F.col("p0")))
    return held.groupBy(*keys, ts).agg((1 + F.sum("gain")).alias("value"))
