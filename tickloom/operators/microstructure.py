"""Estimators from trades and bars: tick rule, spreads, volatility, price impact, flow toxicity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.operators.ordered import Names, over, rolling, with_tick_sign

DEN = 3 - 2 * math.sqrt(2)
K2 = math.sqrt(8 / math.pi)


def tick_rule(trades: DataFrame, keys: Names = (), order: Names = ("ts",), price: str = "price") -> DataFrame:
    """Adds sign, -1 or 1, as a byte."""
    return with_tick_sign(trades, keys, order, price).withColumn("sign", F.col("sign").cast("tinyint"))


def beta_gamma(bars: DataFrame, sl: int = 1, keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """Adds beta (mean over ``sl`` rows of two-row sums of squared log ranges) and gamma (squared log range of two rows)."""
    w = over(keys, order)
    rows = bars.withColumn("__hl", F.pow(F.log(F.col("high") / F.col("low")), 2))
    rows = rows.withColumn("__two", rolling("sum", F.col("__hl"), w, 2))
    rows = rows.withColumn("beta", rolling("mean", F.col("__two"), w, sl))
    wide = F.log(rolling("max", F.col("high"), w, 2) / rolling("min", F.col("low"), w, 2))
    return rows.withColumn("gamma", F.pow(wide, 2)).drop("__hl", "__two")


def at_least_zero(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def corwin_schultz_spread(bars: DataFrame, sl: int = 1, keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """Adds alpha and spread from high and low."""
    rows = beta_gamma(bars, sl, keys, order)
    alpha = F.lit(math.sqrt(2) - 1) * F.sqrt("beta") / F.lit(DEN) - F.sqrt(F.col("gamma") / F.lit(DEN))
    rows = rows.withColumn("alpha", at_least_zero(alpha))
    return rows.withColumn("spread", 2 * (F.exp("alpha") - 1) / (1 + F.exp("alpha"))).drop("beta", "gamma")


def becker_parkinson_volatility(bars: DataFrame, sl: int = 1, keys: Names = (), order: Names = ("ts",)) -> DataFrame:
    """Adds sigma from high and low."""
    rows = beta_gamma(bars, sl, keys, order)
    sigma = F.lit((2**-0.5 - 1)) * F.sqrt("beta") / F.lit(K2 * DEN) + F.sqrt(F.col("gamma") / F.lit(K2**2 * DEN))
    return rows.withColumn("sigma", at_least_zero(sigma)).drop("beta", "gamma")


def roll_model(trades: DataFrame, keys: Names = (), order: Names = ("ts",), price: str = "price") -> DataFrame:
    """keys, spread and noise_var from the first autocovariance of price changes."""
    w = over(keys, order)
    rows = trades.withColumn("__d", F.col(price) - F.lag(price).over(w))
    rows = rows.withColumn("__b", F.lag("__d").over(w))
    both = F.col("__b").isNotNull() & F.col("__d").isNotNull()
    cov = F.corr(F.when(both, F.col("__d")), F.when(both, F.col("__b"))) * F.var_samp("__d")
    out = rows.groupBy(*keys).agg(cov.alias("c"), F.var_samp("__d").alias("v"))
    return out.select(*keys, (2 * F.sqrt(F.greatest(F.lit(0.0), -F.col("c")))).alias("spread"), F.greatest(F.lit(0.0), F.col("v") + 2 * F.col("c")).alias("noise_var"))


def high_low_volatility(bars: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, volatility: Parkinson's estimate."""
    return bars.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.log(F.col("high") / F.col("low")), 2)) / F.lit(4 * math.log(2))).alias("volatility"))


def slope_and_t(y: Column, x: Column) -> tuple[Column, Column]:
    """Slope and its t value in a regression of y on x with a constant, as aggregates."""
    slope, n = F.regr_slope(y, x), F.regr_count(y, x)
    sxx, syy = F.regr_sxx(y, x), F.regr_syy(y, x)
    rss = F.greatest(syy - slope * slope * sxx, F.lit(0.0))
    se = F.sqrt(rss / F.greatest(n - 2, F.lit(1)) / F.greatest(sxx, F.lit(1e-10)))
    return slope, F.when(se > 0, slope / se).otherwise(F.lit(float("nan")))


def kyle_lambda(trades: DataFrame, keys: Names = (), order: Names = ("ts",), price: str = "price", volume: str = "volume", sign: str = "sign") -> DataFrame:
    """keys, kyle_lambda, t_value: price changes on signed volume."""
    rows = trades.withColumn("__y", F.col(price) - F.lag(price).over(over(keys, order))).withColumn("__x", F.col(sign) * F.col(volume))
    slope, t = slope_and_t(F.col("__y"), F.col("__x"))
    return rows.groupBy(*keys).agg(slope.alias("kyle_lambda"), t.alias("t_value"))


def hasbrouck_lambda(trades: DataFrame, keys: Names = (), order: Names = ("ts",), price: str = "price", money: str = "dollar_volume", sign: str = "sign") -> DataFrame:
    """keys, hasbrouck_lambda, t_value: log price changes on the signed root of the money traded."""
    rows = trades.withColumn("__y", F.log(F.col(price) / F.lag(price).over(over(keys, order)))).withColumn("__x", F.col(sign) * F.sqrt(money))
    slope, t = slope_and_t(F.col("__y"), F.col("__x"))
    return rows.groupBy(*keys).agg(slope.alias("hasbrouck_lambda"), t.alias("t_value"))


def amihud_lambda(trades: DataFrame, keys: Names = (), order: Names = ("ts",), price: str = "price", money: str = "dollar_volume") -> DataFrame:
    """keys, amihud_lambda: mean absolute log return per money traded; 0 without such rows."""
    rows = trades.withColumn("__r", F.abs(F.log(F.col(price) / F.lag(price).over(over(keys, order)))))
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col(money) > 0, F.col("__r") / F.col(money))), F.lit(0.0)).alias("amihud_lambda"))


def volume_bucket(trades: DataFrame, bucket_size: float, keys: Names = (), order: Names = ("ts",), price: str = "price", volume: str = "volume") -> DataFrame:
    """keys, bucket, buy_volume, sell_volume of full buckets of equal volume; a trade is split where it crosses buckets.

    Each trade takes a stretch of the running volume, and is cut at the multiples of the size: no fold is needed.
    """
    w = over(keys, order)
    rows = with_tick_sign(trades, keys, order, price).where(F.col(volume) > 0)
    rows = rows.withColumn("__end", F.sum(F.col(volume).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__start", F.col("__end") - F.col(volume))
    size = F.lit(float(bucket_size))
    first, last = F.floor(F.col("__start") / size), F.ceil(F.col("__end") / size) - 1
    each = rows.select(*keys, "sign", "__start", "__end", F.explode(F.sequence(first.cast("long"), F.greatest(first, last).cast("long"))).alias("bucket"))
    part = F.least("__end", (F.col("bucket") + 1) * size) - F.greatest("__start", F.col("bucket") * size)
    side = lambda s: F.coalesce(F.sum(F.when(F.col("sign") == s, part)), F.lit(0.0))
    out = each.groupBy(*keys, "bucket").agg(side(1).alias("buy_volume"), side(-1).alias("sell_volume"))
    return out.where(F.col("buy_volume") + F.col("sell_volume") >= size * (1 - 1e-9))


def vpin(trades: DataFrame, bucket_size: float, n_buckets: int = 50, keys: Names = (), order: Names = ("ts",), price: str = "price", volume: str = "volume") -> DataFrame:
    """keys, bucket, vpin: share of imbalanced volume over the last ``n_buckets``; null before there are as many."""
    buckets = volume_bucket(trades, bucket_size, keys, order, price, volume).withColumn("__d", F.abs(F.col("buy_volume") - F.col("sell_volume")))
    total = rolling("sum", F.col("__d"), over(keys, ["bucket"]), n_buckets)
    return buckets.withColumn("vpin", total / F.lit(n_buckets * float(bucket_size))).drop("__d")
