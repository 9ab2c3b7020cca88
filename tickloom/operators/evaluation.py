"""Evaluation of strategies: Sharpe ratios, drawdowns, concentration, bets, overfitting, optimal rules."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.functions.scalars import Value, bin_hr, col, discrete_signal
from tickloom.functions.statistics import EULER, NORMAL, phi_column, t_cdf
from tickloom.operators.ordered import Names, over, per_series, position, whole

DAY = 86_400.0


def sharpe(value: Value, periods: float = 1.0) -> Column:
    """Aggregate: mean over deviation, by the root of the periods; 0 where the deviation is 0 or undefined."""
    sd = F.stddev_samp(col(value))
    return F.when(sd > 0, F.avg(col(value)) / sd * math.sqrt(periods)).otherwise(F.lit(0.0))


def sharpe_ratio(returns: DataFrame, periods: float = 252.0, keys: Names = (), value: str = "ret") -> DataFrame:
    return returns.groupBy(*keys).agg(sharpe(value, periods).alias("sharpe"))


def sharpe_ratio_non_annualized(returns: DataFrame, keys: Names = (), value: str = "ret") -> DataFrame:
    return sharpe_ratio(returns, 1.0, keys, value)


def psr_z(sr: Value, benchmark: Value, n: Value, skew: Value, kurtosis: Value) -> Column:
    """The number whose normal distribution function is the probabilistic Sharpe ratio."""
    s = col(sr)
    return (s - col(benchmark)) * F.sqrt(col(n) - 1) / F.sqrt(1 - col(skew) * s + (col(kurtosis) - 1) / 4 * s * s)


def probabilistic_sharpe_ratio(sr: Value, benchmark: Value = 0.0, n: Value = 252, skew: Value = 0.0, kurtosis: Value = 3.0) -> Column:
    return phi_column(psr_z(sr, benchmark, n, skew, kurtosis))


def expected_max_sharpe(estimates: list[float]) -> float:
    """What the best of as many Sharpe ratios without skill, as spread as these, leads one to expect."""
    n = len(estimates)
    if n < 2:
        return 0.0
    sd = float(np.std(estimates, ddof=1))
    return sd * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / n) + EULER * NORMAL.inv_cdf(1 - 1 / (n * math.e)))


def deflated_sharpe_ratio(sr: float, estimates: list[float], n: int = 252, skew: float = 0.0, kurtosis: float = 3.0) -> float:
    d = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return NORMAL.cdf((sr - expected_max_sharpe(estimates)) * math.sqrt(n - 1) / math.sqrt(d))


def drawdown(series: DataFrame, dollars: bool = False, keys: Names = (), value: str = "pnl") -> DataFrame:
    """keys, ts, drawdown below the running high, in money or as a share of it (0 where the high is not positive)."""
    high = F.max(value).over(over(keys, ["ts"]).rowsBetween(Window.unboundedPreceding, 0))
    dd = high - F.col(value) if dollars else F.when(high > 0, 1 - F.col(value) / high).otherwise(F.lit(0.0))
    return series.select(*keys, "ts", dd.alias("drawdown"))


def time_under_water(series: DataFrame, keys: Names = (), value: str = "pnl") -> DataFrame:
    """keys, peak_ts, recovery_ts, tuw_days of each stretch below a high: from the row before it to the row after it, or the last one."""
    w = over(keys, ["ts"])
    rows = series.withColumn("__i", position(keys, ["ts"])).withColumn("__n", F.count(F.lit(1)).over(whole(keys)))
    rows = rows.withColumn("__under", F.col(value) < F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__new", F.when(F.col("__under") & ~F.coalesce(F.lag("__under").over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("__before", F.lag("ts").over(w)).withColumn("__after", F.lead("ts").over(w)).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("__i")
    out = rows.where("__under").groupBy(*keys, "__g").agg(F.min_by("__before", at).alias("peak_ts"), F.coalesce(F.max_by("__after", at), F.max("ts")).alias("recovery_ts"))
    days = (F.unix_micros("recovery_ts") - F.unix_micros("peak_ts")) / (DAY * 1e6)
    return out.select(*keys, "peak_ts", "recovery_ts", days.alias("tuw_days"))


def hhi(value: Column) -> Column:
    """Aggregate: normalised concentration of absolute values; NaN for two or fewer, or a sum of 0."""
    n, total, squares = F.count(value), F.sum(F.abs(value)), F.sum(value * value)
    return F.when((n > 2) & (total > 0), (squares / (total * total) - 1 / n) / (1 - 1 / n)).otherwise(F.lit(float("nan")))


def get_hhi(bets: DataFrame, keys: Names = (), value: str = "ret") -> DataFrame:
    return bets.groupBy(*keys).agg(hhi(F.col(value)).alias("hhi"))


def get_hhi_decomposed(bets: DataFrame, keys: Names = (), value: str = "ret") -> DataFrame:
    """keys, positive (returns of 0 or more), negative, total."""
    v = F.col(value)
    return bets.groupBy(*keys).agg(hhi(F.when(v >= 0, v)).alias("positive"), hhi(F.when(v < 0, v)).alias("negative"), hhi(v).alias("total"))


def get_bet_timing(positions: DataFrame, keys: Names = (), value: str = "position") -> DataFrame:
    """keys, ts at which a position is closed or turned, and the last time."""
    w = over(keys, ["ts"])
    before = F.lag(value).over(w)
    rows = positions.withColumn("__hit", F.coalesce((F.col(value) == 0) & (before != 0), F.lit(False)) | F.coalesce(F.col(value) * before < 0, F.lit(False)))
    last = F.lead("ts").over(w).isNull()
    return rows.withColumn("__last", last).where("__hit OR __last").select(*keys, "ts")


def get_holding_period(positions: DataFrame, keys: Names = (), value: str = "position") -> DataFrame:
    """keys, days: mean time held, weighted by the size of what was sold, with entries averaged; NaN if nothing was."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[value].to_numpy(float)
        t = (pdf["ts"] - pdf["ts"].iloc[0]).dt.total_seconds().to_numpy() / DAY
        entry, held, size = 0.0, 0.0, 0.0
        for i in range(1, len(p)):
            old, new = p[i - 1], p[i]
            step = new - old
            if step * old >= 0:
                entry = (entry * old + t[i] * step) / new if new else entry
                continue
            sold = abs(old) if new * old < 0 else abs(step)
            held, size = held + (t[i] - entry) * sold, size + sold
            entry = t[i] if new * old < 0 else entry
        return pd.DataFrame({"days": [held / size if size else math.nan]})

    return per_series(positions.select(*keys, "ts", F.col(value)), keys, ["ts"], fold, "days double")


# Bet sizes.


def raw_signal(prob: Value, classes: int, pred: Value | None = None, side: Value | None = None) -> Column:
    """Size of a bet from a probability: from its z value against even chances."""
    p = col(prob)
    out = 2 * phi_column((p - 1 / classes) / F.sqrt(p * (1 - p))) - 1
    for x in (pred, side):
        out = out if x is None else out * col(x)
    return out


def get_signal(events: DataFrame, step: float, prob: str, classes: int, pred: str | None = None, side: str | None = None, keys: Names = ()) -> DataFrame:
    """keys, ts, signal: sizes averaged over the bets alive and rounded to steps."""
    if "t1" not in events.columns:
        raise ValueError("t1 is needed")
    rows = events.select(*keys, "ts", "t1", raw_signal(prob, classes, pred, side).alias("signal"))
    active = avg_active_signals(rows, keys)
    return active.withColumn("signal", discrete_signal("signal", step))


def avg_active_signals(signals: DataFrame, keys: Names = ()) -> DataFrame:
    """keys, ts, signal: mean of the signals with ts <= time < t1 (no t1: without end), at each start or end where there are any.

    Starts add and ends subtract along each series, so that bets are not joined with times.
    """
    steps = signals.select(*keys, "ts", F.lit(1).alias("n"), F.col("signal").alias("x"))
    ends = signals.where("t1 IS NOT NULL").select(*keys, F.col("t1").alias("ts"), F.lit(-1).alias("n"), (-F.col("signal")).alias("x"))
    each = steps.unionByName(ends).groupBy(*keys, "ts").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,18)")).alias("x"))
    w = over(keys, ["ts"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = each.select(*keys, "ts", F.sum("n").over(w).alias("n"), F.sum("x").over(w).cast("double").alias("x"))
    return rows.where("n > 0").select(*keys, "ts", (F.col("x") / F.col("n")).alias("signal"))


def bet_size_mixture(count: Value, mu1: float, mu2: float, sigma1: float, sigma2: float, prob1: float) -> Column:
    """Size from the place of a number of concurrent bets in a mixture of two normal distributions."""
    c = col(count)
    f = prob1 * phi_column((c - mu1) / sigma1) + (1 - prob1) * phi_column((c - mu2) / sigma2)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * f - 1))


def bet_size_ensemble(prob: float, n: int) -> float:
    """Size from the mean probability of n classifiers, by Student's distribution."""
    if n < 2:
        raise ValueError("two classifiers are needed")
    se = math.sqrt(prob * (1 - prob) / n)
    return 2 * t_cdf((prob - 0.5) / se, n - 1) - 1 if se > 0 else 0.0


# Risk of a strategy.


def mix_gaussians(spark: SparkSession, mu1: float, mu2: float, sigma1: float, sigma2: float, prob1: float, n: int, seed: int) -> DataFrame:
    """id, ret: int(n * prob1) draws from the first of two normal distributions, the others from the second, dealt by a permutation of the ids."""
    rng = random.Random(seed)
    step = next(a for a in iter(lambda: rng.randrange(1, min(n, 1 << 31) + 1), None) if math.gcd(a, n) == 1) if n else 1
    place = F.pmod(F.col("id").cast("decimal(20,0)") * step + rng.randrange(max(n, 1)), F.lit(max(n, 1)).cast("decimal(20,0)"))
    rows = spark.range(n).select("id", F.randn(seed + 1).alias("z"))
    return rows.withColumn("f", place < int(n * prob1)).select("id", F.when(F.col("f"), mu1 + sigma1 * F.col("z")).otherwise(mu2 + sigma2 * F.col("z")).alias("ret"))


def prob_failure(returns: DataFrame, freq: float, target_sr: float, keys: Names = (), value: str = "ret") -> DataFrame:
    """keys, prob: chance that the precision is below what the target Sharpe ratio needs; NaN without gains or without losses."""
    v = F.col(value)
    rows = returns.groupBy(*keys).agg(F.avg(F.when(v > 0, v)).alias("up"), F.avg(F.when(v <= 0, v)).alias("down"), F.avg((v > 0).cast("double")).alias("p"))
    need = bin_hr("down", "up", freq, target_sr)
    prob = phi_column((need - F.col("p")) / F.sqrt(F.col("p") * (1 - F.col("p")) / freq))
    return rows.select(*keys, F.when(F.col("up").isNull() | F.col("down").isNull(), F.lit(float("nan"))).otherwise(prob).alias("prob"))


# Overfitting.


def metric_of(n, total, squares, metric: str):
    mean = total / n
    if metric == "total":
        return total
    if metric == "mean":
        return mean
    sd = np.sqrt(np.maximum(squares - n * mean * mean, 0) / (n - 1))
    return np.divide(mean, sd, out=np.full(np.shape(mean), np.nan), where=sd > 0)


def probability_of_backtest_overfitting(trials: DataFrame, partitions: int = 16, metric: str = "sharpe") -> DataFrame:
    """One row: pbo, n_splits, mean_logit. ``trials``: ts, trial, ret, the same times for each trial.

    Moments of each stretch of time and trial are aggregated once; a split of the stretches recombines them, and splits are dealt over tasks.
    """
    if partitions % 2:
        raise ValueError("the number of partitions must be even")
    times = trials.select("ts").distinct().withColumn("i", position((), ["ts"]))
    n = times.count()
    size = n // partitions
    if size < 2:
        raise ValueError(f"{n} rows are too few for {partitions} partitions")
    rows = trials.join(F.broadcast(times), "ts").withColumn("part", F.floor(F.col("i") / size)).where(F.col("part") < partitions)
    moments = rows.groupBy("part", "trial").agg(F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q")).orderBy("trial", "part").toPandas()  # partitions x trials numbers
    s, q = (moments.pivot(index="part", columns="trial", values=c).to_numpy() for c in "sq")
    spark, half = trials.sparkSession, partitions // 2

    def run(batches):
        for pdf in batches:
            logits = []
            for mask in pdf["mask"]:
                inside = np.array([bool(mask >> i & 1) for i in range(partitions)])
                fit, out = (metric_of(half * size, s[x].sum(0), q[x].sum(0), metric) for x in (inside, ~inside))
                best = int(np.nanargmax(fit)) if np.isfinite(fit).any() else 0
                omega = float(np.clip((out < out[best]).sum() / (s.shape[1] - 1), 1e-10, 1 - 1e-10))
                logits.append(math.log(omega / (1 - omega)))
            yield pd.DataFrame({"logit": logits})

    masks = [(sum(1 << i for i in c),) for c in itertools.combinations(range(partitions), half)]
    logits = spark.createDataFrame(masks, "mask long").repartition(8).mapInPandas(run, "logit double")
    return logits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_splits"), F.avg("logit").alias("mean_logit"))


# Mean-reverting prices and trading rules.


def ou_fit(prices: DataFrame, forecast: float, keys: Names = (), value: str = "price", order: Names = ("ts",)) -> DataFrame:
    """keys, phi, sigma, half_life of prices that revert to a forecast."""
    x = F.lag(value).over(over(keys, order)) - forecast
    rows = prices.select(*keys, x.alias("x"), (F.col(value) - forecast).alias("y")).where("x IS NOT NULL")
    rows = rows.withColumn("phi", F.covar_pop("x", "y").over(whole(keys)) / F.var_pop("x").over(whole(keys)))
    out = rows.groupBy(*keys).agg(F.first("phi").alias("phi"), F.stddev_pop(F.col("y") - F.col("phi") * F.col("x")).alias("sigma"))
    return out.withColumn("half_life", F.when((F.col("phi") > 0) & (F.col("phi") < 1), -math.log(2) / F.log("phi")).otherwise(F.lit(float("nan"))))


def otr_batch(spark: SparkSession, regimes: list[tuple[float, float, float]], n_iter: int = 100_000, max_hp: int = 100, r_pt=None, r_slm=None, p0: float = 0.0, seed: int = 0, per_task: int = 20_000) -> DataFrame:
    """forecast, half_life, sigma, r_pt, r_slm, mean_pnl, std_pnl, sharpe of trading rules on simulated paths.

    Tasks simulate ``per_task`` paths of a rule at a time, all paths step by step, and send moments only; each task has a seed of its own.
    """
    r_pt = np.linspace(0.5, 10, 20) if r_pt is None else r_pt
    r_slm = np.linspace(0.5, 10, 20) if r_slm is None else r_slm
    rules = [(float(f), float(h), float(s), float(a), float(b)) for (f, h, s), a, b in itertools.product(regimes, r_pt, r_slm)]
    chunks = -(-n_iter // per_task)
    tasks = spark.createDataFrame([(i, *x) for i, x in enumerate(rules)], "rule long, forecast double, half_life double, sigma double, r_pt double, r_slm double")
    tasks = tasks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(max(8, min(len(rules) * chunks, 200)))

    def run(batches):
        for pdf in batches:
            moments = []
            for row in pdf.itertuples():
                rng = np.random.default_rng([seed, row.rule, row.chunk])
                n = min(per_task, n_iter - row.chunk * per_task)
                keep, p = 2 ** (-1 / row.half_life), np.full(n, float(p0))
                total = square = 0.0
                for step in range(1, max_hp + 2):
                    p = (1 - keep) * row.forecast + keep * p + row.sigma * rng.standard_normal(len(p))
                    gain = p - p0
                    over_ = (gain > row.r_pt) | (gain < -row.r_slm) | (step > max_hp)
                    total, square, p = total + gain[over_].sum(), square + (gain[over_] ** 2).sum(), p[~over_]
                    if not len(p):
                        break
                moments.append((row.rule, row.forecast, row.half_life, row.sigma, row.r_pt, row.r_slm, n, total, square))
            yield pd.DataFrame(moments, columns=["rule", "forecast", "half_life", "sigma", "r_pt", "r_slm", "n", "total", "square"])

    names = ["forecast", "half_life", "sigma", "r_pt", "r_slm"]
    got = tasks.mapInPandas(run, "rule long, forecast double, half_life double, sigma double, r_pt double, r_slm double, n long, total double, square double")
    sums = got.groupBy(*names).agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("q"))
    mean = F.col("t") / F.col("n")
    sd = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select(*names, mean.alias("mean_pnl"), sd.alias("std_pnl"), F.when(sd > 0, mean / sd).otherwise(F.lit(0.0)).alias("sharpe"))


def otr_main(spark: SparkSession, forecasts=(10, 5, 0, -5, -10), half_lives=(5, 10, 25, 50, 100), sigma: float = 1.0, n_iter: int = 100_000, max_hp: int = 100, seed: int = 0, points: int = 21) -> DataFrame:
    """otr_batch over all pairs of forecasts and half-lives and a mesh of rules from 0 to 10."""
    mesh = np.linspace(0, 10, points)
    return otr_batch(spark, [(f, h, sigma) for f, h in itertools.product(forecasts, half_lives)], n_iter, max_hp, mesh, mesh, seed=seed)
