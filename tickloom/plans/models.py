"""Queries on features, tests, validation, evaluation and allocation."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.functions.register import register
from tickloom.functions.statistics import t_cdf
from tickloom.operators import breaks, clusters, dispatch, entropy, evaluation, fracdiff, learning, portfolio, redundancy, validation
from tickloom.plans import market
from tickloom.plans.inputs import DAILY, HOURLY, daily, hourly, r, table

ENTRIES: dict = {}
K = ["k"]


def query(sql: str | None = None, digits: int = 6):
    def add(f):
        market.query(sql, digits)(f)
        ENTRIES[f.__name__] = market.ENTRIES.pop(f.__name__)
        return f

    return add


RET = f"{HOURLY}, ret AS MATERIALIZED (SELECT k, ts, close / lag(close) OVER (PARTITION BY k ORDER BY ts) - 1 AS ret FROM hourly), rets AS MATERIALIZED (SELECT * FROM ret WHERE ret IS NOT NULL)"


def returns(spark, d) -> DataFrame:
    b = hourly(spark, d)
    return b.select("k", "ts", (F.col("close") / F.lag("close").over(evaluation.over(K, ["ts"])) - 1).alias("ret")).where("ret IS NOT NULL")


def phi_sql(z: str) -> str:
    """The normal distribution function in SQL: its series in odd powers over double factorials."""
    c = f"greatest(-8.0, least(8.0, {z}))::DOUBLE"
    return f"(0.5 + sign({c}) * exp(-pow({c}, 2) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda j: exp((2 * j + 1) * ln(greatest(abs({c}), 1e-300)) - (j + 1) * ln(2.0) - lgamma(j + 1.5) + 0.5 * ln(pi())))))"


# Fractional differentiation.


def weights_sql(d: float, n: int) -> str:
    return f"wt AS MATERIALIZED (SELECT 0 AS lag_, 1.0::DOUBLE AS w UNION ALL SELECT lag_ + 1, -w * ({d} - lag_) / (lag_ + 1) FROM wt WHERE lag_ < {n})"


@query(f"WITH RECURSIVE {weights_sql(0.4, 9)} SELECT 0.4::DOUBLE AS d, lag_::BIGINT AS k, {r('w AS weight')} FROM wt")
def frac_weights(spark, d):
    return fracdiff.weight_decay(spark, (0.4, 0.4), 1, 10)


N_FFD = len(fracdiff.get_weights_ffd(0.4, 1e-2))


@query(f"WITH RECURSIVE {DAILY}, {weights_sql(0.4, N_FFD - 1)}, n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM daily) SELECT a.ts, {r('sum(w * b.close) AS value')} FROM n a JOIN wt ON true JOIN n b ON b.i = a.i - lag_ WHERE a.i >= {N_FFD} GROUP BY a.ts")
def frac_diff_ffd(spark, d):
    return fracdiff.frac_diff_ffd(daily(spark, d), 0.4, 1e-2)


@query(
    f"""WITH RECURSIVE {HOURLY}, n AS MATERIALIZED (SELECT k, ts, close, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY k) AS c FROM hourly), {weights_sql(0.5, 1000)}
    , u AS MATERIALIZED (SELECT k, lag_, w FROM (SELECT DISTINCT k, c FROM n) JOIN wt ON lag_ < c), s AS (SELECT k, sum(abs(w)) OVER (PARTITION BY k ORDER BY lag_ DESC) / sum(abs(w)) OVER (PARTITION BY k) AS share FROM u)
    , sk AS (SELECT k, count(*) FILTER (WHERE share > 0.05) AS skip FROM s GROUP BY k)
    SELECT a.k, a.ts, {r('sum(w * b.close) AS value')} FROM n a JOIN u ON u.k = a.k AND u.lag_ <= a.i JOIN n b ON b.k = a.k AND b.i = a.i - u.lag_ JOIN sk ON sk.k = a.k WHERE a.i >= skip GROUP BY a.k, a.ts"""
)
def frac_diff(spark, d):
    return fracdiff.frac_diff(hourly(spark, d), 0.5, 0.05, keys=K)


@query()
def min_ffd(spark, d):
    return fracdiff.min_ffd(hourly(spark, d), [0.0, 0.25, 0.5, 0.75, 1.0], 1e-2, keys=K)


# Entropy.
MSG = f"{RET}, msg AS MATERIALIZED (SELECT k, string_agg(CASE WHEN ret > 0 THEN '1' ELSE '0' END, '' ORDER BY ts) AS message FROM rets WHERE ret <> 0 GROUP BY k)"
PMF = f"{MSG}, words AS (SELECT k, substr(message, i, 3) AS word, length(message) - 3 AS n FROM (SELECT *, unnest(range(1, length(message) - 2)) AS i FROM msg)), pmf AS (SELECT k, word, count(*) / max(n) AS p FROM words GROUP BY k, word)"


def binary(spark, d):
    return entropy.encode_binary(returns(spark, d), keys=K)


@query(f"WITH {MSG} SELECT k, message FROM msg")
def encode_binary(spark, d):
    return binary(spark, d)


DECILES = ", ".join(f"quantile_cont(ret, {i / 10}) AS q{i}" for i in range(1, 10))
BELOW = " + ".join(f"(q{i} < ret)::INT" for i in range(1, 10))


@query(f"WITH {RET}, q AS (SELECT k, {DECILES} FROM rets GROUP BY k) SELECT k, string_agg(({BELOW})::VARCHAR, '' ORDER BY ts) AS message FROM rets JOIN q USING (k) GROUP BY k")
def encode_quantile(spark, d):
    return entropy.encode_quantile(returns(spark, d), 10, keys=K)


@query(f"WITH {RET}, m AS (SELECT *, min(ret) OVER (PARTITION BY k) AS low FROM rets) SELECT k, string_agg(floor((ret - low) / 0.5)::BIGINT::VARCHAR, '' ORDER BY ts) AS message FROM m GROUP BY k")
def encode_sigma(spark, d):
    return entropy.encode_sigma(returns(spark, d), 0.5, keys=K)


@query(f"WITH {PMF} SELECT k, word, {r('p')} FROM pmf")
def pmf1(spark, d):
    return entropy.pmf1(binary(spark, d), 3, K)


@query(f"WITH {PMF} SELECT k, {r('-sum(p * log2(p)) / 3 AS entropy')} FROM pmf GROUP BY k")
def plug_in(spark, d):
    return entropy.plug_in(binary(spark, d), 3, K)


@query(
    f"""WITH RECURSIVE {MSG}, f AS (SELECT k, message, 1::BIGINT AS pos, []::VARCHAR[] AS seen FROM msg
            UNION ALL SELECT k, message, pos + size, list_append(seen, substr(message, pos, size)) FROM (
              SELECT *, list_filter(range(1, length(message) - pos + 2), lambda m: NOT list_contains(seen, substr(message, pos, m)))[1] AS size FROM f) WHERE size IS NOT NULL)
    SELECT k, array_to_string(arg_max(seen, len(seen)), ' ') AS phrases FROM f GROUP BY k"""
)
def lempel_ziv_lib(spark, d):
    return binary(spark, d).select("k", F.array_join(entropy.lempel_ziv_lib("message"), " ").alias("phrases"))


def konto_sql(window: int | None = None) -> str:
    """CTE kon (k, num, sum, h, r) over msg: longest matches in the letters before each place, by trying all sizes."""
    width = f"least({window}, length(message) // 2)"
    points = f"range({width}, length(message) - {width} + 1)" if window else "range(1, length(message) // 2 + 1)"
    return f"""pts AS (SELECT k, message, length(message) AS n, {width if window else "NULL"} AS fixed, unnest({points}) AS i FROM msg)
    , wide AS (SELECT *, coalesce(fixed, i) AS w FROM pts)
    , lens AS (SELECT k, n, w, 1 + coalesce(list_max(list_filter(range(1, w + 1), lambda m: i + m <= n AND contains(substr(message, i - w + 1, w + m - 1), substr(message, i + 1, m)))), 0) AS size FROM wide)
    , kon AS (SELECT k, count(*) AS num, sum(log2(w + 1) / size) AS sum, sum(log2(w + 1) / size) / count(*) AS h, 1 - sum(log2(w + 1) / size) / count(*) / log2(any_value(n)) AS r FROM lens GROUP BY k)"""


def quartile_sql(rows: str, value: str, order: str) -> str:
    """CTE msg (k, message): how many of the inner quartiles are below each value."""
    return f"""edges AS (SELECT k, list_sort(list_distinct(quantile_cont({value}, [0.0, 0.25, 0.5, 0.75, 1.0]))) AS e FROM {rows} GROUP BY k)
    , msg AS MATERIALIZED (SELECT k, string_agg(len(list_filter(e[2:len(e) - 1], lambda x: x < {value}))::VARCHAR, '' ORDER BY {order}) AS message FROM {rows} JOIN edges USING (k) WHERE {value} IS NOT NULL GROUP BY k)"""


@query(f"WITH {MSG}, {konto_sql(50)} SELECT k, num, {r('sum', 'h', 'r')} FROM kon")
def konto(spark, d):
    return binary(spark, d).withColumn("x", entropy.konto("message", 50)).select("k", "x.num", "x.sum", "x.h", "x.r")


@query(f"WITH {RET}, {quartile_sql('rets', 'ret', 'ts')}, {konto_sql()} SELECT k, {r('h AS entropy_rate', 'r AS redundancy')} FROM kon")
def market_efficiency(spark, d):
    return entropy.market_efficiency_metric(returns(spark, d), "quantile", 4, keys=K)


@query(f"WITH {market.BUCKETS}, shares AS (SELECT k, bucket, buy_volume / nullif(buy_volume + sell_volume, 0) AS share FROM full_), {quartile_sql('shares', 'share', 'bucket')}, {konto_sql(20)} SELECT k, {r('h')} FROM kon")
def adverse_selection(spark, d):
    flow = market.microstructure.volume_bucket(market.ticks(spark, d), 500, K, market.O).withColumn("volume", F.col("buy_volume") + F.col("sell_volume"))
    return entropy.adverse_selection_feature(flow, 4, 20, keys=K, order=["bucket"])


PQ = f"{HOURLY}, pq AS (SELECT k, hour(ts) AS h, sum(volume) AS p, count(*)::DOUBLE AS q FROM hourly GROUP BY 1, 2), n AS (SELECT k, p / sum(p) OVER (PARTITION BY k) AS p, q / sum(q) OVER (PARTITION BY k) AS q FROM pq)"


def two_shares(spark, d):
    return hourly(spark, d).groupBy("k", F.hour("ts").alias("h")).agg(F.sum("volume").alias("p"), F.count(F.lit(1)).cast("double").alias("q"))


@query(f"WITH {PQ} SELECT k, {r('sum(p * ln(p / q)) AS kl')} FROM n GROUP BY k")
def kl_divergence(spark, d):
    return entropy.kl_divergence(two_shares(spark, d), K)


@query(f"WITH {PQ} SELECT k, {r('-sum(p * ln(q)) AS cross_entropy')} FROM n GROUP BY k")
def cross_entropy(spark, d):
    return entropy.cross_entropy(two_shares(spark, d), K)


UNI = "round_even({z} / 6 + 2 / (3 * {z}) + 1.0 / 3, 0)::INT".format(z="pow(8 + 324 * n + 12 * sqrt(36 * n + 729.0 * n * n), 1.0 / 3)")
BI = "round_even(sqrt(0.5) * sqrt(1 + sqrt(1 + 24 * n / (1 - r * r))), 0)::INT"


@query(f"WITH {RET}, c AS (SELECT k, count(*)::DOUBLE AS n FROM rets GROUP BY k) SELECT k, {UNI} AS bins FROM c")
def num_bins(spark, d):
    return returns(spark, d).groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("n")).select("k", entropy.num_bins(F.col("n")).alias("bins"))


@query(f"WITH {RET}, c AS (SELECT *, count(*) OVER (PARTITION BY k)::DOUBLE AS n, min(ret) OVER (PARTITION BY k) AS lo, max(ret) OVER (PARTITION BY k) AS hi FROM rets), b AS (SELECT *, {UNI} AS b FROM c) SELECT k, ts, least(floor((ret - lo) * b / (hi - lo)), b - 1)::INT AS ret_bin FROM b")
def discretize_optimal(spark, d):
    return entropy.discretize_optimal(returns(spark, d), "ret", keys=K).select("k", "ts", "ret_bin")


INFO = f"""{HOURLY}, a AS (SELECT k, close AS x, high AS y, corr(close, high) OVER (PARTITION BY k) AS r, count(*) OVER (PARTITION BY k)::DOUBLE AS n FROM hourly)
  , b AS (SELECT *, {BI} AS b, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy FROM a WINDOW w AS (PARTITION BY k))
  , c AS (SELECT k, least(floor((x - lx) * b / (hx - lx)), b - 1) AS i, least(floor((y - ly) * b / (hy - ly)), b - 1) AS j, count(*) AS c FROM b GROUP BY 1, 2, 3)
  , p AS (SELECT k, c / sum(c) OVER (PARTITION BY k) AS p, sum(c) OVER (PARTITION BY k, i) / sum(c) OVER (PARTITION BY k) AS pa, sum(c) OVER (PARTITION BY k, j) / sum(c) OVER (PARTITION BY k) AS pb FROM c)
  , inf AS (SELECT k, -sum(p * ln(pa)) AS ha, -sum(p * ln(pb)) AS hb, sum(p * ln(p / (pa * pb))) AS i FROM p GROUP BY k)"""


@query(f"WITH {INFO} SELECT k, {r('(ha + hb - 2 * i) / (ha + hb - i) AS vi')} FROM inf")
def variation_of_information(spark, d):
    return entropy.variation_of_information(hourly(spark, d), "close", "high", True, K)


@query(f"WITH {INFO} SELECT k, {r('i AS mi')} FROM inf")
def mutual_information(spark, d):
    return entropy.mutual_information_optimal(hourly(spark, d), "close", "high", K)


@query()
def portfolio_concentration(spark, d):
    names, cov = portfolio.matrix(portfolio.covariance(asset_returns(spark, d)))
    return spark.createDataFrame([(entropy.portfolio_concentration(np.full(len(names), 1 / len(names)), cov),)], "concentration double")


# Structural breaks, on the whole daily series.


def log_prices(spark, d):
    return daily(spark, d).withColumn("log_p", F.log("close"))


LEVELS = f"{DAILY}, levels AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM daily)"


@query()
def sadf_test(spark, d):
    return breaks.sadf_test(log_prices(spark, d), 30)


@query()
def qadf_test(spark, d):
    return breaks.qadf_test(log_prices(spark, d), 30)


@query()
def cadf_test(spark, d):
    return breaks.cadf_test(log_prices(spark, d), 30)


@query()
def chow_dickey_fuller(spark, d):
    return breaks.chow_type_dickey_fuller(log_prices(spark, d), 20)


@query()
def brown_durbin_evans(spark, d):
    return breaks.brown_durbin_evans_cusum(log_prices(spark, d))


@query(f"WITH {LEVELS}, v AS (SELECT *, sum(coalesce(pow(close - before, 2), 0)) OVER (ORDER BY i) / i AS var FROM (SELECT *, lag(close) OVER (ORDER BY i) AS before FROM levels)) SELECT a.ts, {r('max((a.close - b.close) / sqrt(a.i - b.i)) / sqrt(any_value(a.var)) AS s_t')}, {r('4.6 + ln(any_value(a.i)) AS critical')} FROM v a JOIN levels b ON b.i < a.i WHERE a.i >= 2 GROUP BY a.ts")
def chu_stinchcombe_white(spark, d):
    return breaks.chu_stinchcombe_white_cusum(daily(spark, d))


# Validation. Observations, one series: the hours with events of any type, with a label of 5 hours.
OBS = f"{HOURLY}, obs AS MATERIALIZED (SELECT ts, ts + INTERVAL 5 HOUR AS t1, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM hourly))"


def observations(spark, d):
    return hourly(spark, d).select("ts").distinct().select("ts", F.expr("ts + INTERVAL 5 HOUR").alias("t1"))


@query(f"WITH {OBS}, test AS (SELECT ts AS a, t1 AS b FROM obs WHERE i % 100 < 5) SELECT ts, t1 FROM obs WHERE NOT EXISTS (SELECT 1 FROM test WHERE obs.ts <= b AND obs.t1 >= a)")
def get_train_times(spark, d):
    o = observations(spark, d)
    i = validation.position((), ["ts"])
    return validation.get_train_times(o, o.withColumn("i", i).where("i % 100 < 5").select(F.col("ts").alias("start"), F.col("t1").alias("end")))


@query(f"WITH {OBS} SELECT a.ts, b.ts AS embargo_ts FROM obs a JOIN obs b ON b.i = least(a.i + floor(a.n * 0.02), a.n - 1)")
def get_embargo_times(spark, d):
    return validation.get_embargo_times(observations(spark, d).select("ts"), 0.02)


FOLDS = f"{OBS}, f AS MATERIALIZED (SELECT *, ntile(5) OVER (ORDER BY ts) - 1 AS fold FROM obs), s AS (SELECT fold AS split, min(ts) AS a, max(t1) AS b, max(i) AS z FROM f GROUP BY fold)"


@query(f"WITH {FOLDS}, s2 AS (SELECT s.*, (SELECT min(i) FROM obs WHERE ts >= s.b) + floor((SELECT max(n) FROM obs) * 0.01) AS resume FROM s) SELECT split::INT AS split, ts, CASE WHEN fold = split THEN 'test' ELSE 'train' END AS role FROM f, s2 WHERE fold = split OR t1 <= a OR i >= resume")
def purged_k_fold(spark, d):
    return validation.PurgedKFold(5, 0.01).split(observations(spark, d)).withColumn("split", F.col("split").cast("int"))


CPCV = f"{OBS}, f AS MATERIALIZED (SELECT *, ntile(6) OVER (ORDER BY ts) - 1 AS fold FROM obs), g AS (SELECT fold, min(ts) AS a, max(t1) AS b, max(i) AS z FROM f GROUP BY fold), sp AS MATERIALIZED (SELECT x.fold AS p, y.fold AS q, (row_number() OVER (ORDER BY x.fold, y.fold) - 1)::INT AS split FROM g x JOIN g y ON x.fold < y.fold)"


@query(f"WITH {CPCV} SELECT split, f.ts, CASE WHEN f.fold IN (p, q) THEN 'test' ELSE 'train' END AS role FROM f, sp WHERE f.fold IN (p, q) OR NOT EXISTS (SELECT 1 FROM g WHERE g.fold IN (p, q) AND ((f.ts <= b AND f.t1 >= a) OR (f.i > z AND f.i < z + floor(f.n * 0.02))))")
def combinatorial_purged(spark, d):
    return validation.CombinatorialPurgedKFold(6, 2, 0.02).split(observations(spark, d))


@query(f"WITH {CPCV} SELECT split, f.fold::INT AS fold, f.ts FROM f, sp WHERE f.fold IN (p, q)")
def test_group_map(spark, d):
    return validation.CombinatorialPurgedKFold(6, 2).get_test_group_map(observations(spark, d))


PATHS = ", paths AS (SELECT * FROM (VALUES (0, 0), (0, 9), (0, 14), (1, 0), (1, 10), (1, 13), (2, 0), (2, 11), (2, 12), (3, 1), (3, 6), (3, 14), (4, 1), (4, 7), (4, 13)) v(path, split))"


def predicted(spark, d):
    cv = validation.CombinatorialPurgedKFold(6, 2)
    return cv.get_test_group_map(observations(spark, d)).select("split", "ts", (F.col("split") + F.hour("ts") / 100).alias("prediction"))


@query(f"WITH {CPCV}{PATHS} SELECT path, f.ts, {r('sp.split + hour(f.ts) / 100 AS prediction')} FROM f JOIN sp ON f.fold IN (p, q) JOIN paths ON paths.split = sp.split")
def backtest_paths(spark, d):
    return validation.assemble_backtest_paths(predicted(spark, d), 6, 2)


@query(f"WITH {CPCV}, u AS (SELECT sp.split, f.fold, f.ts, dense_rank() OVER (PARTITION BY f.fold ORDER BY sp.split) - 1 AS path FROM f JOIN sp ON f.fold IN (p, q)) SELECT path::INT AS path, ts, {r('split + hour(ts) / 100 AS prediction')} FROM u")
def backtest_paths_per_group(spark, d):
    cv = validation.CombinatorialPurgedKFold(6, 2)
    return validation.assemble_paths_per_group(predicted(spark, d), cv, observations(spark, d))


@query(f"WITH z AS (SELECT (user_id % 2) AS label, (event_id % 2) AS pred, 0.5 + (event_id % 50) / 100.0 AS prob FROM events) SELECT {r('sum(CASE WHEN label = pred THEN prob - 0.5 ELSE 0 END) / sum(prob - 0.5) AS pwa')} FROM z")
def probability_weighted_accuracy(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 2).alias("label"), (F.col("event_id") % 2).alias("prediction"), (0.5 + (F.col("event_id") % 50) / 100).alias("prob"))
    return validation.probability_weighted_accuracy(e)


# Evaluation.


@query(f"WITH {RET} SELECT k, {r('avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe')} FROM rets GROUP BY k")
def sharpe_ratio(spark, d):
    return evaluation.sharpe_ratio(returns(spark, d), 252, K)


@query(f"WITH {RET} SELECT k, {r('avg(ret) / stddev_samp(ret) AS sharpe')} FROM rets GROUP BY k")
def sharpe_ratio_non_annualized(spark, d):
    return evaluation.sharpe_ratio_non_annualized(returns(spark, d), K)


MOM = f"{RET}, c AS (SELECT *, avg(ret) OVER (PARTITION BY k) AS m FROM rets), g AS (SELECT k, count(*) AS n, avg(ret) / stddev_samp(ret) AS sr, avg(pow(ret - m, 3)) / pow(stddev_pop(ret), 3) AS g3, avg(pow(ret - m, 4)) / pow(stddev_pop(ret), 4) AS g4 FROM c GROUP BY k)"


def moments(spark, d):
    return returns(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"), evaluation.sharpe("ret").alias("sr"), F.skewness("ret").alias("g3"), (F.kurtosis("ret") + 3).alias("g4"))


@query(f"WITH {MOM} SELECT k, {r('sr * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) AS z')} FROM g")
def psr_z(spark, d):
    return moments(spark, d).select("k", evaluation.psr_z("sr", 0.0, "n", "g3", "g4").alias("z"))


@query(f"WITH {MOM}, z AS (SELECT k, sr * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) AS z FROM g) SELECT k, {r(phi_sql('z') + ' AS psr')} FROM z")
def probabilistic_sharpe_ratio(spark, d):
    return moments(spark, d).select("k", evaluation.probabilistic_sharpe_ratio("sr", 0.0, "n", "g3", "g4").alias("psr"))


#: What the best of five standard normal values leads one to expect; the series are the five event types.
BEST_OF_5 = (1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / 5) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (5 * math.e))


@query(f"WITH {MOM}, z AS (SELECT k, (sr - stddev_samp(sr) OVER () * {BEST_OF_5}) * sqrt(n - 1) / sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr) AS z FROM g) SELECT k, {r(phi_sql('z') + ' AS dsr')} FROM z")
def deflated_sharpe_ratio(spark, d):
    got = moments(spark, d).orderBy("k").toPandas()
    rows = [(x.k, evaluation.deflated_sharpe_ratio(x.sr, got["sr"].tolist(), int(x.n), x.g3, x.g4)) for x in got.itertuples()]
    return spark.createDataFrame(rows, "k string, dsr double")


def pnl(spark, d):
    return daily(spark, d).withColumnRenamed("close", "pnl")


@query(f"WITH {DAILY}, h AS (SELECT ts, close, max(close) OVER (ORDER BY ts) AS m FROM daily) SELECT ts, {r('CASE WHEN m > 0 THEN 1 - close / m ELSE 0 END AS drawdown')} FROM h")
def drawdown(spark, d):
    return evaluation.drawdown(pnl(spark, d))


@query(f"WITH {DAILY}, h AS (SELECT ts, close, max(close) OVER (ORDER BY ts) AS m FROM daily) SELECT ts, {r('m - close AS drawdown')} FROM h")
def drawdown_dollars(spark, d):
    return evaluation.drawdown(pnl(spark, d), True)


@query(f"WITH {DAILY}, h AS (SELECT *, max(close) OVER (ORDER BY ts) > close AS u, lag(ts) OVER (ORDER BY ts) AS p, lead(ts) OVER (ORDER BY ts) AS nx FROM daily), s AS (SELECT *, CASE WHEN u AND NOT coalesce(lag(u) OVER (ORDER BY ts), false) THEN 1 ELSE 0 END AS st FROM h), g AS (SELECT *, sum(st) OVER (ORDER BY ts) AS g FROM s) SELECT min(p) AS peak_ts, coalesce(arg_max(nx, ts), max(ts)) AS recovery_ts, round((epoch_us(coalesce(arg_max(nx, ts), max(ts))) - epoch_us(min(p))) / 86400000000.0, 6) AS tuw_days FROM g WHERE u GROUP BY g")
def time_under_water(spark, d):
    return evaluation.time_under_water(pnl(spark, d))


def hhi_sql(x: str, name: str) -> str:
    return r(f"(sum({x} * {x}) / pow(sum(abs({x})), 2) - 1.0 / count({x})) / (1 - 1.0 / count({x})) AS {name}")


@query(f"WITH {RET} SELECT k, {hhi_sql('ret', 'hhi')} FROM rets GROUP BY k")
def get_hhi(spark, d):
    return evaluation.get_hhi(returns(spark, d), K)


@query(f"WITH {RET}, z AS (SELECT k, ret AS x, CASE WHEN ret >= 0 THEN ret END AS p, CASE WHEN ret < 0 THEN ret END AS q FROM rets) SELECT k, {hhi_sql('p', 'positive')}, {hhi_sql('q', 'negative')}, {hhi_sql('x', 'total')} FROM z GROUP BY k")
def get_hhi_decomposed(spark, d):
    return evaluation.get_hhi_decomposed(returns(spark, d), K)


POS = f"{DAILY}, pos AS MATERIALIZED (SELECT ts, CASE WHEN epoch(ts)::BIGINT // 86400 % 4 = 0 THEN 0.0 ELSE sign(close - lag(close, 1, close) OVER (ORDER BY ts)) * (1 + epoch(ts)::BIGINT // 86400 % 3) END AS position FROM daily)"


def positions(spark, d):
    days = F.floor(F.unix_timestamp("ts") / 86400)
    step = F.signum(F.col("close") - F.lag("close").over(evaluation.over((), ["ts"])))
    return daily(spark, d).select("ts", F.when(days % 4 == 0, F.lit(0.0)).otherwise(F.coalesce(step, F.lit(0.0)) * (1 + days % 3)).alias("position"))


@query(f"WITH {POS}, z AS (SELECT *, lag(position) OVER (ORDER BY ts) AS b, lead(ts) OVER (ORDER BY ts) AS nx FROM pos) SELECT ts FROM z WHERE (position = 0 AND b <> 0) OR position * b < 0 OR nx IS NULL")
def get_bet_timing(spark, d):
    return evaluation.get_bet_timing(positions(spark, d))


@query(
    f"""WITH RECURSIVE {POS}, n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts) AS i, (epoch_us(ts) - epoch_us(min(ts) OVER ())) / 86400000000.0 AS t FROM pos)
    , f AS (SELECT i, position AS p, 0::DOUBLE AS e, 0::DOUBLE AS held, 0::DOUBLE AS size FROM n WHERE i = 1
            UNION ALL SELECT n.i, n.position, CASE WHEN (n.position - f.p) * f.p >= 0 THEN CASE WHEN n.position <> 0 THEN (f.e * f.p + n.t * (n.position - f.p)) / n.position ELSE f.e END WHEN n.position * f.p < 0 THEN n.t ELSE f.e END,
              f.held + CASE WHEN (n.position - f.p) * f.p >= 0 THEN 0 WHEN n.position * f.p < 0 THEN (n.t - f.e) * abs(f.p) ELSE (n.t - f.e) * abs(n.position - f.p) END,
              f.size + CASE WHEN (n.position - f.p) * f.p >= 0 THEN 0 WHEN n.position * f.p < 0 THEN abs(f.p) ELSE abs(n.position - f.p) END FROM f JOIN n ON n.i = f.i + 1)
    SELECT {r('held / size AS days')} FROM f ORDER BY i DESC LIMIT 1"""
)
def get_holding_period(spark, d):
    return evaluation.get_holding_period(positions(spark, d))


# Bets: hourly events of every type with a probability and an end.
BETS = f"{HOURLY}, bets AS MATERIALIZED (SELECT k, ts, ts + INTERVAL (1 + hour(ts) % 5) HOUR AS t1, round(0.4 + (hour(ts) % 6) / 10.0, 6)::DOUBLE - 0.5 AS signal FROM hourly)"
ACTIVE = f"{BETS}, tm AS (SELECT k, ts FROM bets UNION SELECT k, t1 FROM bets), act AS (SELECT tm.k, tm.ts, avg(signal) AS signal FROM tm JOIN bets ON bets.k = tm.k AND bets.ts <= tm.ts AND tm.ts < bets.t1 GROUP BY tm.k, tm.ts)"


def bets(spark, d):
    h = F.hour("ts")
    return hourly(spark, d).select("k", "ts", (F.col("ts") + F.make_dt_interval(hours=1 + h % 5)).alias("t1"), (F.round(0.4 + (h % 6) / 10, 6) - 0.5).alias("signal"))


@query(f"WITH {ACTIVE} SELECT k, ts, {r('signal')} FROM act")
def avg_active_signals(spark, d):
    return evaluation.avg_active_signals(bets(spark, d), keys=K)


@query(f"WITH {BETS} SELECT k, ts, {r('greatest(-1, least(1, round_even(signal / 0.03, 0) * 0.03)) AS signal')} FROM bets")
def discrete_signal(spark, d):
    return bets(spark, d).select("k", "ts", scalars.discrete_signal("signal", 0.03).alias("signal"))


@query(f"WITH {BETS.replace('- 0.5 AS signal', '+ 0.02 AS prob')}, raw AS MATERIALIZED (SELECT k, ts, t1, prob, 2 * {phi_sql('(prob - 0.5) / sqrt(prob * (1 - prob))')} - 1 AS signal FROM bets), tm AS (SELECT k, ts FROM raw UNION SELECT k, t1 FROM raw), act AS (SELECT tm.k, tm.ts, avg(signal) AS signal FROM tm JOIN raw ON raw.k = tm.k AND raw.ts <= tm.ts AND tm.ts < raw.t1 GROUP BY tm.k, tm.ts) SELECT k, ts, {r('greatest(-1, least(1, round_even(signal / 0.05, 0) * 0.05)) AS signal')} FROM act")
def get_signal(spark, d):
    rows = bets(spark, d).withColumn("prob", F.col("signal") + 0.52)
    return evaluation.get_signal(rows, 0.05, "prob", 2, keys=K)


@query(f"WITH {BETS}, s AS (SELECT k, ts, 2 * (0.4 * {phi_sql('(hour(ts) - 12 + 3) / 2.0')} + 0.6 * {phi_sql('(hour(ts) - 12 - 4) / 3.0')}) - 1 AS size FROM bets) SELECT k, ts, {r('greatest(-1, least(1, size)) AS size')} FROM s")
def bet_size_mixture(spark, d):
    return bets(spark, d).select("k", "ts", evaluation.bet_size_mixture(F.hour("ts") - 12, -3.0, 4.0, 2.0, 3.0, 0.4).alias("size"))


@query(f"WITH a AS (SELECT p / 20.0 AS prob, atan((p / 20.0 - 0.5) / sqrt(p / 20.0 * (1 - p / 20.0) / 10) / 3) AS t, atan(p / 5.0 / 2) AS u FROM range(1, 20) g(p)) SELECT {r('prob', '2 / pi() * (t + sin(t) * (cos(t) + 2 / 3.0 * pow(cos(t), 3) + 8 / 15.0 * pow(cos(t), 5) + 48 / 105.0 * pow(cos(t), 7))) AS size', '0.5 + sin(u) * (1 + 0.5 * pow(cos(u), 2)) / 2 AS t_cdf')} FROM a")
def bet_size_ensemble(spark, d):
    return spark.createDataFrame([(p / 20, evaluation.bet_size_ensemble(p / 20, 10), t_cdf(p / 5, 4)) for p in range(1, 20)], "prob double, size double, t_cdf double")


X = "SELECT (1 + i)::DOUBLE AS i, 0.5 + i / 50.0 AS p, 10.0 + i AS n, 100 + i * 1.5 AS f, 0.01 + i / 100.0 AS a FROM range(20) t(i)"


def grid(spark):
    i = F.col("id").cast("double")
    return spark.range(20).select((i + 1).alias("i"), (0.5 + i / 50).alias("p"), (10 + i).alias("n"), (100 + i * 1.5).alias("f"), (0.01 + i / 100).alias("a"))


@query(
    f"""WITH x AS ({X}), y AS (SELECT i, i / sqrt(0.5 + i * i) AS bet_size, trunc(100 * (f - 101) / sqrt(25 + (f - 101) * (f - 101)))::INT AS target_pos, f - p * sqrt(25 / (1 - p * p)) AS inv_price, i * i * (1 / (p * p) - 1) AS w,
      CASE WHEN i::INT = 3 THEN f ELSE (SELECT coalesce(sum(f - (j / 100.0) * sqrt(25 / (1 - (j / 100.0) * (j / 100.0)))), 0) FROM range((CASE WHEN i >= 3 THEN 4 ELSE 2 END)::INT, i::INT + 1) t(j)) / (i - 3) END AS limit_price FROM x)
    SELECT i, {r('bet_size')}, target_pos, {r('inv_price', 'w', 'limit_price')} FROM y"""
)
def sizing_scalars(spark, d):
    g = grid(spark)
    return g.select("i", scalars.bet_size(0.5, "i").alias("bet_size"), scalars.get_target_pos(25.0, "f", 101.0, 100.0).alias("target_pos"), scalars.inv_price("f", 25.0, "p").alias("inv_price"), scalars.get_w("i", "p").alias("w"), scalars.limit_price("i", F.lit(3), "f", 25.0, 100.0).alias("limit_price"))


HR = "(-((2 * n * -1 - 4 * 3) * 3) + sqrt(pow((2 * n * -1 - 4 * 3) * 3, 2) - 4 * ((n + 4) * 9) * n)) / (2 * (n + 4) * 9)"
HR_SYM = "(-((2 * n * -1 - 4 * 2) * 2) + sqrt(pow((2 * n * -1 - 4 * 2) * 2, 2) - 4 * ((n + 4) * 4) * n)) / (2 * (n + 4) * 4)"


@query(
    f"""WITH x AS ({X}) SELECT i, {r('(1 - 0.2) * a / ((1 - 0.2) * a + 0.05) AS precision', '1 - p AS recall', '(1 - pow(0.2, n)) AS recall_k', '(1 - pow(0.2, n)) * a / ((1 - pow(0.2, n)) * a + 1 - pow(1 - 0.05, n)) AS precision_k')},
    {r('sqrt(n) * (2 * p - 1) / sqrt(4 * p * (1 - p)) AS symmetric', 'sqrt(n) * (3 * p - 1) / (3 * sqrt(p * (1 - p))) AS asymmetric')}, {r(HR + ' AS hit_rate')}, {r(HR_SYM + ' AS hit_rate_symmetric')},
    {r('pow(2 * 3, 2) * p * (1 - p) / pow(3 * p - 1, 2) AS freq', '-ln(2) / ln(p) AS half_life', 'ln(i / 0.5) / ln(60 / 0.5) AS cdf', '1 / (i * ln(60 / 0.5)) AS pdf')} FROM x"""
)
def strategy_scalars(spark, d):
    s, k = scalars, scalars.multi_test_precision_recall(0.05, 0.2, "a", "n")
    return grid(spark).select("i", s.strategy_precision(0.05, 0.2, "a").alias("precision"), s.strategy_recall("p").alias("recall"), k["recall"].alias("recall_k"), k["precision"].alias("precision_k"), s.sharpe_ratio_symmetric("p", "n").alias("symmetric"), s.sharpe_ratio_asymmetric("p", "n", -1.0, 2.0).alias("asymmetric"), s.bin_hr(-1.0, 2.0, "n", 2.0).alias("hit_rate"), s.implied_precision_symmetric("n", 2.0).alias("hit_rate_symmetric"), s.bin_freq(-1.0, 2.0, "p", 2.0).alias("freq"), s.ou_half_life("p").alias("half_life"), s.log_uniform_cdf("i", 0.5, 60).alias("cdf"), s.log_uniform_pdf("i", 0.5, 60).alias("pdf"))


@query("SELECT 20 AS splits, 10 AS paths, round(1 - (SELECT sum(c * pow(0.6, i) * pow(0.4, 10 - i)) FROM (VALUES (0, 1), (1, 10), (2, 45), (3, 120), (4, 210), (5, 252)) v(i, c)), 6) AS bagging, '0 4 7 10' AS lin, '0 6 8 10' AS nested")
def counting_scalars(spark, d):
    row = (scalars.get_num_splits(6, 3), scalars.get_num_backtest_paths(6, 3), scalars.bagging_accuracy(10, 0.6), " ".join(map(str, scalars.lin_parts(10, 3))), " ".join(map(str, scalars.nested_parts(10, 3))))
    return spark.createDataFrame([row], "splits int, paths int, bagging double, lin string, nested string")


@query()
def mix_gaussians(spark, d):
    return evaluation.mix_gaussians(spark, 0.05, -0.1, 0.05, 0.1, 0.75, 2600, seed=42).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("ret") > 0).cast("int")).alias("gains"))


@query(f"WITH {RET}, m AS (SELECT k, avg(ret) FILTER (WHERE ret > 0) AS u, avg(ret) FILTER (WHERE ret <= 0) AS s, avg((ret > 0)::INT) AS p FROM rets GROUP BY k), q AS (SELECT *, (260 + 1) * pow(u - s, 2) AS a, (2 * 260 * s - (u - s)) * (u - s) AS b, 260 * s * s AS c FROM m), z AS (SELECT k, ((-b + sqrt(b * b - 4 * a * c)) / (2 * a) - p) / sqrt(p * (1 - p) / 260) AS z FROM q) SELECT k, {r(phi_sql('z') + ' AS prob')} FROM z")
def prob_failure(spark, d):
    return evaluation.prob_failure(returns(spark, d), 260, 1.0, K)


PBO_SPLITS = "s AS (SELECT m FROM range(64) t(m) WHERE bit_count(m::BIGINT) = 3)"


@query(
    f"""WITH {RET}, t AS (SELECT ts, k, ret FROM rets WHERE ts IN (SELECT ts FROM rets GROUP BY ts HAVING count(*) = 5)), d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT ts FROM t))
    , p AS MATERIALIZED (SELECT k, i // (n // 6) AS part, ret FROM t JOIN d USING (ts) WHERE i // (n // 6) < 6), {PBO_SPLITS}
    , e AS (SELECT m, k, (avg(ret) FILTER (WHERE (m >> part::INT) & 1 = 1)) / (stddev_samp(ret) FILTER (WHERE (m >> part::INT) & 1 = 1)) AS a, (avg(ret) FILTER (WHERE (m >> part::INT) & 1 = 0)) / (stddev_samp(ret) FILTER (WHERE (m >> part::INT) & 1 = 0)) AS b FROM p, s GROUP BY m, k)
    , best AS (SELECT m, arg_max(b, a) AS bb FROM e GROUP BY m), om AS (SELECT e.m, greatest(1e-10, least(1 - 1e-10, count(*) FILTER (WHERE b < bb) / 4.0)) AS w FROM e JOIN best USING (m) GROUP BY e.m)
    SELECT {r('avg((ln(w / (1 - w)) <= 0)::INT) AS pbo', digits=4)}, count(*) AS n_splits, {r('avg(ln(w / (1 - w))) AS mean_logit', digits=4)} FROM om""",
    4,
)
def backtest_overfitting(spark, d):
    x = returns(spark, d)
    full = x.groupBy("ts").count().where("count = 5")
    return evaluation.probability_of_backtest_overfitting(x.join(full, "ts", "left_semi").withColumnRenamed("k", "trial"), 6)


@query(f"WITH {HOURLY}, z AS (SELECT k, close - 250 AS y, lag(close) OVER (PARTITION BY k ORDER BY ts) - 250 AS x FROM hourly), g AS (SELECT k, x, y, covar_pop(x, y) OVER (PARTITION BY k) / var_pop(x) OVER (PARTITION BY k) AS phi FROM z WHERE x IS NOT NULL) SELECT k, {r('any_value(phi) AS phi', 'stddev_pop(y - phi * x) AS sigma')} FROM g GROUP BY k")
def ou_fit(spark, d):
    return evaluation.ou_fit(hourly(spark, d), 250.0, K, "close").drop("half_life")


@query()
def otr_batch(spark, d):
    return evaluation.otr_batch(spark, [(0.0, 5.0, 1.0)], 2000, 50, [1.0, 2.0], [1.0, 2.0], seed=42)


@query()
def otr_main(spark, d):
    return evaluation.otr_main(spark, (5, 0), (5, 10), 1.0, 200, 50, 42, 3)


# Allocation, on the daily returns of the event types as assets.
COV = f"{RET}, cov AS MATERIALIZED (SELECT a.k AS i, b.k AS j, covar_samp(a.ret, b.ret) AS cov, count(*) AS n FROM rets a JOIN rets b ON a.ts = b.ts AND a.k <= b.k GROUP BY 1, 2)"


def asset_returns(spark, d):
    return returns(spark, d).withColumnRenamed("k", "asset")


@query(f"WITH {COV} SELECT i, j, {r('cov')}, n FROM cov")
def covariance(spark, d):
    return portfolio.covariance(asset_returns(spark, d))


CORR = f"{COV}, cr AS (SELECT c.i, c.j, CASE WHEN c.i = c.j THEN 1.0 ELSE greatest(-1, least(1, c.cov / sqrt(x.cov * y.cov))) END AS corr, sqrt(x.cov) AS si, sqrt(y.cov) AS sj FROM cov c JOIN cov x ON x.i = c.i AND x.j = c.i JOIN cov y ON y.i = c.j AND y.j = c.j)"


@query(f"WITH {CORR} SELECT i, j, {r('corr')} FROM cr")
def cov2corr(spark, d):
    return portfolio.cov2corr_long(portfolio.covariance(asset_returns(spark, d)))


@query(f"WITH {CORR} SELECT i, j, {r('corr * si * sj AS cov')} FROM cr")
def corr2cov(spark, d):
    cov = portfolio.covariance(asset_returns(spark, d))
    sd = cov.where("i = j").select(F.col("i").alias("a"), F.sqrt("cov").alias("sd"))
    return portfolio.corr2cov_long(portfolio.cov2corr_long(cov), sd)


@query(f"WITH {CORR} SELECT i, j, {r('sqrt((1 - corr) / 2) AS dist')} FROM cr")
def correl_dist(spark, d):
    return portfolio.cov2corr_long(portfolio.covariance(asset_returns(spark, d))).select("i", "j", scalars.correl_dist("corr").alias("dist"))


@query(f"WITH {COV} SELECT i AS asset, {r('1 / cov / sum(1 / cov) OVER () AS weight')} FROM cov WHERE i = j")
def get_ivp(spark, d):
    return portfolio.get_ivp_long(portfolio.covariance(asset_returns(spark, d)))


@query("WITH x AS (SELECT i, pow(1 - sqrt(0.1), 2) * 0.8 + i * 0.1 AS x FROM range(20) t(i)) SELECT i, round(CASE WHEN x BETWEEN 0.8 * pow(1 - sqrt(0.1), 2) AND 0.8 * pow(1 + sqrt(0.1), 2) THEN 10 / (2 * pi() * 0.8 * x) * sqrt(greatest(0, (0.8 * pow(1 + sqrt(0.1), 2) - x) * (x - 0.8 * pow(1 - sqrt(0.1), 2)))) ELSE 0 END, 6) + 0.0 AS pdf FROM x WHERE i > 0")
def mp_pdf(spark, d):
    return spark.range(1, 20).select(F.col("id").alias("i"), scalars.mp_pdf(0.8 * (1 - 0.1**0.5) ** 2 + F.col("id") * 0.1, 0.8, 10).alias("pdf"))


def vectors(spark, d, n: int):
    """ts, label 0 or 1, and the first n numbers of the embeddings as features."""
    e = table(spark, d, "embeddings")
    names = [f"x{i}" for i in range(n)]
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id") * 60)
    return e.select(at.alias("ts"), F.expr("timestamp_seconds(1700000000 + (vec_id + 2) * 60)").alias("t1"), (F.col("label") % 2).cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)]), names


def feature_cov(spark, d, n: int = 12) -> np.ndarray:
    rows, names = vectors(spark, d, n)
    return np.cov(rows.select(*names).toPandas().to_numpy(), rowvar=False)


def long(spark, m: np.ndarray, name: str = "value") -> DataFrame:
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], f"i int, j int, {name} double")


@query()
def denoise_cov(spark, d):
    return long(spark, portfolio.denoise_cov(feature_cov(spark, d), 500 / 12, 0.05))


@query()
def denoised_corr_shrinkage(spark, d):
    values, v = portfolio.get_pca(portfolio.cov2corr(feature_cov(spark, d)))
    return long(spark, portfolio.denoised_corr_shrinkage(values, v, 3, 0.5))


@query()
def detone_corr(spark, d):
    return long(spark, portfolio.detone_corr(portfolio.cov2corr(feature_cov(spark, d))))


@query()
def hrp_alloc(spark, d):
    return portfolio.hrp_alloc(asset_returns(spark, d))


@query()
def opt_port_nco(spark, d):
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(portfolio.opt_port_nco(feature_cov(spark, d), seed=42))], "asset int, weight double")


@query()
def hrp_mc(spark, d):
    return portfolio.hrp_mc(spark, 16)


@query()
def generated_data(spark, d):
    x, of = portfolio.generate_data(100, 3, 2, 0.25)
    return long(spark, np.corrcoef(x, rowvar=False), "corr")


# Features and learning.


@query()
def clusters_base(spark, d):
    rows, names = vectors(spark, d, 12)
    return clusters.cluster_kmeans_base(learning.assembled(rows, names), names, 6, 3, seed=42)


@query()
def clusters_top(spark, d):
    rows, names = vectors(spark, d, 12)
    return clusters.cluster_kmeans_top(learning.assembled(rows, names), names, 6, 3, seed=42)


@query()
def ortho_feats(spark, d):
    rows, names = vectors(spark, d, 8)
    return clusters.get_ortho_feats(rows, names, 0.95, ("ts",)).select("ts", F.abs("pc_1").alias("pc_1"))


@query()
def pca_weights(spark, d):
    w = clusters.pca_weights(feature_cov(spark, d, 5))
    tau = clusters.weighted_kendall_tau(np.array([0.55, 0.33, 0.07, 0.05]), np.array([1, 2, 4, 3]))
    return spark.createDataFrame([(i, abs(float(x)), tau) for i, x in enumerate(w)], "i int, weight double, tau double")


@query()
def effective_trials(spark, d):
    return redundancy.get_effective_trials(returns(spark, d).withColumnRenamed("k", "trial"), seed=42)


@query()
def deflated_sharpe_clustered(spark, d):
    trials = returns(spark, d).withColumnRenamed("k", "trial")
    return spark.createDataFrame([(redundancy.deflated_sharpe_ratio_clustered(0.5, trials, 252, seed=42),)], "dsr double")


@query()
def hrp_tree(spark, d):
    """The steps of the hierarchical allocation: order of the leaves and weights."""
    cov = feature_cov(spark, d)
    order = portfolio.get_quasi_diag(portfolio.tree_clustering(portfolio.cov2corr(cov)))
    w = portfolio.get_rec_bipart(cov, order)
    return spark.createDataFrame([(place, item, float(w[item]), portfolio.get_cluster_var(cov, order[: place + 1])) for place, item in enumerate(order)], "place int, asset int, weight double, head_var double")


@query()
def max_noise_eigenvalue(spark, d):
    values, _ = portfolio.get_pca(portfolio.cov2corr(feature_cov(spark, d)))
    return spark.createDataFrame([portfolio.find_max_eval(values, 500 / 12, 0.05)], "e_max double, var double")


@query(f"WITH {market.GAPS}, c AS (SELECT ts, close, close - gap AS rolled, lag(close) OVER (ORDER BY ts) AS c0, lag(close - gap) OVER (ORDER BY ts) AS r0 FROM gaps), p AS (SELECT ts, (rolled - r0) / c0 AS returns FROM c), q AS (SELECT *, product(1 + returns) OVER (ORDER BY ts) AS level FROM p) SELECT ts, {r('returns')}, CASE WHEN returns IS NOT NULL THEN {r('level / pow(10, floor(log10(abs(level)))) AS x').removesuffix(' AS x')} END AS mantissa, CASE WHEN returns IS NOT NULL THEN floor(log10(abs(level))) END AS exponent FROM q")
def roll_prices(spark, d):
    """The prices as a number from 1 to 10 and a power of ten, as they grow without bound."""
    level = F.col("r_prices")
    rows = market.futures.roll_and_rebase(market.contract_days(spark, d)).select("ts", "returns", level, F.floor(F.log10(F.abs(level))).cast("double").alias("exponent"))
    return rows.select("ts", "returns", (level / F.pow(F.lit(10.0), "exponent")).alias("mantissa"), "exponent")


@query()
def feat_imp_mdi(spark, d):
    rows, names = vectors(spark, d, 6)
    return learning.feat_importance(rows, names, 10, 3, method="MDI", seed=42)[0]


@query()
def feat_imp_mda(spark, d):
    rows, names = vectors(spark, d, 3)
    return learning.feat_imp_mda(DecisionTreeClassifier(weightCol="weight", seed=1), rows, names, validation.PurgedKFold(2), seed=42)


@query()
def feat_imp_sfi(spark, d):
    rows, names = vectors(spark, d, 3)
    return learning.feat_imp_sfi(LogisticRegression(weightCol="weight"), rows, names, validation.PurgedKFold(2), "accuracy")


@query()
def feat_imp_clustered(spark, d):
    rows, names = vectors(spark, d, 4)
    groups = {"a": names[:2], "b": names[2:]}
    forest = learning.build_random_forest(0.5, 8, 1, seed=42).fit(learning.assembled(rows, names))
    return learning.feat_imp_mdi_clustered(spark, forest, names, groups).unionByName(learning.feat_imp_mda_clustered(DecisionTreeClassifier(weightCol="weight", seed=1), rows, names, groups, 2, seed=42))


@query()
def hyper_fit(spark, d):
    rows, names = vectors(spark, d, 4)
    _, best, scores = learning.clf_hyper_fit(rows, names, lambda regParam: LogisticRegression(weightCol="weight", regParam=regParam), {"regParam": [0.01, 0.1]}, 2)
    return spark.createDataFrame([(best["regParam"], scores)], "reg_param double, scores array<double>")


@query()
def bagging(spark, d):
    rows, names = vectors(spark, d, 4)
    data = learning.assembled(rows, names)
    return learning.bagged(learning.bagging_classifier(data, DecisionTreeClassifier(weightCol="weight", seed=1), 3, 0.7, seed=42), data).select("ts", F.col("prob")[1].alias("prob"))


@query()
def test_data(spark, d):
    return learning.get_test_data(spark, 8, 3, 2, 200).select("label", "I_0", "R_0", "N_0")


@query("SELECT (i * i)::BIGINT AS square FROM range(20) t(i)")
def job_list(spark, d):
    return dispatch.job_list(spark, lambda n: {"square": n * n}, [{"n": i} for i in range(20)], "square long")


@query(f"WITH {DAILY} SELECT ts, {r('close * 2 AS close')} FROM daily")
def pandas_obj(spark, d):
    return dispatch.pandas_obj(daily(spark, d), lambda pdf: pdf.assign(close=pdf["close"] * 2), "ts timestamp, close double", "ts", 4)


@query(f"WITH RECURSIVE nw AS (SELECT id, (id + 1) / 20.0 AS p, 0::DOUBLE AS x, 0 AS step FROM range(18) g(id) UNION ALL SELECT id, p, x - ({phi_sql('x')} - p) * sqrt(2 * pi()) * exp(x * x / 2), step + 1 FROM nw WHERE step < 30), z AS (SELECT id, x, id / 4.0 - 2 AS v, atan((id / 4.0 - 2) / sqrt(5)) AS u FROM nw WHERE step = 30) SELECT id, {r(phi_sql('v') + ' AS cdf', 'x AS ppf', '0.5 + (u + sin(u) * (cos(u) + 2 / 3.0 * pow(cos(u), 3))) / pi() AS t')} FROM z")
def sql_functions(spark, d):
    register(spark)
    return spark.sql("SELECT id, norm_cdf(id / 4D - 2) AS cdf, norm_ppf((id + 1) / 20D) AS ppf, t_cdf(id / 4D - 2, 5D) AS t FROM range(18)")

