"""Queries on ticks, bars and labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars, futures, labeling, microstructure, sampling, weights
from tickloom.plans.inputs import HOURLY, TICKS, daily, hourly, r, rounded, table, ticks

K = ["k"]
ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
OHLCV = r("open", "high", "low", "close", "volume", "vwap")
AGG = "arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(volume) AS volume, CASE WHEN sum(volume) > 0 THEN sum(price * volume) / sum(volume) ELSE 0 END AS vwap"


def query(sql: str | None = None, digits: int = 6):
    def add(f):
        ENTRIES[f.__name__] = ((lambda spark, d: rounded(f(spark, d), digits)), sql)
        return f

    return add


def folded(state: str, init: str, step: str, done: str) -> str:
    """SQL for bars that a fold closes: state names, first values, next values given ``f`` and the row ``n``, and whether the bar closes."""
    return f"""WITH RECURSIVE {TICKS}
    , a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, seq) AS rn, sign(price - lag(price) OVER (PARTITION BY k ORDER BY ts, seq)) AS step FROM ticks)
    , n AS MATERIALIZED (SELECT *, coalesce(last_value(nullif(step, 0) IGNORE NULLS) OVER (PARTITION BY k ORDER BY rn ROWS UNBOUNDED PRECEDING), 1) AS sgn FROM a)
    , f AS (SELECT k, 0::BIGINT AS rn, {init}, false AS done FROM (SELECT DISTINCT k FROM ticks)
            UNION ALL SELECT k, rn, {state}, {done} FROM (SELECT n.k, n.rn, {step} FROM f JOIN n ON n.k = f.k AND n.rn = f.rn + 1))
    , g AS (SELECT n.*, f.done, coalesce(sum(f.done::INT) OVER (PARTITION BY f.k ORDER BY f.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bar_id FROM f JOIN n ON n.k = f.k AND n.rn = f.rn)
    SELECT k, bar_id, ts, {OHLCV} FROM (SELECT k, bar_id, max(ts) AS ts, {AGG}, bool_or(done) AS full_ FROM g GROUP BY k, bar_id) WHERE full_"""


def sum_sql(measure: str, threshold: float) -> str:
    return folded("total", "0::DOUBLE AS total", f"CASE WHEN f.done THEN 0 ELSE f.total END + {measure} AS total", f"total >= {threshold}")


A = "(2.0::DOUBLE / 21)"


def imbalance_sql(measure: str) -> str:
    return folded(
        "total, c, len_, each_",
        "0::DOUBLE AS total, 0::DOUBLE AS c, 100::DOUBLE AS len_, 0::DOUBLE AS each_",
        f"""CASE WHEN f.done THEN 0 ELSE f.total END + n.sgn * {measure} AS total, CASE WHEN f.done THEN 0 ELSE f.c END + 1 AS c,
            CASE WHEN f.done THEN {A} * f.c + (1 - {A}) * f.len_ ELSE f.len_ END AS len_, CASE WHEN f.done THEN {A} * (f.total / f.c) + (1 - {A}) * f.each_ ELSE f.each_ END AS each_""",
        "abs(total) >= greatest(abs(len_ * each_), 1.0)",
    )


TICK_RUNS_SQL = folded(
    "c, buys, len_, share",
    "0::DOUBLE AS c, 0::DOUBLE AS buys, 100::DOUBLE AS len_, 0.5::DOUBLE AS share",
    f"""CASE WHEN f.done THEN 0 ELSE f.c END + 1 AS c, CASE WHEN f.done THEN 0 ELSE f.buys END + (n.sgn > 0)::INT AS buys,
        CASE WHEN f.done THEN {A} * f.c + (1 - {A}) * f.len_ ELSE f.len_ END AS len_, CASE WHEN f.done THEN {A} * (f.buys / f.c) + (1 - {A}) * f.share ELSE f.share END AS share""",
    "greatest(buys, c - buys) >= greatest(len_ * greatest(share, 1 - share), 1.0)",
)


def runs_sql(measure: str) -> str:
    return folded(
        "bought, sold, c, buys, len_, share, pb, ps",
        "0::DOUBLE AS bought, 0::DOUBLE AS sold, 0::DOUBLE AS c, 0::DOUBLE AS buys, 100::DOUBLE AS len_, 0.5::DOUBLE AS share, 1::DOUBLE AS pb, 1::DOUBLE AS ps",
        f"""CASE WHEN f.done THEN 0 ELSE f.bought END + CASE WHEN n.sgn > 0 THEN {measure} ELSE 0 END AS bought, CASE WHEN f.done THEN 0 ELSE f.sold END + CASE WHEN n.sgn > 0 THEN 0 ELSE {measure} END AS sold,
            CASE WHEN f.done THEN 0 ELSE f.c END + 1 AS c, CASE WHEN f.done THEN 0 ELSE f.buys END + (n.sgn > 0)::INT AS buys,
            CASE WHEN f.done THEN {A} * f.c + (1 - {A}) * f.len_ ELSE f.len_ END AS len_, CASE WHEN f.done THEN {A} * (f.buys / f.c) + (1 - {A}) * f.share ELSE f.share END AS share,
            CASE WHEN f.done AND f.buys > 0 THEN {A} * (f.bought / f.buys) + (1 - {A}) * f.pb ELSE f.pb END AS pb,
            CASE WHEN f.done AND f.c > f.buys THEN {A} * (f.sold / (f.c - f.buys)) + (1 - {A}) * f.ps ELSE f.ps END AS ps""",
        "greatest(bought, sold) >= greatest(len_ * greatest(share * pb, (1 - share) * ps), 1.0)",
    )


@query(f"WITH {TICKS} SELECT k, ts, {OHLCV} FROM (SELECT k, date_trunc('hour', ts) AS ts, {AGG} FROM ticks GROUP BY k, date_trunc('hour', ticks.ts)) WHERE volume > 0")
def time_bars(spark, d):
    return bars.time_bars(ticks(spark, d), "1 hour", K)


@query(f"WITH {TICKS} SELECT k, ts, {OHLCV} FROM (SELECT k, date_trunc('week', ts)::TIMESTAMP AS ts, {AGG} FROM ticks GROUP BY k, date_trunc('week', ticks.ts)) WHERE volume > 0")
def time_bars_week(spark, d):
    return bars.time_bars(ticks(spark, d), "1 week", K)


@query(f"WITH {TICKS}, n AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY ts, seq) - 1) // 50 AS bar_id FROM ticks) SELECT k, bar_id, ts, {OHLCV} FROM (SELECT k, bar_id, max(ts) AS ts, {AGG}, count(*) AS c FROM n GROUP BY k, bar_id) WHERE c = 50")
def tick_bars(spark, d):
    return bars.tick_bars(ticks(spark, d), 50, K)


for _name, _of, _sql in (
    ("volume_bars", lambda t: bars.volume_bars(t, 2000, K), sum_sql("n.volume", 2000)),
    ("dollar_bars", lambda t: bars.dollar_bars(t, 100000, K), sum_sql("n.price * n.volume", 100000)),
    ("tick_imbalance_bars", lambda t: bars.tick_imbalance_bars(t, keys=K), imbalance_sql("1")),
    ("volume_imbalance_bars", lambda t: bars.volume_imbalance_bars(t, keys=K), imbalance_sql("n.volume")),
    ("dollar_imbalance_bars", lambda t: bars.dollar_imbalance_bars(t, keys=K), imbalance_sql("n.price * n.volume")),
    ("tick_runs_bars", lambda t: bars.tick_runs_bars(t, keys=K), TICK_RUNS_SQL),
    ("volume_runs_bars", lambda t: bars.volume_runs_bars(t, keys=K), runs_sql("n.volume")),
    ("dollar_runs_bars", lambda t: bars.dollar_runs_bars(t, keys=K), runs_sql("n.price * n.volume")),
):
    ENTRIES[_name] = ((lambda spark, d, of=_of: rounded(of(ticks(spark, d)))), _sql)

SIGNED = "a AS (SELECT *, sign(price - lag(price) OVER w) AS step FROM ticks WINDOW w AS (PARTITION BY k ORDER BY ts, seq)), signed AS MATERIALIZED (SELECT * EXCLUDE step, coalesce(last_value(nullif(step, 0) IGNORE NULLS) OVER (PARTITION BY k ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 1)::TINYINT AS sign FROM a)"
O = ["ts", "seq"]


@query(f"WITH {TICKS}, {SIGNED} SELECT seq, sign FROM signed")
def tick_rule(spark, d):
    return microstructure.tick_rule(ticks(spark, d), K, O).select("seq", "sign")


@query(
    f"""WITH RECURSIVE {HOURLY}, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) AS rn FROM hourly)
    , f AS (SELECT k, rn, ts, close, 0::DOUBLE AS up, 0::DOUBLE AS dn, false AS fell, false AS rose FROM n WHERE rn = 1
            UNION ALL SELECT k, rn, ts, close, up, dn, dn < -200, NOT dn < -200 AND up > 200 FROM (
              SELECT n.k, n.rn, n.ts, n.close, greatest(0, CASE WHEN f.rose THEN 0 ELSE f.up END + n.close - f.close) AS up, least(0, CASE WHEN f.fell THEN 0 ELSE f.dn END + n.close - f.close) AS dn FROM f JOIN n ON n.k = f.k AND n.rn = f.rn + 1))
    SELECT k, ts FROM f WHERE fell OR rose"""
)
def cusum_events(spark, d):
    return sampling.get_t_events(hourly(spark, d), 200.0, K)


@query(f"WITH {TICKS} SELECT k, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, seq) - 1 AS i FROM ticks) WHERE i % 7 = 0")
def sampling_step(spark, d):
    return sampling.sampling_linspace(ticks(spark, d), step=7, keys=K, order=O).select("k", "ts", "seq")


@query(f"WITH {TICKS} SELECT k, ts, seq FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM ticks) WHERE i % greatest(1, n // 100) = 0")
def sampling_linspace(spark, d):
    return sampling.sampling_linspace(ticks(spark, d), num_samples=100, keys=K, order=O).select("k", "ts", "seq")


@query()
def sampling_uniform(spark, d):
    return sampling.sampling_uniform(daily(spark, d), 100, seed=42)


ROLLS = "days AS MATERIALIZED (SELECT l_shipdate::TIMESTAMP AS ts, 'Q' || year(l_shipdate) || quarter(l_shipdate) AS instrument, min(l_extendedprice / l_quantity) AS open, max(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2)"
GAPS = f"{ROLLS}, j AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY instrument ORDER BY ts) = 1 AND row_number() OVER (ORDER BY ts) > 1 THEN open - lag(close) OVER (ORDER BY ts) ELSE 0 END AS jump FROM days), gaps AS (SELECT * EXCLUDE jump, sum(jump) OVER (ORDER BY ts) - sum(jump) OVER () AS gap FROM j)"


def contract_days(spark, d):
    li = table(spark, d, "lineitem")
    unit, at = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_shipdate")
    return li.groupBy(at.cast("timestamp").alias("ts"), F.concat(F.lit("Q"), F.year(at), F.quarter(at)).alias("instrument")).agg(F.min(unit).cast("double").alias("open"), F.max(unit).cast("double").alias("close"))


@query(f"WITH {GAPS} SELECT ts, instrument, {r('open', 'close', 'gap')} FROM gaps")
def roll_gaps(spark, d):
    return futures.roll_gaps(contract_days(spark, d))


@query(f"WITH {GAPS}, b AS (SELECT *, open - gap AS rolled_open, close - gap AS rolled_close FROM gaps), c AS (SELECT *, (rolled_close - lag(rolled_close) OVER (ORDER BY ts)) / lag(close) OVER (ORDER BY ts) AS returns FROM b) SELECT ts, instrument, {r('open', 'close', 'gap', 'rolled_open', 'rolled_close', 'returns')} FROM c")
def roll_and_rebase(spark, d):
    return futures.roll_and_rebase(contract_days(spark, d)).drop("r_prices")


WIDE = f"{HOURLY}, wide AS MATERIALIZED (SELECT ts, max(close) FILTER (WHERE k = 'click') AS a, max(close) FILTER (WHERE k = 'view') AS b FROM hourly GROUP BY ts HAVING count(DISTINCT k) FILTER (WHERE k IN ('click', 'view')) = 2)"


@query(f"WITH {WIDE}, z AS (SELECT *, first_value(a) OVER (ORDER BY ts) AS a0, first_value(b) OVER (ORDER BY ts) AS b0 FROM wide) SELECT ts, {r('1 + 0.6 / a0 * (a - a0) + 0.4 / b0 * (b - b0) AS value')} FROM z")
def etf_trick(spark, d):
    wide = hourly(spark, d).where("k IN ('click', 'view')").groupBy("ts").pivot("k", ["click", "view"]).agg(F.max("close")).dropna().withColumnsRenamed({"click": "a", "view": "b"})
    return futures.etf_trick(wide, wide.select("ts", F.lit(0.6).alias("a"), F.lit(0.4).alias("b")), ["a", "b"])


BG = f"""{HOURLY}, h AS (SELECT *, ln(high / low) ** 2 AS hl FROM hourly)
  , i AS (SELECT *, CASE WHEN count(*) OVER w = 2 THEN sum(hl) OVER w END AS two, CASE WHEN count(*) OVER w = 2 THEN ln(max(high) OVER w / min(low) OVER w) ** 2 END AS gamma FROM h WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
  , bg AS (SELECT *, CASE WHEN count(two) OVER w = 3 THEN avg(two) OVER w END AS beta FROM i WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {BG}, s AS (SELECT *, (sqrt(2) - 1) * sqrt(beta) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS x FROM bg), t AS (SELECT k, ts, CASE WHEN x < 0 THEN 0 ELSE x END AS alpha FROM s) SELECT k, ts, {r('alpha')}, {r('2 * (exp(alpha) - 1) / (1 + exp(alpha)) AS spread')} FROM t")
def corwin_schultz_spread(spark, d):
    return microstructure.corwin_schultz_spread(hourly(spark, d), 3, K).select("k", "ts", "alpha", "spread")


@query(f"WITH {BG}, s AS (SELECT *, (pow(2, -0.5) - 1) * sqrt(beta) / (sqrt(8 / pi()) * (3 - 2 * sqrt(2))) + sqrt(gamma / (8 / pi() * (3 - 2 * sqrt(2)))) AS x FROM bg) SELECT k, ts, {r('CASE WHEN x < 0 THEN 0 ELSE x END AS sigma')} FROM s")
def becker_parkinson_volatility(spark, d):
    return microstructure.becker_parkinson_volatility(hourly(spark, d), 3, K).select("k", "ts", "sigma")


@query(f"WITH {TICKS}, a AS (SELECT *, price - lag(price) OVER (PARTITION BY k ORDER BY ts, seq) AS x FROM ticks), b AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY ts, seq) AS y FROM a), c AS (SELECT k, (corr(x, y) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL)) * var_samp(x) AS c, var_samp(x) AS v FROM b GROUP BY k) SELECT k, {r('2 * sqrt(greatest(0, -c)) AS spread', 'greatest(0, v + 2 * c) AS noise_var')} FROM c")
def roll_model(spark, d):
    return microstructure.roll_model(ticks(spark, d), K, O)


@query(f"WITH {HOURLY} SELECT k, {r('sqrt(avg(ln(high / low) ** 2) / (4 * ln(2))) AS volatility')} FROM hourly GROUP BY k")
def high_low_volatility(spark, d):
    return microstructure.high_low_volatility(hourly(spark, d), K)


OLS = "greatest(syy - s * s * sxx, 0)"
T = f"s / sqrt({OLS} / greatest(n - 2, 1) / greatest(sxx, 1e-10))"


def ols_sql(name: str, y: str, x: str) -> str:
    return f"WITH {TICKS}, {SIGNED}, z AS (SELECT k, {y} AS y, {x} AS x FROM signed), g AS (SELECT k, regr_slope(y, x) AS s, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_count(y, x) AS n FROM z GROUP BY k) SELECT k, {r(f's AS {name}', f'{T} AS t_value')} FROM g"


def signed_ticks(spark, d):
    return microstructure.tick_rule(ticks(spark, d), K, O).withColumn("dollar_volume", F.col("price") * F.col("volume"))


@query(ols_sql("kyle_lambda", "price - lag(price) OVER (PARTITION BY k ORDER BY ts, seq)", "sign * volume"))
def kyle_lambda(spark, d):
    return microstructure.kyle_lambda(signed_ticks(spark, d), K, O)


@query(ols_sql("hasbrouck_lambda", "ln(price / lag(price) OVER (PARTITION BY k ORDER BY ts, seq))", "sign * sqrt(price * volume)"))
def hasbrouck_lambda(spark, d):
    return microstructure.hasbrouck_lambda(signed_ticks(spark, d), K, O)


@query(f"WITH {TICKS}, z AS (SELECT k, abs(ln(price / lag(price) OVER (PARTITION BY k ORDER BY ts, seq))) / (price * volume) AS x FROM ticks) SELECT k, {r('avg(x) AS amihud_lambda')} FROM z GROUP BY k")
def amihud_lambda(spark, d):
    return microstructure.amihud_lambda(signed_ticks(spark, d), K, O)


BUCKETS = f"""{TICKS}, {SIGNED}, c AS (SELECT *, sum(volume) OVER (PARTITION BY k ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS e FROM signed WHERE volume > 0)
  , x AS (SELECT *, unnest(range((floor((e - volume) / 500))::BIGINT, ceil(e / 500)::BIGINT)) AS bucket FROM c)
  , y AS (SELECT k, bucket, sign, least(e, (bucket + 1) * 500) - greatest(e - volume, bucket * 500) AS part FROM x)
  , full_ AS (SELECT k, bucket, coalesce(sum(part) FILTER (WHERE sign = 1), 0)::DOUBLE AS buy_volume, coalesce(sum(part) FILTER (WHERE sign = -1), 0)::DOUBLE AS sell_volume FROM y GROUP BY 1, 2 HAVING sum(part) >= 500)"""


@query(f"WITH {BUCKETS} SELECT k, bucket, buy_volume, sell_volume FROM full_")
def volume_bucket(spark, d):
    return microstructure.volume_bucket(ticks(spark, d), 500, K, O)


@query(f"WITH {BUCKETS} SELECT k, bucket, buy_volume, sell_volume, {r('CASE WHEN count(*) OVER w = 20 THEN sum(abs(buy_volume - sell_volume)) OVER w / 10000 END AS vpin')} FROM full_ WINDOW w AS (PARTITION BY k ORDER BY bucket ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def vpin(spark, d):
    return microstructure.vpin(ticks(spark, d), 500, 20, K, O)


# Labels. Events are every 10th hourly bar; the volatility target is the high-low range, so that SQL can say it.
H = f"{HOURLY}, hb AS MATERIALIZED (SELECT k, ts, close, high, low, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM hourly), ev AS MATERIALIZED (SELECT * FROM hb WHERE i % 10 = 0)"


def event_rows(spark, d):
    return sampling.sampling_linspace(hourly(spark, d), step=10, keys=K)


def target(spark, d):
    return hourly(spark, d).select("k", "ts", (F.col("high") / F.col("low") - 1).alias("volatility"))


VOL = """x AS MATERIALIZED (SELECT k, ts, i, close / lag(close) OVER (PARTITION BY k ORDER BY ts) - 1 AS ret FROM hb)
    , p AS (SELECT k, i, ts, 0::DOUBLE AS a, 0::DOUBLE AS b, 0::DOUBLE AS w, 0::DOUBLE AS w2 FROM x WHERE i = 0
            UNION ALL SELECT x.k, x.i, x.ts, p.a * (1 - 2.0::DOUBLE / 101) + x.ret, p.b * (1 - 2.0::DOUBLE / 101) + x.ret * x.ret, p.w * (1 - 2.0::DOUBLE / 101) + 1, p.w2 * (1 - 2.0::DOUBLE / 101) ** 2 + 1 FROM p JOIN x ON x.k = p.k AND x.i = p.i + 1)
    , vol AS MATERIALIZED (SELECT k, ts, CASE WHEN i = 0 THEN NULL WHEN i = 1 THEN 0.0 ELSE sqrt((b / w - (a / w) ** 2) * w * w / (w * w - w2)) END AS volatility FROM p)"""


@query(f"WITH RECURSIVE {H}, {VOL} SELECT k, ts, {r('volatility')} FROM vol")
def daily_volatility(spark, d):
    return labeling.daily_volatility(hourly(spark, d), 100, K)


@query(f"WITH {H} SELECT ev.k, ev.ts, b.ts AS t1 FROM ev JOIN hb b ON b.k = ev.k AND b.i = least(ev.i + 20, ev.n - 1)")
def add_vertical_barrier(spark, d):
    return labeling.add_vertical_barrier(event_rows(spark, d), hourly(spark, d), 20, K)


@query(f"WITH {H}, z AS (SELECT k, ts, lead(close, 5) OVER (PARTITION BY k ORDER BY ts) / close - 1 AS ret FROM hb) SELECT k, ts, {r('ret')}, (CASE WHEN ret > 0.1 THEN 1 WHEN ret < -0.1 THEN -1 ELSE 0 END)::TINYINT AS label FROM z WHERE ret IS NOT NULL")
def fixed_time_horizon(spark, d):
    return labeling.fixed_time_horizon(hourly(spark, d), 5, 0.1, K)


def barrier_sql(out: str, vertical: int | None = 20, pt: float = 1.0, sl: float = 1.0, side: str = "1", events: str = "ev", trgt: str = "high / low - 1", least: float = 0.5, more: str = "") -> str:
    last = f"least(ev.i + {vertical}, ev.n - 1)" if vertical else "ev.n - 1"
    return f"""WITH RECURSIVE {H}{more}, e AS (SELECT ev.k, ev.ts, ev.i, ev.n, ev.close AS p0, {trgt} AS trgt, {side} AS side, {last} AS vi FROM {events} WHERE {trgt} > {least})
    , hit AS (SELECT e.k, e.i, min(b.ts) FILTER (WHERE (b.close / p0 - 1) * side < -{sl} * trgt) AS sl_ts, min(b.ts) FILTER (WHERE (b.close / p0 - 1) * side > {pt} * trgt) AS pt_ts
              FROM e JOIN hb b ON b.k = e.k AND b.i BETWEEN e.i AND least(vi + 1, e.n - 1) GROUP BY 1, 2)
    , got AS (SELECT e.*, least(v.ts, sl_ts, pt_ts) AS t1 FROM e JOIN hit USING (k, i) JOIN hb v ON v.k = e.k AND v.i = vi)
    , bins AS (SELECT got.*, (b.close / p0 - 1) * side AS ret FROM got JOIN hb b ON b.k = got.k AND b.ts = got.t1)
    SELECT {out}"""


def barriers(spark, d):
    t1 = labeling.add_vertical_barrier(event_rows(spark, d), hourly(spark, d), 20, K)
    return labeling.get_events(hourly(spark, d), event_rows(spark, d), 1.0, target(spark, d), 0.5, t1, K)


@query(barrier_sql(f"k, ts, t1, {r('trgt')} FROM got"))
def get_events(spark, d):
    return barriers(spark, d).drop("event_id")


@query(barrier_sql(f"k, ts, t1, {r('trgt')} FROM got", vertical=None))
def get_events_open_ended(spark, d):
    return labeling.get_events(hourly(spark, d), event_rows(spark, d), 1.0, target(spark, d), 0.5, None, K).drop("event_id")


@query(barrier_sql("k, e.ts, pt_ts, sl_ts FROM e JOIN hit USING (k, i)"))
def apply_pt_sl_on_t1(spark, d):
    on = labeling.add_vertical_barrier(event_rows(spark, d), hourly(spark, d), 20, K)
    rows = on.join(target(spark, d).withColumnRenamed("volatility", "trgt"), ["k", "ts"]).where("trgt > 0.5").withColumn("side", F.lit(1.0)).withColumn("event_id", F.xxhash64("ts"))
    return labeling.apply_pt_sl_on_t1(rows, hourly(spark, d), 1.0, 1.0, K).select("k", "ts", "pt_ts", "sl_ts")


@query(barrier_sql(f"k, ts, t1, {r('ret')}, sign(ret)::TINYINT AS label FROM bins"))
def get_bins(spark, d):
    return labeling.get_bins(barriers(spark, d), hourly(spark, d), K)


SIDE = "CASE WHEN ev.i % 20 = 0 THEN 1.0 ELSE -1.0 END"


def sided(spark, d):
    side = event_rows(spark, d).select("k", "ts", F.when((F.row_number().over(weights.over(K, ["ts"])) - 1) % 2 == 0, 1.0).otherwise(-1.0).alias("side"))
    t1 = labeling.add_vertical_barrier(event_rows(spark, d), hourly(spark, d), 20, K)
    return labeling.get_events_meta(hourly(spark, d), event_rows(spark, d), (1.5, 0.5), target(spark, d), 0.5, t1, side, K)


@query(barrier_sql(f"k, ts, t1, {r('trgt')}, side::DOUBLE AS side FROM got", pt=1.5, sl=0.5, side=SIDE))
def get_events_meta(spark, d):
    return sided(spark, d).drop("event_id")


@query(barrier_sql(f"k, ts, t1, {r('ret')}, (CASE WHEN ret > 0 THEN 1 ELSE 0 END)::TINYINT AS label, side::DOUBLE AS side FROM bins", pt=1.5, sl=0.5, side=SIDE))
def get_bins_meta(spark, d):
    return labeling.get_bins_meta(sided(spark, d), hourly(spark, d), K)


@query(barrier_sql(f"k, ts, t1, {r('ret')}, sign(ret)::TINYINT AS label FROM bins", events="ev JOIN vol ON vol.k = ev.k AND vol.ts = ev.ts", trgt="volatility", least=0.0, more=f", {VOL}"))
def triple_barrier_labels(spark, d):
    return labeling.triple_barrier_labels(hourly(spark, d), event_rows(spark, d), 1.0, 20, keys=K)


@query(f"WITH {H}, g AS (SELECT k, regr_slope(close, i) AS s, regr_sxx(close, i) AS sxx, regr_syy(close, i) AS syy, count(*) AS n FROM hb GROUP BY k) SELECT k, {r(f's / sqrt({OLS} / (n - 2) / sxx) AS t_value')} FROM g")
def t_value_linear_trend(spark, d):
    return labeling.t_value_linear_trend(hourly(spark, d), K)


@query(
    f"""WITH {H}, hz AS (SELECT unnest([5, 10, 15]) AS h), z AS (SELECT ev.k, ev.ts, ev.i, h FROM ev, hz WHERE ev.i + 15 <= ev.n AND ev.i + h < ev.n)
    , g AS (SELECT z.k, z.ts, h, regr_slope(b.close, b.i - z.i) AS s, regr_sxx(b.close, b.i - z.i) AS sxx, regr_syy(b.close, b.i - z.i) AS syy, count(*) AS n, max(b.ts) AS t1 FROM z JOIN hb b ON b.k = z.k AND b.i BETWEEN z.i AND z.i + h GROUP BY 1, 2, 3)
    , t AS (SELECT *, s / sqrt({OLS} / (n - 2) / sxx) AS tv FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY abs(tv) DESC, h) AS rk FROM t)
    SELECT k, ts, t1, {r('tv AS t_val')}, sign(tv)::TINYINT AS label FROM o WHERE rk = 1"""
)
def trend_scanning_labels(spark, d):
    return labeling.trend_scanning_labels(hourly(spark, d), event_rows(spark, d), [5, 10, 15], K)


# Weights. Labels run from every 10th bar to the 25th bar after it, so they overlap.
LAB = f"{H}, lab AS MATERIALIZED (SELECT ev.k, ev.ts, ev.i AS a, least(ev.i + 25, ev.n - 1) AS z, b.ts AS t1 FROM ev JOIN hb b ON b.k = ev.k AND b.i = least(ev.i + 25, ev.n - 1)), co AS MATERIALIZED (SELECT hb.k, hb.ts, hb.i, hb.close, count(lab.ts)::DOUBLE AS c, ln(close / lag(close) OVER (PARTITION BY hb.k ORDER BY hb.i)) AS lr FROM hb LEFT JOIN lab ON lab.k = hb.k AND hb.i BETWEEN a AND z GROUP BY hb.k, hb.ts, hb.i, hb.close)"


def label_spans(spark, d):
    return labeling.add_vertical_barrier(event_rows(spark, d), hourly(spark, d), 25, K)


def concurrency(spark, d):
    return weights.num_co_events(hourly(spark, d), label_spans(spark, d), K)


@query(f"WITH {LAB} SELECT co.k, co.ts, c AS num_co_events FROM co JOIN (SELECT k, min(a) AS a, max(z) AS z FROM lab GROUP BY k) s ON s.k = co.k AND co.i BETWEEN s.a AND s.z + 1")
def num_co_events(spark, d):
    return concurrency(spark, d)


@query(f"WITH {LAB} SELECT lab.k, lab.ts, {r('avg(1 / c) AS uniqueness')} FROM lab JOIN co ON co.k = lab.k AND co.i BETWEEN a AND z GROUP BY lab.k, lab.ts")
def sample_tw(spark, d):
    return weights.sample_tw(hourly(spark, d), label_spans(spark, d), concurrency(spark, d), K)


@query(f"WITH {LAB} SELECT lab.k, lab.ts, {r('abs(sum(coalesce(lr, 0) / c)) AS weight')} FROM lab JOIN co ON co.k = lab.k AND co.i BETWEEN a AND z GROUP BY lab.k, lab.ts")
def sample_w(spark, d):
    return weights.sample_w(hourly(spark, d), label_spans(spark, d), concurrency(spark, d), K)


def numbered(spark, d):
    return label_spans(spark, d).withColumn("event_id", F.row_number().over(weights.over(K, ["ts"])) - 1)


@query(f"WITH {LAB} SELECT lab.k, co.i, (lab.a // 10) AS event_id FROM lab JOIN co ON co.k = lab.k AND co.i BETWEEN a AND z")
def get_ind_matrix(spark, d):
    return weights.get_ind_matrix(hourly(spark, d), numbered(spark, d), K).select("k", "i", F.col("event_id").cast("long"))


@query(f"WITH {LAB} SELECT lab.k, (lab.a // 10) AS event_id, {r('avg(1 / c) AS uniqueness')} FROM lab JOIN co ON co.k = lab.k AND co.i BETWEEN a AND z GROUP BY 1, 2")
def get_avg_uniqueness(spark, d):
    return weights.get_avg_uniqueness(weights.get_ind_matrix(hourly(spark, d), numbered(spark, d), K), K).select("k", F.col("event_id").cast("long"), "uniqueness")


@query()
def seq_bootstrap(spark, d):
    return weights.seq_bootstraps(hourly(spark, d), numbered(spark, d), replicates=4, seed=42, keys=K)


@query(f"WITH {LAB}, u AS (SELECT lab.k, lab.ts, avg(1 / c) AS u FROM lab JOIN co ON co.k = lab.k AND co.i BETWEEN a AND z GROUP BY 1, 2), s AS (SELECT *, sum(u) OVER (PARTITION BY k ORDER BY ts) AS cu, sum(u) OVER (PARTITION BY k) AS tot FROM u) SELECT k, ts, {r('greatest(0, 1 - (1 - 0.5) / tot * tot + (1 - 0.5) / tot * cu) AS weight')} FROM s")
def get_time_decay(spark, d):
    return weights.get_time_decay(weights.sample_tw(hourly(spark, d), label_spans(spark, d), concurrency(spark, d), K), 0.5, K)


@query("WITH c AS (SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey, o_orderstatus AS label FROM orders JOIN c ON c.label = o_orderstatus")
def drop_labels(spark, d):
    return weights.drop_labels(table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label")), 0.0)


@query(f"WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, {r('sum(n) OVER () / (count(*) OVER () * n) AS weight')} FROM c")
def get_class_weights(spark, d):
    return weights.get_class_weights(table(spark, d, "orders").select(F.col("o_orderpriority").alias("label")))


def flagship(spark, sf_dir):
    b = hourly(spark, sf_dir)
    events = sampling.get_t_events(b, 200.0, K)
    labels = labeling.triple_barrier_labels(b, events, 1.0, 20, keys=K)
    co = weights.num_co_events(b, labels, K)
    return labels.join(weights.sample_tw(b, labels, co, K), ["k", "ts"])

