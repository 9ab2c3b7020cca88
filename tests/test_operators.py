"""Known values, properties and plain versions of the operators."""

import gc
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import scalars
from tickloom.functions.statistics import adf, adf_p_value, bounded_minimum, phi, phi_column, t_cdf
from tickloom.operators import bars, breaks, clusters, entropy, evaluation, fracdiff, labeling, learning, microstructure, portfolio, sampling, validation, weights


def series(spark, values, name="close", step="1 day"):
    ts = pd.date_range("2024-01-01", periods=len(values), freq={"1 day": "D", "1 min": "min"}[step])
    return spark.createDataFrame(pd.DataFrame({"ts": ts, name: np.asarray(values, float)}))


def ticks_of(spark, price, volume):
    ts = pd.date_range("2024-01-01", periods=len(price), freq="s")
    return spark.createDataFrame(pd.DataFrame({"ts": ts, "seq": np.arange(len(price)), "price": np.asarray(price, float), "volume": np.asarray(volume, float)}))


def test_tick_rule(spark):
    got = microstructure.tick_rule(ticks_of(spark, [100, 101, 101, 99, 100], [1] * 5)).orderBy("ts").select("sign")
    assert [r[0] for r in got.collect()] == [1, 1, 1, -1, 1]


def test_cusum_fires_at_the_jump(spark):
    got = sampling.get_t_events(series(spark, [100] * 50 + [105] * 50), 3.0).collect()
    assert [r["ts"].strftime("%m-%d") for r in got] == ["02-20"]


def test_ruled_bars_keep_volume_and_order(spark):
    rng = np.random.default_rng(42)
    t = ticks_of(spark, 100 + np.cumsum(rng.normal(size=1000) * 0.1), rng.uniform(1, 100, 1000))
    total = t.agg(F.sum("volume")).first()[0]
    for f in (lambda x: bars.volume_bars(x, 500), lambda x: bars.dollar_bars(x, 50_000), bars.tick_imbalance_bars, bars.tick_runs_bars, bars.volume_runs_bars, bars.dollar_runs_bars, bars.volume_imbalance_bars, bars.dollar_imbalance_bars):
        got = f(t).orderBy("bar_id").toPandas()
        assert len(got) and got["volume"].sum() <= total + 1e-6
        assert (got["low"] <= got[["open", "close"]].min(axis=1)).all() and (got["high"] >= got[["open", "close"]].max(axis=1)).all()
        assert got["ts"].is_monotonic_increasing and got["vwap"].between(got["low"] - 1e-9, got["high"] + 1e-9).all()


#: Bars that a rule closes: the operator on keyed ticks and a new rule for a plain fold.
RULED = {
    "volume_runs_bars": (lambda t: bars.volume_runs_bars(t, keys=["k"]), lambda: bars.Runs("volume")),
    "dollar_imbalance_bars": (lambda t: bars.dollar_imbalance_bars(t, keys=["k"]), lambda: bars.Imbalance("money")),
    "volume_imbalance_bars": (lambda t: bars.volume_imbalance_bars(t, keys=["k"]), lambda: bars.Imbalance("volume")),
    "tick_imbalance_bars": (lambda t: bars.tick_imbalance_bars(t, keys=["k"]), lambda: bars.Imbalance("ticks")),
    "dollar_runs_bars": (lambda t: bars.dollar_runs_bars(t, keys=["k"]), lambda: bars.Runs("money")),
    "tick_runs_bars": (lambda t: bars.tick_runs_bars(t, keys=["k"]), lambda: bars.TickRuns()),
    "volume_bars": (lambda t: bars.volume_bars(t, 60, ["k"]), lambda: bars.Sum(60, "volume")),
    "dollar_bars": (lambda t: bars.dollar_bars(t, 6000, ["k"]), lambda: bars.Sum(6000, "money")),
}


def plain_bars(ticks, rule):
    """The bars of one series tick by tick."""
    r, sign, before, rows, out = rule(), 1.0, None, [], []
    for t in ticks.sort_values(["ts", "seq"]).itertuples():
        if before is not None and t.price != before:
            sign = 1.0 if t.price > before else -1.0
        before = t.price
        rows.append(t)
        if r.closes(t.price, t.volume, sign):
            p, v = [x.price for x in rows], [x.volume for x in rows]
            out.append((t.k, len(out), t.ts, p[0], max(p), min(p), p[-1], sum(v), sum(x * y for x, y in zip(p, v, strict=True)) / sum(v)))
            rows = []
    return out


@pytest.mark.parametrize("name", RULED)
def test_ruled_bars_hold_a_batch_of_a_series(spark, name):
    f, rule = RULED[name]
    batch, n, rng = 50, 1500, np.random.default_rng(7)

    class Watched(bars.Rule):
        def __init__(self):
            self.rule, self.seen = rule(), 0

        def closes(self, *tick):
            self.seen += 1
            if self.seen % 100 == 0 and (most := max(len(x) for x in gc.get_objects() if isinstance(x, pd.DataFrame))) > batch:
                raise MemoryError(f"{most} rows of a series at once")
            return self.rule.closes(*tick)

    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 400, n), "s")
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], n), "ts": ts, "seq": rng.permutation(n), "price": 100 + np.round(np.cumsum(rng.normal(size=n)), 1), "volume": rng.integers(1, 9, n).astype(float)})
    t = spark.createDataFrame(pdf).repartition(3)
    want = [row for k in ("a", "b") for row in plain_bars(pdf[pdf["k"] == k], rule)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        for df in (f(t), bars.ruled_bars(t, Watched, ["k"])):
            got = sorted(map(tuple, df.collect()))
            assert len(got) == len(want) >= 10 and [x[:7] for x in got] == [x[:7] for x in want]
            assert np.allclose([x[7:] for x in got], [x[7:] for x in want], rtol=1e-12)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_ticks_no_bars(spark):
    none = ticks_of(spark, [1.0], [1.0]).where("false")
    assert bars.volume_bars(none, 10).collect() == [] and bars.tick_bars(none, 10).collect() == [] and bars.time_bars(none, "1 hour").collect() == []
    with pytest.raises(ValueError, match="volume"):
        bars.volume_bars(none.drop("volume"), 10)


def test_sampling(spark):
    s = series(spark, range(100))
    assert sampling.sampling_linspace(s, num_samples=10).count() == 10 and sampling.sampling_uniform(s, 7, 1).count() == 7 and sampling.sampling_random(s, 7, 1).count() == 7
    assert sampling.sampling_linspace(s, num_samples=500).count() == 100
    with pytest.raises(ValueError):
        sampling.sampling_linspace(s)


def test_fractional_weights():
    assert fracdiff.get_weights(1.0, 4).tolist() == [0, 0, -1, 1]
    w = fracdiff.get_weights_ffd(0.5, 1e-3)
    assert w[-1] == 1 and abs(w[0]) >= 1e-3 and len(fracdiff.get_weights_ffd(0.3, 0.0, 50)) == 50


def test_fractional_orders_0_and_1(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=60)) + 100
    s = series(spark, x)
    same = fracdiff.frac_diff_ffd(s, 0.0).orderBy("ts").toPandas()["value"]
    step = fracdiff.frac_diff_ffd(s, 1.0).orderBy("ts").toPandas()["value"]
    assert np.allclose(same, x) and np.allclose(step, np.diff(x))


def test_distributions():
    assert np.allclose(phi(np.array([0, 1.96, -1])), [0.5, 0.9750021, 0.1586553])
    assert abs(t_cdf(2.0, 5) - 0.9490302) < 1e-6 and abs(t_cdf(1.0, 1) - 0.75) < 1e-12
    assert abs(bounded_minimum(lambda v: (v - 0.3) ** 2, 0, 1) - 0.3) < 1e-6
    assert abs(adf_p_value(-2.8615) - 0.05) < 2e-3
    rng = np.random.default_rng(2)
    assert adf(np.cumsum(rng.normal(size=400)))[1] > 0.01 and adf(rng.normal(size=400))[1] < 1e-6


def test_psr_and_dsr(spark):
    row = spark.range(1).select(evaluation.probabilistic_sharpe_ratio(F.lit(0.1), 0.0, 50).alias("p")).first()
    assert abs(row["p"] - 0.7575) < 1e-3
    assert abs(evaluation.deflated_sharpe_ratio(0.1, [0.05, 0.08, 0.1], 50) - 0.7083) < 1e-3


def test_drawdown(spark):
    s = series(spark, [100, 110, 105, 108, 115], "pnl")
    assert [r[0] for r in evaluation.drawdown(s, True).orderBy("ts").select("drawdown").collect()] == [0, 0, 5, 2, 0]
    assert [r["tuw_days"] for r in evaluation.time_under_water(s).collect()] == [3.0]


def test_bets(spark):
    assert evaluation.bet_size_ensemble(0.5, 10) == 0 and 0 < evaluation.bet_size_ensemble(0.7, 10) < 1
    with pytest.raises(ValueError):
        evaluation.bet_size_ensemble(0.5, 1)
    got = spark.createDataFrame([(0.33,), (1.7,), (-2.0,)], "s double").select(scalars.discrete_signal("s", 0.1).alias("x")).collect()
    assert np.allclose([r["x"] for r in got], [0.3, 1.0, -1.0])
    assert abs(spark.range(1).select(scalars.ou_half_life(0.5).alias("h")).first()["h"] - 1) < 1e-12


def test_uniqueness_of_disjoint_and_equal_labels(spark):
    c = series(spark, range(1, 41))
    e = c.withColumn("i", F.dayofyear("ts")).where("i IN (1, 11, 21)").select("ts", F.expr("ts + INTERVAL 4 DAY").alias("t1"))
    co = weights.num_co_events(c, e)
    assert {round(r["uniqueness"], 9) for r in weights.sample_tw(c, e, co).collect()} == {1.0}
    both = e.unionByName(e.withColumn("t1", F.col("t1")))
    assert {round(r["uniqueness"], 9) for r in weights.sample_tw(c, both, weights.num_co_events(c, both)).collect()} == {0.5}
    assert set(r["weight"] for r in weights.get_time_decay(weights.sample_tw(c, e, co)).collect()) == {1.0}


def test_sequential_bootstrap_prefers_unique_labels():
    starts, ends = np.array([0, 0, 0, 10]), np.array([10, 10, 10, 20])
    hits = np.zeros(4)
    for k in range(400):
        hits += np.bincount(weights.seq_bootstrap(starts, ends, 4, np.random.default_rng(k)), minlength=4)
    assert hits[3] > 1.2 * hits[:3].mean()


def test_barriers_touch_the_first_bar_beyond(spark):
    c = series(spark, [100, 101, 103, 99, 95, 100])
    ev = c.orderBy("ts").limit(1).select("ts")
    trgt = ev.withColumn("volatility", F.lit(0.02))
    got = labeling.get_events(c, ev, 1.0, trgt, 0.0).first()
    assert got["t1"].day == 3
    assert labeling.get_bins(labeling.get_events(c, ev, 1.0, trgt, 0.0), c).first()["label"] == 1
    with pytest.raises(ValueError):
        labeling.validate_t1(ev)


def test_rare_labels_go(spark):
    e = spark.createDataFrame([(1,)] * 90 + [(0,)] * 5 + [(-1,)] * 5, "label int")
    assert {r["label"] for r in weights.drop_labels(e, 0.08).collect()} == {1}
    w = {r["label"]: r["weight"] for r in weights.get_class_weights(e).collect()}
    assert abs(w[1] - 100 / 270) < 1e-12


def test_entropy_of_strings():
    assert entropy.match_length("11100001", 4, 4)[0] >= 1 and entropy.match_length("1010", 2, 2) == (3, "10")
    assert "".join(entropy.lempel_ziv("1011010100010")) == "1011010100010"[: len("".join(entropy.lempel_ziv("1011010100010")))]
    regular, mixed = entropy.kontoyiannis("01" * 50)[3], entropy.kontoyiannis("".join(np.random.default_rng(1).choice(list("01"), 100)))[3]
    assert regular < mixed and entropy.kontoyiannis("")[3] == 0
    assert abs(entropy.portfolio_concentration(np.ones(4) / 4, np.eye(4))) < 1e-9


def plain_sadf(x, min_sl, lags):
    out = []
    for end in range(min_sl, len(x)):
        y, z = breaks.design(x[: end + 1], "c", lags)
        best = []
        for start in range(len(y) + lags - min_sl + 1):
            b, v = breaks.ols(y[start:], z[start:])
            if len(y) - start >= z.shape[1] + 1 and np.isfinite(b).all():
                best.append(b[0] / math.sqrt(v[0, 0]))
        out.append(max(best))
    return out


def test_sadf_equals_regressions_one_by_one(spark):
    x = np.cumsum(np.random.default_rng(3).normal(size=70) * 0.01) + 4
    got = breaks.sadf_test(series(spark, x, "log_p"), 20).orderBy("ts").toPandas()["sadf"]
    assert np.allclose(got, plain_sadf(x, 20, 1), atol=1e-5)
    bubble = np.concatenate([x, x[-1] + 0.02 * np.expm1(np.arange(40) * 0.12)])
    assert breaks.sadf_test(series(spark, bubble, "log_p"), 20).agg(F.max("sadf")).first()[0] > 2


def test_break_queries_take_the_whole_series(spark):
    from tickloom.plans import models

    d = "/root/testdata/sf0.001"
    x = models.daily(spark, d).orderBy("ts").toPandas()["close"].to_numpy()
    last = {f: models.ENTRIES[f][0](spark, d).orderBy("ts").toPandas().iloc[-1] for f in ("sadf_test", "qadf_test", "cadf_test")}
    assert len(x) > 160 and models.ENTRIES["sadf_test"][0](spark, d).count() == len(x) - 30
    y, z = breaks.design(np.log(x), "c", 1)
    t = []
    for start in range(len(x) - 30):
        if len(y) - start >= z.shape[1] + 1:
            b, v = breaks.ols(y[start:], z[start:])
            t.append(b[0] / np.sqrt(v[0, 0]))
    t, q = np.array(t), np.quantile(t, 0.95)
    assert np.allclose([last["sadf_test"]["sadf"], last["qadf_test"]["qadf"], last["cadf_test"]["cadf_mean"], last["cadf_test"]["cadf_var"]], [t.max(), q, t[t >= q].mean(), t[t >= q].var()], atol=1e-4)
    assert models.ENTRIES["brown_durbin_evans"][0](spark, d).count() == len(x) - 2 - 5
    assert models.ENTRIES["chow_dickey_fuller"][0](spark, d).count() == len(x) - 2 - 40


def evaluation_raw(p):
    """Sizes of two-class bets of probability p."""
    return np.array([2 * phi((x - 0.5) / math.sqrt(x * (1 - x))) - 1 for x in p])


def test_bet_queries_take_every_series(spark):
    from tickloom.plans import models

    d = "/root/testdata/sf0.001"
    bets = models.bets(spark, d).toPandas()
    sizes, signals = (models.ENTRIES[f][0](spark, d).toPandas() for f in ("bet_size_mixture", "get_signal"))
    assert bets["k"].nunique() > 1 and len(sizes) == len(bets)
    for k, own in bets.groupby("k"):
        x = signals[signals["k"] == k].set_index("ts")["signal"]
        raw = evaluation_raw(own["signal"] + 0.52)
        for t in x.index[:: max(1, len(x) // 20)]:
            alive = ((own["ts"] <= t) & (t < own["t1"])).to_numpy()
            assert abs(raw[alive].mean() - x[t]) <= 0.025 + 1e-6


def test_folds_do_not_leak(spark):
    o = series(spark, range(60)).select("ts", F.expr("ts + INTERVAL 3 DAY").alias("t1"))
    pdf = o.orderBy("ts").toPandas()
    want = validation.purged_folds(pdf["ts"].to_numpy(), pdf["t1"].to_numpy(), 4, 0.05)
    got = validation.PurgedKFold(4, 0.05).split(o).toPandas()
    for s, (train, test) in enumerate(want):
        part = got[got["split"] == s]
        assert sorted(part[part.role == "test"].ts) == list(pdf.ts[test]) and sorted(part[part.role == "train"].ts) == list(pdf.ts[train])
    cv = validation.CombinatorialPurgedKFold(6, 2)
    split = cv.split(o).toPandas()
    assert split["split"].nunique() == 15 and len(validation.backtest_partitions(6, 2)) == 5 and validation.backtest_partitions(5, 2) == []
    assert not split.duplicated(["split", "ts"]).any()
    with pytest.raises(ValueError):
        validation.CombinatorialPurgedKFold(2, 2)


def test_backtest_overfitting_of_noise_and_skill(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(240, 8)) * 0.01
    rows = lambda m: spark.createDataFrame(pd.DataFrame(m).assign(ts=pd.date_range("2024-01-01", periods=len(m))).melt("ts", var_name="trial", value_name="ret").astype({"trial": str}))
    noise = evaluation.probability_of_backtest_overfitting(rows(x), 8).first()
    x[:, 3] += 0.02
    skill = evaluation.probability_of_backtest_overfitting(rows(x), 8).first()
    assert noise["n_splits"] == 70 and noise["pbo"] > 0.2 and skill["pbo"] == 0


def test_portfolios():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    x[:, 1] = x[:, 0] + 0.2 * x[:, 1]
    cov = np.cov(x, rowvar=False)
    w = portfolio.hrp_weights(cov)
    assert abs(w.sum() - 1) < 1e-12 and (w > 0).all() and w[0] + w[1] < w[2] + w[3]
    link = portfolio.tree_clustering(portfolio.cov2corr(cov))
    assert sorted(portfolio.get_quasi_diag(link)) == list(range(5)) and set(link[0, :2]) == {0, 1}
    for m in ("complete", "average"):
        assert portfolio.tree_clustering(portfolio.cov2corr(cov), m)[-1, 3] == 5
    d = portfolio.denoise_cov(cov, 100, 0.01)
    assert np.allclose(np.diag(d), np.diag(cov)) and np.allclose(d, d.T)
    assert np.allclose(np.diag(portfolio.detone_corr(portfolio.cov2corr(cov))), 1)
    assert abs(portfolio.opt_port_nco(cov).sum() - 1) < 1e-9 and abs(portfolio.opt_port(cov, np.ones(5)).sum() - 1) < 1e-12
    x2, of = portfolio.generate_data(400, 3, 2, 0.1)
    assert x2.shape == (400, 5) and np.corrcoef(x2[:, 3], x2[:, of[0]])[0, 1] > 0.9
    assert abs(portfolio.marchenko_pastur(1.0, 10)[1].sum() * np.diff(portfolio.marchenko_pastur(1.0, 10)[0])[0] - 1) < 0.01


def test_clusters():
    rng = np.random.default_rng(2)
    common = rng.normal(size=(400, 3))
    x = np.repeat(common, 4, axis=1) + 0.3 * rng.normal(size=(400, 12))
    for find in (clusters.best_clusters, clusters.top_clusters):
        labels, s = find(np.corrcoef(x, rowvar=False), 8)
        assert len(set(labels)) == 3 and all(len(set(labels[i : i + 4])) == 1 for i in (0, 4, 8)) and s.min() > 0.3
    assert clusters.weighted_kendall_tau(np.array([3.0, 2, 1]), np.array([1, 2, 3])) == pytest.approx(1)
    w = clusters.pca_weights(np.diag([4.0, 1.0]))
    assert np.allclose(np.abs(w), [0, 1])


def test_informative_features_matter(spark):
    rows = learning.get_test_data(spark, 5, 2, 1, 300, seed=3)
    names = [c for c in rows.columns if c[1:2] == "_"]
    forest = learning.build_random_forest(0.7, 12, 0, seed=1).fit(learning.assembled(rows, names))
    imp = {r["feature"]: r["mean"] for r in learning.feat_imp_mdi(spark, forest, names).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and max(imp["I_0"], imp["I_1"], imp["R_0"]) > max(imp["N_0"], imp["N_1"])
    with pytest.raises(ValueError):
        learning.build_random_forest(None, 10, 1)
    drawn = learning.draws({"a": [1, 2], "b": (0.01, 10.0)}, 50, 1)
    assert all(0.01 <= s["b"] <= 10 and s["a"] in (1, 2) for s in drawn)


def test_same_rows_with_other_partitions(spark):
    t = ticks_of(spark, 100 + np.cumsum(np.random.default_rng(5).normal(size=500)), np.ones(500) * 3)
    got = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(tuple, bars.volume_imbalance_bars(t.repartition(5)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


@pytest.mark.parametrize("n", [1, 200, 100_001])
def test_mixture_has_whole_numbers_of_each_kind(spark, n):
    got = evaluation.mix_gaussians(spark, 100.0, -100.0, 1.0, 1.0, 0.3, n, 5)
    assert got.count() == n and got.where("ret > 0").count() == int(n * 0.3)


def test_fractional_difference_is_one_rule_for_all_lengths(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=60).cumsum() + 50
    x[40] = np.nan
    rows = spark.createDataFrame([((pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), float(v)) for i, v in enumerate(x)], "ts timestamp, close double")
    got = []
    for direct in (10, 4096):
        monkeypatch.setattr(fracdiff, "DIRECT", direct)
        got.append(fracdiff.frac_diff(rows, 0.4, 0.5).orderBy("ts").toPandas())
    assert len(got[0]) == len(got[1]) > 0 and got[0]["ts"].max() < pd.Timestamp("2024-01-01") + pd.Timedelta(hours=40)
    assert np.allclose(got[0]["value"], got[1]["value"])
    with pytest.raises(ValueError):
        fracdiff.get_weights_ffd(0.1, 1e-6, 100)


def test_normal_distribution_column(spark):
    values = [None, float("nan"), 0.0, -0.0, 1e-9, 37.5, -40.0, 7.0710678, 7.0710679, float("inf"), float("-inf")] + [i / 16 for i in range(-140, 141)]
    for x, got in spark.createDataFrame([(v,) for v in values], "x double").select("x", phi_column(F.col("x"))).collect():
        if x is None or math.isnan(x):
            assert got is None if x is None else math.isnan(got)
        else:
            assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-9, abs=1e-18)
