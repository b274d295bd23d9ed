"""Forecasts, variance recursion, tests, evaluation, models and streams."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import special
from chronopanel.operators import arima, diagnostics, egarch, evaluate, models, splits
from chronopanel.streaming import live

PRM = egarch.Params(-0.3, (0.2,), (-0.1,), (0.95,), nu=8.0)


def series(spark, values, name="e", key="a"):
    rows = [(key, dt.date(2015, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"series string, date date, {name} double")


def noise(n, seed=42, scale=1.0):
    return np.random.default_rng(seed).normal(0, scale, n)


def test_mean_forecasts_match_a_loop(spark):
    y = noise(120)
    got = [r["y_pred"] for r in arima.mean_forecasts(series(spark, y, "v"), "v", 30, 21).orderBy("date").collect()]
    want, last = [], None
    for t in range(30, 120):
        if (t - 30) % 21 == 0:
            last = y[:t].mean()
        want.append(last)
    np.testing.assert_allclose(got, want)
    assert arima.min_train_rows(1000) == 30 and arima.min_train_rows(80) == 20 and arima.min_train_rows(40) == 15


def test_residual_dataset_covers_train_and_test(spark):
    df = splits.split_by_rows(series(spark, noise(200), "v"))
    rows = arima.residual_dataset(df, "v").orderBy("date").collect()
    assert len(rows) == 170 and [r["split"] for r in rows].count("test") == 40


def test_general_orders_beat_the_mean_on_an_autoregression(spark):
    rng, y = np.random.default_rng(4), [0.0]
    for _ in range(400):
        y.append(0.8 * y[-1] + rng.normal())
    coef, _ = arima.css_fit(np.array(y), 1, 0)
    assert coef[1] == pytest.approx(0.8, abs=0.08)
    df = series(spark, y, "value")
    got = df.groupBy("series").applyInPandas(arima.arima_forecasts((1, 0, 0), 100, 1), "series string, date date, y_true double, y_pred double, arima_resid double")
    assert got.agg(F.avg(F.col("arima_resid") ** 2)).first()[0] < 0.6 * np.var(y)


def plain_path(e, prm):
    """The recursion written once more, with arrays of logs."""
    first = max(np.var(e), 1e-10)
    lead = max(prm.o, prm.p)
    ln = [math.log(first)] * lead
    for t in range(lead, len(e)):
        z = [e[t - i] / math.exp(ln[t - i] / 2) for i in range(1, prm.o + 1)]
        x = prm.omega + sum(b * ln[t - j] for j, b in enumerate(prm.beta, 1)) + sum(a * (abs(v) - prm.kappa) + g * v for a, g, v in zip(prm.alpha, prm.gamma, z, strict=True))
        ln.append(max(math.log(1e-10), x))
    return np.exp(ln)


@pytest.mark.parametrize("prm", [PRM, egarch.Params(-0.3, (0.1, 0.1), (-0.1, 0.0), (0.5, 0.4)), egarch.Params(-0.2, (0.1,), (0.0,), (0.5, 0.3, 0.1), lam=-0.3, dist="skewt")])
def test_variance_path(spark, prm):
    e = noise(200, scale=0.01)
    np.testing.assert_allclose(egarch.variance_path(e, prm), plain_path(e, prm), rtol=1e-10)
    got = [r["sigma2"] for r in egarch.filtered(series(spark, e), prm).orderBy("date").collect()]
    np.testing.assert_allclose(got, plain_path(e, prm), rtol=1e-10)


def test_likelihood_as_an_aggregation(spark):
    e = noise(150, scale=0.02)
    path = egarch.filtered(series(spark, e), PRM)
    got = egarch.student_loglik(path, PRM.nu).first()
    assert got["n"] == 150 and got["loglik"] == pytest.approx(egarch.loglik(e, egarch.variance_path(e, PRM), "student", PRM.nu))


def test_primary_labels(spark):
    rng = np.random.default_rng(4)
    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(120)]
    r = rng.normal(0, 0.02, 121)
    pdf = pd.DataFrame({"date": days, "ticker": "a", "close": 100 * np.exp(np.cumsum(r[1:])), "log_return": r[1:], "log_return_lag_1": r[:-1]})
    df = splits.split_by_distinct_dates(spark.createDataFrame(pdf))
    kind, params, out = models.primary_labels(df, {"linear": {"regParam": (0.0, 1.0)}}, n_splits=2)
    rows = out.collect()
    assert kind == "linear" and "regParam" in params and len(rows) == 120 and all(x["primary_pred"] is not None for x in rows)
    assert all(x["triple_barrier_label"] is None for x in rows if x["split"] == "train") and any(x["triple_barrier_label"] is not None for x in rows)
    assert "log_return" not in models.inputs_of(df, "log_return")  # what is predicted is no input


def test_forecast_ignores_the_shock_of_its_own_day(spark):
    e = np.linspace(-0.5, 0.5, 40)
    shocked = e.copy()
    shocked[20] += 10
    init = 0.1
    a, b = egarch.variance_path(e, PRM, init), egarch.variance_path(shocked, PRM, init)
    np.testing.assert_allclose(a[:21], b[:21])
    assert b[21] > a[21]
    exact = series(spark, e).groupBy("series").applyInPandas(egarch.exact_forecasts(PRM, 10), "series string, date date, e double, forecast double").orderBy("date").collect()
    assert exact[0]["forecast"] == pytest.approx(egarch.variance_path(e[:10], PRM)[-1])


def test_one_and_multi_step(spark):
    e = noise(50, scale=0.1)
    path = egarch.variance_path(e, PRM)
    got = [r["forecast"] for r in egarch.fast_forecasts(series(spark, e), PRM).orderBy("date").collect()]
    assert got[0] is None
    np.testing.assert_allclose(got[1:], path[1:], rtol=1e-9)
    state = spark.createDataFrame([(0.04,)], "s2_last double")
    ln, want = math.log(0.04), []
    for _ in range(5):
        ln = PRM.omega + PRM.beta[0] * ln
        want.append(math.exp(ln))
    table = egarch.forecast_table(state, 5, PRM).orderBy("h").collect()
    np.testing.assert_allclose([r["sigma2"] for r in table], want)
    assert all(r["pi_low"] < 0 < r["pi_high"] and r["value_at_risk"] > r["pi_low"] for r in table)


def test_fit_recovers_a_simulated_process(spark):
    rng, true = np.random.default_rng(3), egarch.Params(-0.2, (0.2,), (-0.1,), (0.95,))
    ln, e = -4.0, []
    for _ in range(1500):
        z = rng.standard_t(8) / math.sqrt(8 / 6)
        e.append(z * math.exp(ln / 2))
        ln = true.omega + 0.95 * ln + 0.2 * (abs(z) - true.kappa) - 0.1 * z
    e = np.array(e)
    prm = egarch.fit(e, steps=300)
    assert prm.loglik >= egarch.loglik(e, egarch.variance_path(e, true), "student", 8.0) - 2
    assert prm.is_stationary() and prm.beta[0] == pytest.approx(0.95, abs=0.06)
    fits = egarch.fit_rows(series(spark, e[:300]), [(1, 1, "student"), (1, 1, "skewt")], steps=60)
    assert fits.count() == 2 and set(fits.columns) >= {"aic", "bic"}


def test_walk_forward_uses_only_the_past():
    e = noise(80, scale=0.1)
    fixed = lambda x: PRM
    a = egarch.walk_forward(fixed, e, 40, 20)
    e2 = e.copy()
    e2[70:] *= 5
    b = egarch.walk_forward(fixed, e2, 40, 20)
    np.testing.assert_allclose(a[40:71], b[40:71])
    assert egarch.window_of(50, "rolling", 20) == (30, 50) and egarch.window_of(50, "expanding", 20) == (0, 50)


def test_perfect_variance_has_no_loss(spark):
    df = spark.createDataFrame([(math.sqrt(v), v) for v in (1.0, 2.0, 0.5, 3.0)] + [(1.0, 0.0), (None, 1.0)], "e double, sigma2 double")
    r = evaluate.variance_losses(df).first()
    assert (r["n"], r["r2"]) == (4, pytest.approx(1)) and r["mse"] == pytest.approx(0, abs=1e-20)


def test_value_at_risk_backtest(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1 + i), e, 1.0) for i, e in enumerate([-2.5, -1.8, -1.0, 0.0, 0.5])], "date date, e double, sigma2 double")
    rows = {r["alpha"]: r for r in evaluate.with_p_values(evaluate.var_backtest(df)).collect()}
    assert rows[0.05]["x"] == 1 and rows[0.01]["x"] == 0
    hits = spark.createDataFrame([(0.05, dt.date(2020, 1, 1) + dt.timedelta(i), int(i >= 90)) for i in range(100)], "alpha double, date date, hit int")
    k = evaluate.kupiec(hits).first()
    logl = lambda p: 90 * math.log(1 - p) + 10 * math.log(p)
    assert (k["n"], k["x"], k["hit_rate"]) == (100, 10, 0.1) and k["lr_uc"] == pytest.approx(-2 * (logl(0.05) - logl(0.1)))
    c = evaluate.christoffersen(hits).first()
    assert (c["n00"], c["n01"], c["n10"], c["n11"]) == (89, 1, 0, 9) and c["lr_ind"] > 10


def test_diebold_mariano_prefers_smaller_errors(spark):
    a, b = noise(300, 1, 2.0), noise(300, 2, 1.0)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "date int, e1 double, e2 double")
    d = a**2 - b**2
    assert evaluate.diebold_mariano(df, "e1", "e2").first()["dm"] == pytest.approx(d.mean() / math.sqrt(d.var(ddof=1) / 300))
    assert evaluate.diebold_mariano(df, "e1", "e2", h=3).first()["dm"] > 0
    y = noise(300, 3)
    rows = spark.createDataFrame([(i, float(v), float(v + x / 4), float(v + z / 4)) for i, (v, x, z) in enumerate(zip(y, a, b, strict=True))], "k int, y double, p1 double, p2 double")
    s = evaluate.bootstrap_summary(evaluate.bootstrap_r2(rows, "y", "p2", "p1", 100)).first()
    assert s["low"] > 0 and s["p_value"] < 0.05
    one, many = (evaluate.bootstrap_r2(rows.repartition(k), "y", "p2", "p1", 20).orderBy("rep").collect() for k in (1, 5))
    np.testing.assert_allclose(np.array(one), np.array(many))
    weights = evaluate._poisson_weights(np.arange(100_000, dtype=np.int64), 1, 42)
    assert weights.mean() == pytest.approx(1, abs=0.02) and weights.var() == pytest.approx(1, abs=0.03)
    keys = np.random.default_rng(5).integers(0, 1 << 60, 3000)
    drawn = np.array([evaluate._poisson_weights(keys, rep, 42) for rep in range(400)])
    assert drawn.mean() == pytest.approx(1, abs=0.01) and drawn.sum(axis=1).var() == pytest.approx(3000, rel=0.25)
    assert abs(np.corrcoef(drawn[0], drawn[1])[0, 1]) < 0.07 and abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.2


def test_autocorrelation_and_ljung_box(spark):
    x = noise(200)
    c = x - x.mean()
    want = [float(c[k:] @ c[:-k]) / float(c @ c) for k in range(1, 6)]
    df = series(spark, x)
    np.testing.assert_allclose([r["r"] for r in diagnostics.autocorrelations(df, "e", 5).orderBy("lag").collect()], want)
    q = [r["q"] for r in diagnostics.ljung_box(df, "e", 5).orderBy("lag").collect()]
    assert q[-1] == pytest.approx(200 * 202 * sum(v * v / (200 - k) for k, v in enumerate(want, 1)))
    assert diagnostics.partial_autocorrelations(want)[0] == want[0]
    assert diagnostics.partial_autocorrelations([0.5, 0.25, 0.125])[1:] == pytest.approx([0, 0])


def test_heteroskedasticity_is_found_where_it_is(spark):
    rng, e, s2 = np.random.default_rng(7), [], 1.0
    for _ in range(600):
        e.append(rng.normal() * math.sqrt(s2))
        s2 = 0.3 + 0.7 * e[-1] ** 2
    assert diagnostics.arch_lm(series(spark, e), "e", 5)["p_value"] < 0.01
    assert diagnostics.arch_lm(series(spark, noise(600)), "e", 5)["p_value"] > 0.01
    growing = noise(400) * np.linspace(0.5, 3, 400)
    assert diagnostics.trend_lm(series(spark, growing), "e", 2)["p_value"] < 1e-4
    assert diagnostics.joint_sign_bias(series(spark, noise(400), "z"))["p_value"] > 0.001


def test_ols_matches_numpy(spark):
    x = np.column_stack([noise(100, 1), noise(100, 2)])
    y = 1 + x @ [2.0, -1.0] + noise(100, 3, 0.1)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, (b, c) in zip(y, x, strict=True)], "y double, a double, b double")
    want = np.linalg.lstsq(np.column_stack([np.ones(100), x]), y, rcond=None)[0]
    np.testing.assert_allclose(diagnostics.ols(df, F.col("y"), [F.col("a"), F.col("b")])["beta"], want, rtol=1e-8)


def test_stationarity_of_noise_and_walk(spark):
    white, walk = noise(300, 1), np.cumsum(noise(300, 2))
    df = series(spark, white, "value", "white").union(series(spark, walk, "value", "walk"))
    got = {r["series"]: r for r in diagnostics.stationarity(df).collect()}
    assert got["white"]["stationary"] and not got["walk"]["stationary"]


def test_normality_and_distance(spark):
    df = series(spark, noise(300), "value")
    r = diagnostics.normality(df).first()
    assert r["anderson_darling"] < 1.2 and r["shapiro_francia"] > 0.98
    assert diagnostics.normality(df.limit(2)).first()["anderson_darling"] is None
    assert diagnostics.kolmogorov_smirnov(df, "value", np.vectorize(special.normal_cdf))["distance"] < 0.1
    qq = diagnostics.qq_table(df, "value", np.vectorize(special.normal_ppf)).orderBy("position").collect()
    assert np.corrcoef([r["value"] for r in qq], [r["theoretical"] for r in qq])[0, 1] > 0.98
    z = pd.Series(noise(300))
    m = diagnostics.moments(df, "value").first()
    assert (m["mean"], m["variance"]) == (pytest.approx(z.mean()), pytest.approx(z.var(ddof=0)))


def model_table(spark, n=300):
    x = noise(n, 5)
    y = np.roll(x, 1) * 2 + noise(n, 6, 0.1)
    rows = [(dt.date(2018, 1, 1) + dt.timedelta(i // 2), f"t{i % 2}", float(x[i]), float(noise(1, i)[0]), float(2 * x[i] + 0.1 * y[i])) for i in range(n)]
    return splits.split_by_distinct_dates(spark.createDataFrame(rows, "date date, ticker string, good double, useless double, log_volatility double"))


def test_training_importance_and_leakage(spark):
    df = model_table(spark)
    small = {"maxDepth": 3, "maxIter": 8}
    assert models.train_and_evaluate(df, small).first()["r2"] > 0.7
    model = models.train(df.filter("split = 'train'"), small)
    assert models.importances(model)[0][0] == "good"
    ranks = models.block_permutation(df.filter("split = 'test'"), model, ["useless", "good"], block=2, repeats=3, share=1.0).collect()
    assert ranks[0]["column"] == "good" and ranks[0]["delta_r2_mean"] > 0.3
    assert not models.leakage_test(df, small).first()["leak"]
    folds = models.fold_dates(df, 3).groupBy("fold").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).orderBy("fold").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(folds, folds[1:], strict=False))
    kind, params, _ = models.choose(df, {"linear": {"regParam": (0.0, 5.0)}, "forest": {"maxDepth": (1,), "numTrees": (2,)}}, 2)
    assert (kind, params) == ("linear", {"regParam": 0.0})
    marked = df.withColumn("meta_label", (F.col("good") + F.col("useless") / 10 > 0).cast("int"))
    assert models.stratified_auc(marked, ["good", "useless"], folds=2) > 0.9
    assert models.tune(df, {"maxDepth": (2,), "maxIter": (2, 4)}, 2).count() == 2


def test_streams(spark, sf, tmp_path):
    src = tmp_path / "ticks"
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    events.repartitionByRange(4, "ts").write.parquet(str(src))
    stream = live.windowed(live.tick_stream(spark, str(src), 10), "1 day", "1 hour")
    got = live.run_once(stream, "hourly", str(tmp_path / "c1"), "complete")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    assert live.run_once(live.sessions(live.tick_stream(spark, str(src), 10)), "sessions", str(tmp_path / "c2"), "complete").agg(F.sum("n")).first()[0] == events.count()
    ticks = live.tick_stream(spark, str(src), 10).select(F.col("event_type").alias("series"), "ts", F.col("value").alias("e"))
    rows = live.run_once(live.live_variance(ticks, PRM, 1.0), "variance", str(tmp_path / "c3")).toPandas()
    for _, g in rows.groupby("series"):
        g = g.sort_values("ts")
        np.testing.assert_allclose(g.sigma2, egarch.variance_path(g.e.to_numpy(), PRM, 1.0), rtol=1e-8)


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_shapley_values_against_all_subsets(spark, kind):
    from itertools import combinations

    from chronopanel.operators import attribution

    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(log_volatility=x[:, 0] * x[:, 1] + np.abs(x[:, 2]), date=dt.date(2020, 1, 1), ticker="t")
    df = spark.createDataFrame(pdf)
    sizes = {"maxIter": 4, "maxDepth": 4} if kind == "gbt" else {"numTrees": 4, "maxDepth": 4, "seed": 1}
    model = models.train(df, sizes, inputs=list("abcd"), kind=kind)
    leaves = attribution.ensemble_leaves(model)

    def value(row, known):
        return sum(v.value * math.prod((lo < row[f] <= hi) if f in known else v.share[f] for f, (lo, hi) in v.bounds.items()) for v in leaves)

    got = attribution.shapley(leaves, x[:10])
    for row, mine in zip(x[:10], got, strict=True):
        assert mine[-1] == pytest.approx(value(row, ()))
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (value(row, (*s, f)) - value(row, s)) for k in range(4) for s in combinations(rest, k))
            assert mine[f] == pytest.approx(want, abs=1e-12)
    rows = attribution.shap_values(model, df).collect()
    assert len(rows) == 300 and all(sum(r["values"]) + r["base"] == pytest.approx(r["pred"]) for r in rows)
    places = attribution.shap_importance(model, df).orderBy("place").collect()
    assert [r["place"] for r in places] == [1, 2, 3, 4] and places[-1]["feature"] == "d"


def test_random_forecast_does_not_depend_on_the_deal(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(4000)], "row long, log_volatility double")
    one, many = (evaluate.random_forecast(df.repartition(k)).orderBy("row").collect() for k in (1, 6))
    np.testing.assert_allclose([r["pred"] for r in one], [r["pred"] for r in many], rtol=1e-9)
    p = np.array([r["pred"] for r in one])
    assert abs(p.mean() - 3) < 0.15 and abs(p.std() - 2) < 0.15 and p.max() > 7
