"""Features, splits, guards, cleaning and labels: micro frames, causality and comparison with pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import cleaning, datasets, features, guards, labels, splits
from chronopanel.sources import files


def panel(spark, tickers=2, days=100, seed=42, **extra):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tickers):
        price = 100 + np.arange(days) * 0.1 + rng.normal(0, 1, days)
        for i in range(days):
            rows.append((f"T{t}", dt.date(2020, 1, 1) + dt.timedelta(i), float(price[i]), float(price[i] + 1), float(price[i] - 1), float(rng.integers(100, 1000))))
    df = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")
    for k, v in extra.items():
        df = df.withColumn(k, v)
    return df


def as_pandas(df):
    return df.toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


def test_features_match_pandas(spark):
    df = panel(spark)
    got = as_pandas(features.with_volatility(features.with_all_features(df)))
    base = as_pandas(df)
    for _, g in base.groupby("ticker"):
        own = got.loc[g.index]
        close, vol = g.close, g.volume
        r = np.log(close / close.shift(1))
        np.testing.assert_allclose(own.log_return, r)
        lv = np.log1p(vol)
        np.testing.assert_allclose(own.log_volume_rel_ma_5, lv - lv.rolling(5).mean())
        np.testing.assert_allclose(own.log_volume_zscore_20, (lv - lv.rolling(20).mean()) / lv.rolling(20).std())
        lt = np.log1p(vol * close)
        np.testing.assert_allclose(own.turnover_rel_ma_5, lt - lt.rolling(5).mean())
        np.testing.assert_allclose(own.obv, (np.sign(close.diff()).fillna(0) * vol).cumsum())
        tr = pd.concat([g.high - g.low, (g.high - close.shift(1)).abs(), (g.low - close.shift(1)).abs()], axis=1).max(axis=1)
        np.testing.assert_allclose(own.atr, tr.rolling(14, min_periods=1).mean())
        np.testing.assert_allclose(own.log_volatility, np.log1p(np.sqrt((r**2).rolling(5, min_periods=5).sum())))
        days = pd.to_datetime(g.date)
        assert (own.day_of_week == days.dt.dayofweek.values).all() and (own.is_month_end == days.dt.is_month_end.astype(int)).all()


def test_features_use_no_future(spark):
    df = panel(spark, days=60)
    cut = dt.date(2020, 2, 10)
    changed = df.withColumn("close", F.when(F.col("date") > cut, F.col("close") * 3).otherwise(F.col("close"))).withColumn("volume", F.when(F.col("date") > cut, 1.0).otherwise(F.col("volume")))
    run = lambda d: as_pandas(features.with_lags(features.with_volatility(features.with_all_features(d)), ["log_return"]).filter(F.col("date") <= cut))
    pd.testing.assert_frame_equal(run(df), run(changed))


def test_lags_do_not_cross_tickers(spark):
    df = features.with_lags(panel(spark, days=6), ["close"])
    first = df.withColumn("n", F.row_number().over(features.by_date())).filter("n <= 3").orderBy("ticker", "date").collect()
    for r in first:
        assert [r[f"close_lag_{k}"] is None for k in (1, 2, 3)] == [k >= r["n"] for k in (1, 2, 3)]


def test_plan_has_one_exchange_for_all_features(spark):
    df = features.with_lags(features.with_volatility(features.with_all_features(panel(spark))), ["log_return", "obv"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_splits_and_guards(spark):
    df = splits.split_by_time_range(panel(spark), 0.8)
    assert guards.split_violations(df, "ticker").isEmpty() and guards.split_violations(df).isEmpty()
    assert df.filter("split = 'test'").count() == 2 * 20
    kept = splits.drop_contaminated(df)
    assert kept.filter("split = 'test'").count() == 2 * 16
    bad = df.withColumn("split", F.when(F.dayofmonth("date") == 3, "test").otherwise(F.col("split")))
    assert not guards.split_violations(bad, "ticker").isEmpty()
    unknown = df.withColumn("split", F.when(F.dayofmonth("date") == 3, F.lit(None)).otherwise(F.col("split")))
    assert guards.split_violations(unknown).first()["n_unknown"] > 0
    with pytest.raises(ValueError, match="overlap"):
        guards.require_clean(guards.split_violations(bad), "overlap")
    with pytest.raises(ValueError, match="ratio"):
        splits.split_by_rows(df, 1.5)
    assert guards.order_violations(df).isEmpty() and guards.order_violations(df.union(df)).count() == df.count()


def test_row_and_date_splits(spark):
    one = panel(spark, tickers=1, days=10)
    assert splits.split_by_rows(one).filter("split = 'train'").count() == 8
    assert splits.split_by_distinct_dates(panel(spark, days=10)).filter("split = 'train'").count() == 16
    parts = {r["split"]: r["count"] for r in splits.three_phase(one).groupBy("split").count().collect()}
    assert parts == {"train": 7, "validation": 2, "test": 1}
    folds = splits.ordered_folds(one, 3).collect()
    assert [(r["n_train"], r["last_test"]) for r in folds] == [(4, 5), (6, 7), (8, 9)]
    assert splits.trim_warmup(panel(spark, days=30)).count() == 20
    refits = splits.refit_schedule(panel(spark, tickers=1, days=100), 30, 21).filter("refit = 1").collect()
    assert [r["position"] for r in refits] == [30, 51, 72, 93]


def test_fold_assertion():
    guards.assert_fold(0, 10, 10, 12, 20)
    for bad in [(0, 11, 10, 12, 20), (5, 5, 6, 7, 8), (0, 3, 4, 9, 8)]:
        with pytest.raises(ValueError, match="looks ahead"):
            guards.assert_fold(*bad)


def test_cleaning(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "b", float("nan")), (2, "c", None)], "k int, v string, x double")
    assert [r["v"] for r in cleaning.keep_one(df, ["k"], [F.col("v")]).orderBy("k").collect()] == ["a", "c"]
    assert cleaning.duplicate_count(df, ["k"]).first()["n_removed"] == 1
    assert cleaning.nonfinite_to_null(df, ["x"]).filter("x is null").count() == 2
    assert cleaning.zero_fill(df).filter("x is null").count() == 1
    opened = df.withColumn("open", F.lit(1.0)).withColumnRenamed("x", "close")
    assert cleaning.zero_fill(opened).filter("close is null").count() == 0
    a = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", 2.0)], "date string, v double")
    got = cleaning.combine_residuals(a, a.limit(1).withColumn("v", F.lit(9.0)))
    assert sorted(r["v"] for r in got.collect()) in ([2.0, 9.0], [1.0, 9.0])


def test_triple_barrier(spark):
    prices = [100, 102, 101, 103, 105, 106, 104, 107, 108, 110]
    df = spark.createDataFrame([(dt.date(2020, 1, 1 + i), float(p)) for i, p in enumerate(prices)], "date date, close double")
    df = splits.split_by_rows(df).withColumn("ticker", F.lit("a"))
    got = labels.test_only(labels.triple_barrier(df, horizon=1, up=0.01, down=0.01)).orderBy("date").collect()
    assert [r["triple_barrier_label"] for r in got] == [None] * 8 + [1, None]
    both = spark.createDataFrame([(dt.date(2020, 1, 1 + i), p, "a") for i, p in enumerate([100.0, 90.0, 120.0, 100.0, 100.0])], "date date, close double, ticker string")
    assert labels.triple_barrier(both, horizon=2).orderBy("date").first()["triple_barrier_label"] == 1


def test_classification_metrics(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9), (1, 0.0, 0.4), (0, 0.0, 0.4), (0, 1.0, 0.6)], "meta_label int, prediction double, score double")
    r = labels.classification_metrics(df).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5, 0.5)
    assert r["roc_auc"] == pytest.approx((1 + 1 + 0.5 + 0) / 4)


def test_learning_table_is_neither_written_nor_shuffled(spark, sf, monkeypatch):
    from chronopanel.plans import catalog

    written = []
    monkeypatch.setattr(datasets, "staged", lambda df, label, write=datasets.staged: written.append(df.columns) or write(df, label))
    monkeypatch.setattr(catalog, "_READY", {})
    df = catalog.queries()["variant_complete"](spark, sf)
    assert len(df.columns) > 40 and written == [["date", "ticker", "of_ticker"]]
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and sum("REPARTITION_BY_COL" in line for line in moved) == 1, moved  # line items, and orders by day


def test_learning_table_and_variants(spark):
    df = panel(spark, days=90, log_sigma_garch=F.rand(1) - 1)
    ready = datasets.prepare(df)
    assert ready.count() == 2 * (90 - 19 - 3 - 1)
    sizes = {n: datasets.variant(ready, n) for n in datasets.VARIANTS}
    assert not any("sigma" in c for c in sizes["without_insight"].columns)
    assert [c for c in sizes["insight_only"].columns if "lag" in c] == [f"log_sigma_garch_lag_{k}" for k in (1, 2, 3)]
    assert len(sizes["complete"].columns) > len(sizes["technical_only"].columns)
    assert "log_volatility" not in datasets.features_of(ready) and "close" in datasets.features_of(ready)
    for r in ready.join(features.with_volatility(features.log_returns(df)).select("ticker", F.date_sub("date", 1).alias("date"), F.col("log_volatility").alias("next")), ["ticker", "date"]).collect():
        assert r["log_volatility"] == pytest.approx(r["next"])


def test_spearman_matches_pandas(spark):
    df = panel(spark, tickers=1, days=50).withColumn("tied", F.floor(F.col("volume") / 300).cast("double"))
    want = df.select("close", "volume", "tied").toPandas().corr(method="spearman")
    for r in datasets.spearman(df, ["close", "volume", "tied"]).collect():
        assert r["rho"] == pytest.approx(want.loc[r["a"], r["b"]])


def test_files_roundtrip(spark, tmp_path):
    df = panel(spark, days=5)
    files.write_both(df, f"{tmp_path}/t")
    back = files.read_table(spark, f"{tmp_path}/t.parquet", required=["close"], dates=["date"])
    assert back.count() == 10
    csv = files.read_table(spark, f"{tmp_path}/t.csv", file_format="csv", dates=["date"], renames={"ticker": "tickers"}, not_null=["close"])
    assert dict(csv.dtypes)["date"] == "date" and "tickers" in csv.columns
    with pytest.raises(KeyError, match="nope"):
        files.read_table(spark, f"{tmp_path}/t.parquet", required=["nope"])
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, f"{tmp_path}/missing")
    with pytest.raises(ValueError, match="empty"):
        files.require_rows(df.limit(0))
    files.write_report(spark, {"a": 1, "b": [1, 2]}, f"{tmp_path}/report")
    assert files.read_report(spark, f"{tmp_path}/report", ["a"]) == {"a": 1, "b": [1, 2]}
    with pytest.raises(KeyError):
        files.read_report(spark, f"{tmp_path}/report", ["z"])
    raw = spark.createDataFrame([("2020-01-02", 1.0, 2.0, 0.5, 1.5, 10, "A"), ("2020-01-03", 1.0, None, 0.5, 1.5, 10, "B")], "Date string, Open double, High double, Low double, Close double, Volume long, Ticker string")
    assert files.ingest(raw).collect()[0]["tickers"] == "A" and files.ingest(raw).count() == 1
    covered = files.covered_tickers(files.ingest(raw), "2020-01-01", "2020-02-01")
    assert covered.count() == 1
    assert [r[0] for r in files.failed_tickers(spark.createDataFrame([("A",), ("C",)], "ticker string"), covered).collect()] == ["C"]


def test_result_guards(spark):
    assert guards.require_keys({"lm": 1.0, "q": [1, 2], "df": 2}, ["lm"], {"q": 2}, {"df": 2})
    for bad in ((["p"], {}, {}), ([], {"q": 3}, {}), ([], {}, {"df": 3})):
        with pytest.raises(ValueError):
            guards.require_keys({"lm": 1.0, "q": [1, 2], "df": 2}, *bad)
    with pytest.raises(ValueError):
        guards.require_report({"ljung_box": {}, "ljung_box_squared": {}, "arch_lm": 1.0})
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "ticker string, date date, close double")
    with pytest.raises(ValueError):
        features.with_lags(df, ["close"], (0,))


def test_volume_of_the_base(spark, tmp_path):
    base = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 5.0), (dt.date(2020, 1, 2), "b", 6.0)], "date date, tickers string, volume double")
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "a", 1.0), (dt.date(2020, 1, 3), "a", 2.0)], "date date, ticker string, close double")
    assert sorted((r["close"], r["volume"]) for r in files.with_volume(df, base).collect()) == [(1.0, 5.0), (2.0, None)]
    own = df.withColumn("volume", F.lit(1.0))
    assert files.with_volume(own, base) is own and files.with_volume(df, None) is df
    with pytest.raises(FileNotFoundError):
        files.first_available(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_loss_difference_over_several_days(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(i // 3), float(i % 5), float((i * 7) % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "date date, a double, b double")
    from chronopanel.operators import evaluate

    got = evaluate.diebold_mariano(df, "a", "b", h=3).first()
    d = np.array([x * x - y * y for _, x, y in rows])
    c = d.reshape(30, 3).mean(axis=1) - d.mean()
    v = d.var(ddof=1) + 2 * sum((c[k:] * c[:-k]).mean() for k in (1, 2))
    assert got["n"] == 90 and got["variance"] == pytest.approx(v)


def test_plotting_sample_is_every_kth_day(spark):
    from chronopanel.operators import selection

    days = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(i), float(i)) for i in range(107)], "date date, v double")
    assert sorted(r["v"] for r in selection.plotting_sample(days.repartition(5), 20).collect()) == [float(i) for i in range(0, 107, 5)]
    assert selection.plotting_sample(days, 20, "random").count() == 20
    with pytest.raises(ValueError):
        selection.plotting_sample(days, 20, "none")
