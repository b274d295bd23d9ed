"""Selections, refits, comparisons and the whole chain of stages."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import ranks
from chronopanel.operators import comparison, models, refits, selection
from chronopanel.plans import stages


@pytest.fixture(scope="module")
def days(spark):
    rng = np.random.default_rng(0)
    rows = [(dt.date(2019, 12, 1) + dt.timedelta(i), f"t{k}", float(rng.normal()), "train" if i < 50 else "test") for i in range(60) for k in range(3)]
    return spark.createDataFrame(rows, "date date, ticker string, v double, split string")


def test_selections(spark, days):
    assert selection.by_split(days, "test").count() == 30
    assert selection.by_split(days.drop("split"), "test").count() == 180
    with pytest.raises(ValueError, match="empty"):
        selection.by_split(days, "validation")
    with pytest.raises(ValueError, match="empty"):
        selection.by_date_range(days, "2000-01-01", "2000-12-31")
    assert selection.by_year(days, 2020).agg(F.min("date")).first()[0] == dt.date(2020, 1, 1)
    with pytest.raises(ValueError, match="1900"):
        selection.by_year(days, 1800)
    x, y = selection.features_and_target(days, "v")
    assert x.columns == [] and y.columns == ["v"]
    with pytest.raises(KeyError):
        selection.target_name(days)
    assert selection.target_name(days.withColumn("log_return", F.lit(1.0)).withColumn("log_volatility", F.lit(1.0))) == "log_volatility"
    assert selection.ordered_output(days).first()["split"] == "train"
    assert [r["v"] for r in selection.top(days, "v", 3).collect()] == sorted((r["v"] for r in days.collect()), reverse=True)[:3]
    assert sorted(selection.plotting_sample(days, 20).collect()) == sorted(selection.plotting_sample(days.repartition(5), 20).collect())
    assert selection.parsed_levels("0.05, 0.01,0.05") == (0.01, 0.05)
    for bad in ("", "2", "0"):
        with pytest.raises(ValueError, match="levels"):
            selection.parsed_levels(bad)
    text = spark.createDataFrame([("2020-02-03",), ("2020/02/03",), ("03.02.2020",), ("nonsense",), (None,)], "t string")
    assert [r[0] for r in text.select(selection.parsed_date(F.col("t"))).collect()] == [dt.date(2020, 2, 3)] * 3 + [None] * 2
    bounds = spark.createDataFrame([(1e6,), (-1e6,), (0.0,)], "x double").select(selection.bounded_variance(F.col("x"))).collect()
    assert [r[0] for r in bounds] == [math.exp(700), 1e-10, 1.0]


def test_positions_and_running_counts(spark, days):
    rows = ranks.positions(days, "date", "ticker").orderBy("date", "ticker").collect()
    assert [r["position"] for r in rows] == list(range(180))
    counts = days.groupBy(F.round("v", 1).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    total = 0
    for r in ranks.before(counts, "x").orderBy("x").collect():
        assert r["before"] == total
        total += r["n"]
    assert ranks.before(counts.limit(0), "x").count() == 0


def test_shuffled_target_is_a_permutation(spark, days):
    got = models.shuffled_target(days, "v", rows_a_group=60)
    assert sorted(r["v"] for r in got.collect()) == sorted(r["v"] for r in days.collect())
    moved = got.alias("a").join(days.alias("b"), ["date", "ticker"]).filter("a.v <> b.v").count()
    assert moved > 150


def test_refits_follow_the_schedule_and_freeze(spark):
    rng = np.random.default_rng(1)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(i), "train" if i < 150 else "test", float(rng.normal(0, 0.02))) for i in range(180)]
    df = spark.createDataFrame(rows, "series string, date date, split string, e double")
    got = refits.forecasts(df, start=100, every=21, steps=30).orderBy("date").collect()
    assert [i + 100 for i, r in enumerate(got) if r["refit"]] == [100, 121, 142]
    moving = refits.forecasts(df, start=100, every=21, steps=30, frozen=False).orderBy("date").collect()
    assert [i + 100 for i, r in enumerate(moving) if r["refit"]] == [100, 121, 142, 163]
    assert [r["sigma2"] for r in got[:63]] == [r["sigma2"] for r in moving[:63]]
    shocked = df.withColumn("e", F.when(F.col("date") == rows[170][1], 1.0).otherwise(F.col("e")))
    other = refits.forecasts(shocked, start=100, every=21, steps=30).orderBy("date").collect()
    assert [r["sigma2"] for r in got[:71]] == [r["sigma2"] for r in other[:71]] and other[71]["sigma2"] > got[71]["sigma2"]
    log = refits.convergence(spark.createDataFrame(got)).first()
    assert log["n_refits"] == 3
    assert refits.log_sigma(spark.createDataFrame(got)).count() == 80
    assert len(refits.search_space()) == 200
    assert refits.schedule(10, 50, 0) == [10]


def test_comparison(spark, days):
    tall = days.select("ticker", "date", F.col("v").alias("y"), F.explode(F.array(*(F.struct(F.lit(m).alias("model"), (F.col("v") + s * F.sin(F.col("v") * 50)).alias("pred")) for m, s in (("complete", 0.1), ("without_insight", 0.5))))).alias("m")).select("ticker", "date", "y", "m.*")
    r = comparison.verdicts(comparison.pairwise(tall)).collect()
    assert [(x["a"], x["b"], x["better"]) for x in r] == [("complete", "without_insight", "complete")]
    other = tall.withColumn("y", F.when(F.col("model") == "complete", F.col("y") + 1).otherwise(F.col("y")))
    assert comparison.pairwise(other).count() == 0
    assert comparison.metrics(tall).count() == 2
    one = days.filter("ticker = 't0'").withColumnRenamed("v", "z")
    report = comparison.diagnostic_report(one)
    assert set(report) >= {"ljung_box", "arch_lm", "nyblom", "joint_sign_bias"} and 0 <= report["arch_lm"]["p_value"] <= 1
    assert "arch_effect" in comparison.has_arch_effect(one, "z", 3)


def test_all_stages(spark, sf, tmp_path):
    run = stages.Run(spark, sf.replace("sf0.001", "sf0.01"), str(tmp_path / "run"), refit=400, start=300, steps=10, params={"maxDepth": 2, "maxIter": 2})
    assert stages.run_all(run)[-1] == "meta"
    assert run.get("model_metrics").count() == 8
    assert run.get("model_pairs").count() == 5
    assert not run.get("leakage").first()["leak"]
    assert run.get("garch_forecasts").filter("sigma2 <= 0").isEmpty()
    assert 0 <= run.get("meta_metrics").first()["roc_auc"] <= 1
    assert run.get("labels").filter("split = 'train' and triple_barrier_label is not null").isEmpty()
