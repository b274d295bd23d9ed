"""The whole chain from quotes to evaluated models as an explicit list of stages; each writes a table that later ones read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import arima, cleaning, comparison, datasets, egarch, evaluate, features, guards, labels, models, refits, splits
from chronopanel.sources import files, panels


class Run:
    """Where a run reads and writes; tables are Parquet under root by name."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str, refit: int = 63, start: int = 100, steps: int = 60, params: dict | None = None):
        self.spark, self.sf_dir, self.root = spark, sf_dir, root.rstrip("/")
        self.refit, self.start, self.steps = refit, start, steps
        self.params = params or {"maxDepth": 3, "maxIter": 5}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}.parquet")
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        return files.read_table(self.spark, f"{self.root}/{name}.parquet")


def fetch(run: Run) -> None:
    df = run.put("raw", panels.panel_prio(run.spark, run.sf_dir))
    run.put("fetch_report", files.fetch_report(df))


def clean(run: Run) -> None:
    df = cleaning.keep_one(run.get("raw"), ["ticker", "date"], [F.col("close")])
    guards.require_clean(guards.order_violations(df), "dates repeat within a ticker")
    run.put("filtered", df)


def prepare(run: Run) -> None:
    df = features.with_volatility(features.log_returns(run.get("filtered"), drop_first=False))
    df = splits.drop_contaminated(splits.split_by_time_range(df))
    out = run.put("tickers_full", cleaning.output_table(df))
    guards.require_clean(guards.split_violations(out, "ticker"), "splits overlap")
    index = panels.index(run.spark, run.sf_dir).select("date", "weighted_log_return")
    run.put("index_split", splits.split_by_rows(index))


def forecast_mean(run: Run) -> None:
    df = run.put("garch_dataset", arima.residual_dataset(run.get("index_split"), "weighted_log_return"))
    run.put("arima_metrics", df.agg(F.sqrt(F.avg(F.col("arima_resid") ** 2)).alias("rmse")))


def forecast_variance(run: Run) -> None:
    df = run.get("garch_dataset").select(F.lit("index").alias("series"), "date", "split", F.col("arima_resid").alias("e"))
    found = run.put("garch_forecasts", refits.forecasts(df, start=run.start, every=run.refit, steps=run.steps))
    guards.require_clean(guards.non_positive(found, "sigma2"), "forecasts are not positive")
    run.put("garch_convergence", refits.convergence(found))
    run.put("garch_fits", egarch.fit_rows(df.filter("split = 'train'"), steps=run.steps))
    test = found.filter("split = 'test'")
    run.put("garch_metrics", comparison.calibrated_metrics(test))
    run.put("garch_backtest", evaluate.with_p_values(evaluate.var_backtest(test)))


def insights(run: Run) -> None:
    days = refits.log_sigma(run.get("garch_forecasts"))
    run.put("tickers_full_insights", cleaning.join_insight(run.get("tickers_full").drop("split"), days, run.start))


def learning_tables(run: Run) -> None:
    ready = run.put("learning", datasets.prepare(run.get("tickers_full_insights").drop("log_return", "log_volatility")))
    for name in datasets.VARIANTS:
        run.put(f"dataset_{name}", datasets.variant(ready, name))


def train(run: Run) -> None:
    for i, name in enumerate(datasets.VARIANTS):
        df = run.get(f"dataset_{name}")
        model = models.train(df.filter("split = 'train'"), run.params)
        model.write().overwrite().save(f"{run.root}/models/{name}")
        got = model.transform(df.filter("split = 'test'")).select(F.lit(name).alias("model"), "ticker", "date", F.col(datasets.TARGET).alias("y"), "pred")
        got.write.mode("overwrite" if not i else "append").parquet(f"{run.root}/predictions.parquet")


def compare(run: Run) -> None:
    predictions = run.get("predictions")
    run.put("model_metrics", comparison.metrics(predictions))
    run.put("model_pairs", comparison.verdicts(comparison.pairwise(predictions)))
    complete = run.get("dataset_complete")
    run.put("naive_metrics", evaluate.regression_metrics(evaluate.naive_forecast(complete.filter("split = 'test'")), datasets.TARGET, "pred"))
    run.put("leakage", models.leakage_test(complete, run.params))


def label(run: Run) -> None:
    df = labels.triple_barrier(run.get("tickers_full"))
    run.put("labels", labels.test_only(df))
    run.put("meta_events", labels.meta_events(df))


def meta(run: Run) -> None:
    columns = ["log_return", "log_volatility", "volume"]
    df = splits.split_by_distinct_dates(run.get("meta_events").drop("split"))
    model = models.meta_model(labels.balance_weights(df.filter("split = 'train'")), columns)
    model.write().overwrite().save(f"{run.root}/models/meta")
    run.put("meta_metrics", labels.classification_metrics(models.scores(model, df.filter("split = 'test'"))))


#: In order; each needs only tables of the ones before.
STAGES: list[tuple[str, Callable[[Run], None]]] = [(f.__name__, f) for f in (fetch, clean, prepare, forecast_mean, forecast_variance, insights, learning_tables, train, compare, label, meta)]


def run_all(run: Run, first: str | None = None, last: str | None = None) -> list[str]:
    """Run the stages from first to last; returns their names."""
    names = [n for n, _ in STAGES]
    lo, hi = names.index(first) if first else 0, names.index(last) + 1 if last else len(names)
    for _, stage in STAGES[lo:hi]:
        stage(run)
    return names[lo:hi]
