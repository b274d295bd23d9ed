"""Walk-forward forecasts of a series: with order (0, 0, 0) and a constant, a fit is the mean of what was known.

That case is a window; general orders are fitted by conditional least squares per series in grouped pandas.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import by_date

MIN_TRAIN = 30
REFIT = 21


def min_train_rows(n: int, least: int = MIN_TRAIN) -> int:
    """At most a quarter of the series, but not below half of least unless the series is that short."""
    m = min(least, n // 4)
    return m if m >= least // 2 else min(least // 2, n // 2)


def mean_forecasts(df: DataFrame, value: str, start: int, every: int = REFIT) -> DataFrame:
    """date, y_true, y_pred, arima_resid from row start on: the mean of all rows before the latest refit."""
    w = by_date(None)
    known = F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    due = (F.col("__n") - start) % every == 0 if every > 0 else F.col("__n") == start
    rows = df.withColumn("__n", F.row_number().over(w) - 1).withColumn("__fit", F.when((F.col("__n") >= start) & due, known))
    pred = F.last("__fit", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("y_pred", pred).filter(F.col("__n") >= start)
    return rows.select("date", F.col(value).alias("y_true"), "y_pred", (F.col(value) - F.col("y_pred")).alias("arima_resid"))


def rolling_forecast(train: DataFrame, test: DataFrame, value: str, every: int = REFIT) -> DataFrame:
    """Forecasts of the test rows; the first fit knows the train rows, later ones the test rows that have passed too."""
    start = train.count()
    return mean_forecasts(train.select("date", value).unionByName(test.select("date", value)), value, start, every)


def backtest(df: DataFrame, value: str, every: int = REFIT) -> DataFrame:
    return mean_forecasts(df, value, min_train_rows(df.count()), every)


def residual_dataset(split_df: DataFrame, value: str, every: int = REFIT) -> DataFrame:
    """date, split, value, arima_resid: train residuals of the backtest, test residuals of the rolling forecast."""
    from .cleaning import attach_residuals, combine_residuals

    train, test = split_df.filter("split = 'train'"), split_df.filter("split = 'test'")
    walked = backtest(train, value, every).select("date", "arima_resid")
    rolled = rolling_forecast(train, test, value, every).select("date", "arima_resid")
    return attach_residuals(split_df.select("date", "split", value), combine_residuals(walked, rolled))


def css_fit(y: np.ndarray, p: int, q: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (constant, ar, ma) and residuals by iterated least squares on own lags and past residuals."""
    e = y - y.mean()
    m = max(p, q)
    coef = np.zeros(1 + p + q)
    for _ in range(rounds if q else 1):
        x = np.column_stack([np.ones(len(y) - m), *(y[m - i : len(y) - i] for i in range(1, p + 1)), *(e[m - j : len(y) - j] for j in range(1, q + 1))])
        new = np.linalg.lstsq(x, y[m:], rcond=None)[0]
        e = np.concatenate([np.zeros(m), y[m:] - x @ new])
        if np.abs(new - coef).max() < 1e-10:
            break
        coef = new
    return new, e


def arima_forecasts(order: tuple[int, int, int], start: int, every: int = REFIT, value: str = "value") -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas by series: one-step forecasts of ARIMA(p, d, q) with a constant; forecasts hold still between refits."""
    p, d, q = order

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf[value].to_numpy(float)
        preds, last = np.full(len(y), np.nan), np.nan
        for t in range(start, len(y)):
            if t == start or (every > 0 and (t - start) % every == 0):
                z = np.diff(y[:t], d) if d else y[:t]
                coef, e = css_fit(z, p, q)
                step = coef[0] + sum(coef[i] * z[-i] for i in range(1, p + 1)) + sum(coef[p + j] * e[-j] for j in range(1, q + 1))
                tail = y[:t]
                for k in range(d):
                    step += np.diff(tail, k)[-1] if k else tail[-1]
                last = step
            preds[t] = last
        out = pdf.assign(y_pred=preds, y_true=y, arima_resid=y - preds).iloc[start:]
        return out[["series", "date", "y_true", "y_pred", "arima_resid"]]

    return run


def forecast_metrics(df: DataFrame) -> DataFrame:
    e = F.col("y_true") - F.col("y_pred")
    return df.filter("y_true is not null and y_pred is not null").agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"), F.count(F.lit(1)).alias("n"))


def walk_forward_blocks(df: DataFrame, value: str, n_splits: int, size: int) -> DataFrame:
    """block, rmse, mae, mean_error of the last n_splits blocks of size rows; each is forecast by the mean of all before it."""
    w = by_date(None)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    rows = df.withColumn("__n", F.row_number().over(w) - 1).withColumn("__start", n - n_splits * size).filter(F.col("__start") > 0)
    known = F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__known", known).withColumn("block", F.floor((F.col("__n") - F.col("__start")) / size)).filter("block >= 0")
    first = F.first("__known").over(Window.partitionBy("block").orderBy("date"))
    e = F.col(value) - F.col("__fit")
    return rows.withColumn("__fit", first).groupBy("block").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("mean_error"))
