"""Deduplication, nulls, joins and unions of panels and residual tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.columns import finite


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_removed"))


def zero_fill(df: DataFrame, columns: tuple[str, ...] = ("open", "close", "volume")) -> DataFrame:
    """Nulls to 0, only where the table has an opening price."""
    return df.na.fill(0, subset=[c for c in columns if c in df.columns]) if "open" in df.columns else df


def nonfinite_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def drop_incomplete(df: DataFrame, keep: tuple[str, ...] = ("date", "ticker", "ticker_id", "split")) -> DataFrame:
    """Rows complete in every column but the ones that describe the row."""
    return df.na.drop(subset=[c for c in df.columns if c not in keep])


def output_table(df: DataFrame) -> DataFrame:
    """The published columns, complete and without rows whose high and low are both 0."""
    values = ["close", "high", "low", "volume", "log_return", "log_volatility"]
    df = nonfinite_to_null(df.select("date", "ticker", *values, "split"), values).na.drop(subset=values)
    return df.filter(~((F.col("high") == 0) & (F.col("low") == 0)))


def join_index(panel: DataFrame, index: DataFrame) -> DataFrame:
    """Every panel row with its day's index return; the strategy follows the index's size."""
    return panel.join(index.select("date", "weighted_log_return"), "date", "left")


def join_insight(panel: DataFrame, insight: DataFrame, skip: int = 250) -> DataFrame:
    """Every panel row with its day's first log sigma, from each ticker's row skip + 1 on."""
    from .splits import skip_first

    days = insight.groupBy("date").agg(F.min("log_sigma_garch").alias("log_sigma_garch"))
    return skip_first(panel.join(days, "date", "left"), skip)


def combine_residuals(train: DataFrame, test: DataFrame) -> DataFrame:
    """Union of both; where a date is in both, test stays."""
    both = train.withColumn("__k", F.lit(0)).unionByName(test.withColumn("__k", F.lit(1)))
    return keep_one(both, ["date"], [F.desc("__k")]).drop("__k")


def attach_residuals(series: DataFrame, residuals: DataFrame) -> DataFrame:
    joined = series.join(residuals, "date", "left")
    return joined.filter(F.col("arima_resid").isNotNull())


def ticker_codes(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """ticker_id: the ordinal of each name, ranked on the distinct names only (names: these, where they are at hand)."""
    names = df.select("ticker").distinct() if names is None else names
    names = names.withColumn("ticker_id", (F.row_number().over(Window.orderBy("ticker")) - 1).cast("int"))
    return df.join(names, "ticker")


def seen_every_day(df: DataFrame, share: float) -> DataFrame:
    """Tickers present on at least this share of all dates."""
    days = df.select("date").distinct().agg(F.count(F.lit(1)).alias("days"))
    counts = df.groupBy("ticker").agg(F.countDistinct("date").alias("n"))
    return counts.join(F.broadcast(days)).filter(F.col("n") >= F.col("days") * share).select("ticker", "n")


