"""Temporal splits, folds, warm-up rows and refit schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.ranks import positions

from .features import by_date


def _ratio(ratio: float) -> float:
    if not 0 < ratio < 1:
        raise ValueError("the train ratio lies between 0 and 1")
    return ratio


def split_by_time_range(df: DataFrame, ratio: float = 0.8, least_rows: int = 2) -> DataFrame:
    """Test iff later than this share of the whole time range; tickers with fewer than least_rows rows go."""
    cut = df.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).select((F.unix_date("lo") + (F.unix_date("hi") - F.unix_date("lo")) * F.lit(_ratio(ratio))).alias("__cut"))
    rows = df.withColumn("__rows", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).filter(F.col("__rows") >= least_rows).drop("__rows")
    return rows.join(F.broadcast(cut)).withColumn("split", F.when(F.unix_date("date") > F.col("__cut"), "test").otherwise("train")).drop("__cut")  # one row


def split_by_distinct_dates(df: DataFrame, ratio: float = 0.8, days: DataFrame | None = None) -> DataFrame:
    """The first int(ratio * k) of the k distinct dates (days: these, where they are at hand) are train."""
    days = df.select("date").distinct() if days is None else days
    n = Window.orderBy("date")
    ranked = days.withColumn("__n", F.row_number().over(n)).withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy()))
    split = F.when(F.col("__n") <= F.floor(F.col("__k") * F.lit(_ratio(ratio))), "train").otherwise("test")
    return df.join(F.broadcast(ranked.select("date", split.alias("split"))), "date")  # a row a calendar day


def split_by_rows(df: DataFrame, ratio: float = 0.8) -> DataFrame:
    """One series: the last n - int(n * ratio) rows are test."""
    w = by_date(None)
    n, rows = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy())
    return df.withColumn("split", F.when(n <= F.floor(rows * F.lit(_ratio(ratio))), "train").otherwise("test"))


def three_phase(df: DataFrame, train: float = 0.7, validation: float = 0.2) -> DataFrame:
    w = by_date(None)
    n, rows = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy())
    a, b = F.floor(rows * F.lit(train)), F.floor(rows * F.lit(train)) + F.floor(rows * F.lit(validation))
    return df.withColumn("split", F.when(n <= a, "train").when(n <= b, "validation").otherwise("test"))


def trim_warmup(df: DataFrame, n: int = 20) -> DataFrame:
    """Without each ticker's first n rows; volume is filled forward first."""
    w = by_date()
    filled = df.withColumn("volume", F.last("volume", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") > n).drop("__n")


def drop_contaminated(df: DataFrame, n: int = 4) -> DataFrame:
    """Without each ticker's first n test rows, whose volatility windows reach into train."""
    seen = by_date().rowsBetween(Window.unboundedPreceding, 0)  # the order of the features: no sort of its own
    tested = F.count(F.when(F.col("split") == "test", 1)).over(seen)
    return df.withColumn("__n", tested).filter((F.col("split") != "test") | (F.col("__n") > n)).drop("__n")


def skip_first(df: DataFrame, n: int = 250) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(by_date())).filter(F.col("__n") > n).drop("__n")


def ordered_folds(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """fold, n_train, first_test, last_test (positions) of expanding time folds over one series."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.floor(F.col("n") / (n_splits + 1)))
    fold = rows.select("n", "size", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    start = F.col("n") - (F.lit(n_splits) - F.col("fold")) * F.col("size")
    return fold.select("fold", start.alias("n_train"), start.alias("first_test"), (start + F.col("size") - 1).alias("last_test"))


def refit_schedule(df: DataFrame, start: int = 30, every: int = 21) -> DataFrame:
    """date, position, refit (0 or 1) from position start on; every 0 refits at start only."""
    n = F.row_number().over(by_date(None)) - 1
    due = (F.col("position") - start) % every == 0 if every > 0 else F.col("position") == start
    return df.select("date", n.alias("position")).filter(F.col("position") >= start).withColumn("refit", due.cast("int"))


def window_bounds(positions: DataFrame, kind: str = "expanding", size: int | None = None) -> DataFrame:
    """Half-open range [lo, hi) of rows that a fit at position may see."""
    lo = F.lit(0) if kind == "expanding" else F.greatest(F.lit(0), F.col("position") - F.lit(size))
    return positions.withColumn("lo", lo.cast("int")).withColumn("hi", F.col("position").cast("int"))


def recent_share(df: DataFrame, share: float) -> DataFrame:
    """The last max(1, int(share * n)) rows by date, ties by ticker."""
    size = df.agg(F.count(F.lit(1)).alias("__k")).select((F.col("__k") - F.greatest(F.lit(1), F.floor(F.col("__k") * share))).alias("__from"))
    return positions(df, "date", "ticker", out="__n").join(F.broadcast(size)).filter(F.col("__n") >= F.col("__from")).drop("__n", "__from")  # one row
