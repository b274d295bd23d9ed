"""Panel features: every window is by ticker and date, so one exchange serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronopanel.functions.columns import finite, full_frame, log1p_clamped, log_ratio, week_end

LAGS = (1, 2, 3)
TECHNICAL = ("abs_ret", "ret_sq", "log_return", "log_volume", "log_volume_rel_ma_5", "log_volume_zscore_20", "log_turnover", "turnover_rel_ma_5", "obv", "atr")
CALENDAR = ("day_of_week", "month", "is_month_end", "day_in_month_norm")


def by_date(ticker: str | None = "ticker", date: str = "date") -> WindowSpec:
    return Window.partitionBy(ticker).orderBy(date) if ticker else Window.orderBy(date)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def log_returns(df: DataFrame, price: str = "close", ticker: str | None = "ticker", out: str = "log_return", drop_first: bool = True) -> DataFrame:
    """ln(c_t / c_{t-1}); drop_first drops each series' first row, not rows with a void ratio."""
    w = by_date(ticker)
    df = df.withColumn(out, log_ratio(F.col(price), F.lag(price).over(w)))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n > 1").drop("__n") if drop_first else df


def log_volatility(r: Column, w: WindowSpec, n: int = 5) -> Column:
    f = last_rows(w, n)
    return F.log1p(F.sqrt(full_frame(F.sum(r * r), r, f, n)))


def with_volatility(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumn("log_volatility", log_volatility(F.col("log_return"), by_date(), n))


def with_log_volume(df: DataFrame) -> DataFrame:
    return df if "log_volume" in df.columns else df.withColumn("log_volume", log1p_clamped(F.col("volume")))


def with_return_features(df: DataFrame) -> DataFrame:
    r = log_ratio(F.col("close"), F.lag("close").over(by_date()))
    return df.withColumn("log_return", r).withColumn("abs_ret", F.abs("log_return")).withColumn("ret_sq", F.col("log_return") * F.col("log_return"))


def with_volume_features(df: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    w, v = by_date(), F.col("log_volume")
    df = df.withColumn("log_volume", F.log1p(F.col("volume").cast("double")))
    spread = full_frame(F.stddev_samp(v), v, last_rows(w, long), long)
    return df.withColumn("log_volume_rel_ma_5", v - full_frame(F.avg(v), v, last_rows(w, short), short)).withColumn("log_volume_zscore_20", (v - full_frame(F.avg(v), v, last_rows(w, long), long)) / F.nullif(spread, F.lit(0.0)))


def with_turnover_features(df: DataFrame, n: int = 5) -> DataFrame:
    t = F.col("log_turnover")
    df = df.withColumn("log_turnover", F.log1p(finite(F.col("volume") * F.col("close"))))
    return df.withColumn("turnover_rel_ma_5", t - full_frame(F.avg(t), t, last_rows(by_date(), n), n))


def with_obv(df: DataFrame) -> DataFrame:
    w = by_date()
    df = df.withColumn("__flow", F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0)) * F.col("volume"))
    return df.withColumn("obv", F.sum("__flow").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__flow")


def with_atr(df: DataFrame, n: int = 14, least: int = 1) -> DataFrame:
    """Average true range; the pipeline averages from the first row on (least=1), the stand-alone form needs n rows."""
    w, before = by_date(), F.lag("close").over(by_date())
    df = df.withColumn("__tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return df.withColumn("atr", full_frame(F.avg("__tr"), F.col("__tr"), last_rows(w, n), least)).drop("__tr")


def with_calendar(df: DataFrame) -> DataFrame:
    d = F.col("date")
    return (
        df.withColumn("day_of_week", F.weekday(d))
        .withColumn("month", F.month(d))
        .withColumn("is_month_end", (d == F.last_day(d)).cast("int"))
        .withColumn("day_in_month_norm", F.dayofmonth(d) / F.lit(31.0))
    )


def with_all_features(df: DataFrame) -> DataFrame:
    """All indicators in one window stage."""
    for step in (with_volume_features, with_return_features, with_turnover_features, with_obv, with_atr, with_calendar):
        df = step(df)
    return df


def with_lags(df: DataFrame, columns: list[str], lags: tuple[int, ...] = LAGS) -> DataFrame:
    if any(k <= 0 for k in lags):
        raise ValueError(f"lags are positive, not {lags}")
    w = by_date()
    return df.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in columns for k in lags})


def with_next_target(df: DataFrame, target: str = "log_volatility") -> DataFrame:
    """The target becomes the next day's value; each ticker's last row goes."""
    return df.withColumn(target, F.lead(target).over(by_date())).filter(F.col(target).isNotNull())


def liquidity_weights(df: DataFrame, n: int = 20, least: int | None = None) -> DataFrame:
    """Mean of volume times price over the last n rows with both positive, lagged by one row; not normalised."""
    w, score = by_date(), F.col("__score")
    df = df.filter((F.col("volume") > 0) & (F.col("close") > 0)).withColumn("__score", F.col("volume") * F.col("close"))
    df = df.withColumn("__mean", full_frame(F.avg(score), score, last_rows(w, n), least or n))
    return df.withColumn("weight", F.lag("__mean").over(w)).filter("weight is not null").select("date", "ticker", "weight")


def rolling_moments(df: DataFrame, value: str, n: int = 252, ticker: str | None = None) -> DataFrame:
    f, v = last_rows(by_date(ticker), n), F.col(value)
    return df.withColumn("rolling_mean", full_frame(F.avg(v), v, f, n)).withColumn("rolling_std", full_frame(F.stddev_samp(v), v, f, n))


def weekly(df: DataFrame, value: str, how: str = "sum") -> DataFrame:
    """Sunday-ended weeks that have a value."""
    agg = {"sum": F.sum, "mean": F.avg}[how](value)
    return df.groupBy(week_end(F.col("date")).alias("week")).agg(agg.alias(value)).filter(F.col(value).isNotNull())


def seasonal_means(df: DataFrame, value: str, period: int = 7) -> DataFrame:
    """Additive decomposition by a centred moving average of an odd period: trend, seasonal (mean zero over the period), rest."""
    w = by_date(None)
    half, v = period // 2, F.col(value)
    df = df.withColumn("__n", F.row_number().over(w) - 1).withColumn("trend", full_frame(F.avg(v), v, w.rowsBetween(-half, half), period))
    phase = df.groupBy((F.col("__n") % period).alias("phase")).agg(F.avg(v - F.col("trend")).alias("m"))
    phase = phase.withColumn("seasonal", F.col("m") - F.avg("m").over(Window.partitionBy())).drop("m")
    df = df.withColumn("phase", F.col("__n") % period).join(F.broadcast(phase), "phase")  # period rows
    return df.withColumn("resid", v - F.col("trend") - F.col("seasonal")).drop("__n")
