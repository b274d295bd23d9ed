"""Row and column selections with their empty-result rules, dates as text, and bounded variances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.columns import clamp
from chronopanel.functions.ranks import positions
from chronopanel.sources.files import require_columns, require_rows

TARGETS = ("log_volatility", "log_volume", "log_return", "weighted_log_return")
LOG_VARIANCE_BOUND, VARIANCE_FLOOR = 700.0, 1e-10


def by_split(df: DataFrame, split: str, strict: bool = True) -> DataFrame:
    """Rows of one split; a table without splits is returned as it is."""
    if "split" not in df.columns:
        return df
    found = df.filter(F.col("split") == split)
    return require_rows(found, f"split {split}") if strict else found


def by_date_range(df: DataFrame, start: str, end: str, date: str = "date", strict: bool = True) -> DataFrame:
    found = df.filter(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return require_rows(found, f"{start} to {end}") if strict else found


def by_year(df: DataFrame, year: int, date: str = "date") -> DataFrame:
    """A range of dates rather than year(date), so that the filter reaches the scan."""
    if not 1900 <= year <= 2100:
        raise ValueError(f"{year} lies outside 1900 to 2100")
    return df.filter((F.col(date) >= F.to_date(F.lit(f"{year}-01-01"))) & (F.col(date) < F.to_date(F.lit(f"{year + 1}-01-01"))))


def split_by_date(df: DataFrame, day: str, date: str = "date") -> DataFrame:
    return df.withColumn("split", F.when(F.col(date) < F.to_date(F.lit(day)), "train").otherwise("test"))


def without_metadata(df: DataFrame) -> DataFrame:
    return df.drop("date", "split", "ticker", "tickers")


def features_and_target(df: DataFrame, target: str = "log_volatility") -> tuple[DataFrame, DataFrame]:
    return without_metadata(require_columns(df, [target])).drop(target), df.select(target)


def target_name(df: DataFrame) -> str:
    """The first known target that the table has."""
    found = [c for c in TARGETS if c in df.columns]
    if not found:
        raise KeyError(f"none of {TARGETS}")
    return found[0]


def ordered_output(df: DataFrame) -> DataFrame:
    """Train before test, then date and ticker; for sinks only."""
    return df.orderBy(F.when(F.col("split") == "train", 0).otherwise(1), "date", "ticker")


def top(df: DataFrame, by: str, k: int = 20, ties: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(by), *([ties] if ties else [])).limit(k)


def plotting_sample(df: DataFrame, n: int = 500, method: str = "uniform", date: str = "date") -> DataFrame:
    """uniform: every k-th row by date (ties by all columns), k the whole part of rows over n; random: n rows by a hash of the row."""
    if method == "random":
        return df.orderBy(F.xxhash64(*df.columns), *df.columns).limit(n)
    if method != "uniform":
        raise ValueError(f"{method!r} is no sampling method")
    step = max(1, df.count() // n)
    at = positions(df, date, *(c for c in df.columns if c != date), out="__at")
    return at.filter(F.pmod("__at", F.lit(step)) == 0).select(*df.columns)


def date_text(c: Column, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(c, pattern)


def parsed_date(c: Column) -> Column:
    """Tolerant parse of text; null where it is no date."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy/MM/dd")), F.try_to_timestamp(c, F.lit("dd.MM.yyyy"))).cast("date")


def bounded_variance(log_variance: Column) -> Column:
    return F.greatest(F.exp(clamp(log_variance, -LOG_VARIANCE_BOUND, LOG_VARIANCE_BOUND)), F.lit(VARIANCE_FLOOR))


def parsed_levels(text: str) -> tuple[float, ...]:
    """'0.01,0.05' as distinct ascending levels between 0 and 1."""
    levels = sorted({float(x) for x in text.split(",") if x.strip()})
    if not levels or not all(0 < x < 1 for x in levels):
        raise ValueError(f"{text!r} is no list of levels")
    return tuple(levels)


def correlation_bands(acf: DataFrame) -> DataFrame:
    """Lags with a 95 % band and whether they leave it."""
    band = F.lit(1.96) / F.sqrt("n")
    return acf.withColumn("band", band).withColumn("outside", F.abs("r") > band)


def date_extent(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))


def described(df: DataFrame, value: str, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """n, mean, std, min, quartiles, max by split. Quartiles are exact, so a task holds the distinct values of a split: for a single series."""
    v = F.col(value)
    quartiles = [F.percentile(v, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *quartiles, F.max(v).alias("max"))


def first_per_date(df: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("date").orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
