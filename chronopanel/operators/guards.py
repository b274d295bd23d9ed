"""Leakage and integrity checks as queries that return violations (no rows: all is well), and their raising forms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .features import by_date


def split_violations(df: DataFrame, ticker: str | None = None) -> DataFrame:
    """Series whose last train date is not before the first test date, or with another split value."""
    keys = [ticker] if ticker else []
    day = lambda s: F.when(F.col("split") == s, F.col("date"))
    ends = df.groupBy(*keys).agg(F.max(day("train")).alias("last_train"), F.min(day("test")).alias("first_test"), F.count_if(~F.coalesce(F.col("split").isin("train", "test"), F.lit(False))).alias("n_unknown"))
    return ends.filter((F.col("last_train") >= F.col("first_test")) | (F.col("n_unknown") > 0))


def order_violations(df: DataFrame, ticker: str | None = "ticker") -> DataFrame:
    """Rows that share their date with the row before."""
    return df.withColumn("__b", F.lag("date").over(by_date(ticker))).filter(F.col("date") <= F.col("__b")).drop("__b")


def non_positive(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull() | (F.col(column) <= 0))


def interleaved(df: DataFrame) -> DataFrame:
    """Train rows that follow a test row, in a single series."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__seen", F.max((F.col("split") == "test").cast("int")).over(w)).filter((F.col("split") == "train") & (F.col("__seen") == 1)).drop("__seen")


def all_null_columns(df: DataFrame, columns: list[str]) -> list[str]:
    row = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    return [c for c in columns if not row[c]]


def bad_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many nulls, NaNs and infinities each column has."""
    inf = float("inf")
    found = df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == inf)).alias(c) for c in columns))
    return found.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*columns))).alias("column", "n_bad"))


def require_clean(violations: DataFrame, what: str) -> None:
    found = violations.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {found}")


def assert_fold(train_start: int, train_end: int, val_start: int, val_end: int, size: int) -> None:
    """A fold's positions: train strictly before validation, both inside the data."""
    if not 0 <= train_start < train_end <= val_start < val_end <= size:
        raise ValueError(f"fold [{train_start}, {train_end}) / [{val_start}, {val_end}) of {size} looks ahead or out of range")


def require_keys(result: dict, keys: Iterable[str], lengths: dict[str, int] | None = None, equal: dict | None = None) -> dict:
    """A test's result has the keys, lists of the given lengths, and the given values."""
    missing = sorted({*keys, *(lengths or {}), *(equal or {})} - set(result))
    wrong = [k for k, n in (lengths or {}).items() if k in result and len(result[k]) != n] + [k for k, v in (equal or {}).items() if k in result and result[k] != v]
    if missing or wrong:
        raise ValueError(f"missing {missing}, unexpected {wrong}")
    return result


def require_report(report: dict, tests: Iterable[str] = ("ljung_box", "ljung_box_squared", "arch_lm")) -> dict:
    """A report holds a result of its own for each test."""
    require_keys(report, tests)
    if loose := [t for t in tests if not isinstance(report[t], dict)]:
        raise ValueError(f"no results: {loose}")
    return report
