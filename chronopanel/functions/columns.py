"""Column expressions that encode null, zero and infinity rules once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """Null for NaN and both infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < INF), c)


def log_ratio(now: Column, before: Column) -> Column:
    """ln(now / before), null unless the ratio is positive and finite."""
    ratio = F.try_divide(now.cast("double"), before.cast("double"))
    return F.when((ratio > 0) & (ratio < INF), F.log(ratio))


def log1p_clamped(c: Column) -> Column:
    return F.log1p(F.when(c < 0, F.lit(0.0)).otherwise(c.cast("double")))


def full_frame(agg: Column, counted: Column, frame: WindowSpec, least: int) -> Column:
    """agg over frame, null where fewer than least rows have a value."""
    return F.when(F.count(counted).over(frame) >= least, agg.over(frame))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded, so that sums in another order compare equal; engines differ on exact ties, so values move off them first."""
    return df.select(*(F.round(F.col(c) + F.lit(1.3e-9), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def crc_code(c: Column) -> Column:
    """Stable integer code of a name; null counts as empty."""
    return F.crc32(F.coalesce(c, F.lit("")).cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def text_key(*columns: Column) -> Column:
    """60 bits of the MD5 of the columns as text, nulls left out: the same number in any engine."""
    text = F.concat_ws("|", *(c.cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def week_end(date: Column) -> Column:
    """The Sunday on or after date."""
    return F.next_day(F.date_sub(date, 1), "SUN")


def normalised_ticker(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\.", "-")


def new_york_date(ts: Column) -> Column:
    """Calendar day in New York of a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))
