"""All time-series queries by name: the Spark plan, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions import special
from chronopanel.functions.columns import crc_code, new_york_date, normalised_ticker, rounded
from chronopanel.operators import arima, cleaning, comparison, datasets, diagnostics, egarch, evaluate, features, guards, labels, models, refits, selection, splits
from chronopanel.sources import files, panels
from chronopanel.sources.staging import staged

from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

PRM = egarch.Params(-0.31, (0.23,), (-0.18,), (0.97,), nu=7.3)
PRM_21 = egarch.Params(-0.31, (0.15, 0.08), (-0.1, -0.05), (0.97,), nu=7.3)
PRM_12 = egarch.Params(-0.31, (0.23,), (-0.18,), (0.6, 0.3), nu=7.3)
PRM_22 = egarch.Params(-0.31, (0.15, 0.08), (-0.1, -0.05), (0.6, 0.3), nu=7.3)
SKEW = egarch.Params(-0.31, (0.23,), (-0.18,), (0.97,), nu=7.3, lam=-0.3, dist="skewt")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Scans and aggregates


@query(S.with_(S.PANEL, f"SELECT ticker, date, {S.r('close')}, {S.r('high')}, {S.r('low')}, volume FROM panel"))
def panel_build(spark, d):
    return rounded(panels.panel(spark, d))


@query(S.with_(S.PRIO, f"SELECT ticker, date, {S.r('close')}, {S.r('high')}, {S.r('low')}, volume FROM prio"))
def panel_prio_build(spark, d):
    return rounded(panels.panel_prio(spark, d))


@query(S.with_(S.INDEX, f"SELECT date, {S.r('close')}, {S.r('r', 'weighted_log_return')} FROM idx"))
def index_build(spark, d):
    return rounded(panels.index(spark, d))


@query(S.with_(S.PANEL, "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date FROM panel"))
def fetch_report(spark, d):
    return files.fetch_report(panels.panel(spark, d))


@query(S.with_(S.PANEL, "SELECT CAST(ticker AS VARCHAR) AS tickers, min(date) AS first, max(date) AS last FROM panel GROUP BY 1 HAVING min(date) <= DATE '1996-12-31' AND max(date) >= DATE '1996-01-01'"))
def range_coverage(spark, d):
    df = panels.panel(spark, d).select(F.col("ticker").cast("string").alias("tickers"), "date")
    return files.covered_tickers(df, "1996-01-01", "1996-12-31")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS tickers FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1992-02-01')")
def failed_tickers(spark, d):
    early = panels.table(spark, d, "lineitem").filter(F.col("l_shipdate") < F.lit("1992-02-01").cast("timestamp")).select(F.col("l_suppkey").cast("string").alias("tickers")).distinct()
    return files.failed_tickers(panels.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker")), early)


@query("SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS tickers, l_extendedprice AS high, l_discount AS low, l_quantity AS close, l_tax AS volume FROM lineitem")
def ingest_quotes(spark, d):
    raw = panels.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("Date"), F.col("l_suppkey").alias("ticker"), F.col("l_extendedprice").alias("High"), F.col("l_discount").alias("Low"), F.col("l_quantity").alias("Close"), F.col("l_tax").alias("Volume"), F.col("l_returnflag").alias("Open"))
    return files.ingest(raw)


_BASE = (S.PANEL, S.RETURNS, S.VOLATILITY, S.RANGE_SPLIT)
_CLEAN = """kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, split ORDER BY date) AS in_split FROM parts WHERE pos > 1)
  WHERE split = 'train' OR in_split > 4)"""


def _volatility(spark, d):
    return features.with_volatility(features.log_returns(panels.panel(spark, d), drop_first=False))


def _split_panel(spark, d):
    """Returns, volatility, range split, without first rows and contaminated test rows."""
    df = splits.split_by_time_range(_volatility(spark, d), least_rows=1)
    first = F.row_number().over(features.by_date())
    return splits.drop_contaminated(df.withColumn("__f", first).filter("__f > 1").drop("__f"))


@query(S.with_(*_BASE, _CLEAN, f"SELECT split, count(*) AS n, count(log_volatility) AS n_vol, count(DISTINCT ticker) AS n_tickers, min(date) AS first_date, max(date) AS last_date, {S.r('avg(log_volatility)', 'mean_vol')} FROM kept GROUP BY split"))
def split_summary(spark, d):
    agg = _split_panel(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("log_volatility").alias("n_vol"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.avg("log_volatility").alias("mean_vol"))
    return rounded(agg)


@query(S.with_(*_BASE, _CLEAN, f"SELECT date, ticker, {S.r('close')}, {S.r('high')}, {S.r('low')}, volume, {S.r('log_return')}, {S.r('log_volatility')}, split FROM kept WHERE log_return IS NOT NULL AND log_volatility IS NOT NULL AND NOT (high = 0 AND low = 0)"))
def published_table(spark, d):
    return rounded(cleaning.output_table(_split_panel(spark, d)))


@query(S.with_(*_BASE, "SELECT date, ticker, split FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM parts) WHERE n >= 2"))
def split_time_range(spark, d):
    return splits.split_by_time_range(panels.panel(spark, d)).select("date", "ticker", "split")


# Cleaning

_FIRST = "SELECT user_id, event_type, {} AS event_id FROM events GROUP BY 1, 2"


@query(_FIRST.format("arg_min(event_id, ts)"))
def dedupe_keep_first(spark, d):
    return cleaning.keep_one(panels.ticks(spark, d), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query(_FIRST.format("arg_max(event_id, ts)"))
def dedupe_keep_last(spark, d):
    return cleaning.keep_one(panels.ticks(spark, d), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS n_removed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_count(spark, d):
    return cleaning.duplicate_count(panels.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS k, coalesce(CASE WHEN o_totalprice > 100000 THEN o_totalprice END, 0) AS close, o_totalprice AS open FROM orders")
def zero_fill(spark, d):
    df = panels.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("close"), F.col("o_totalprice").alias("open"))
    return cleaning.zero_fill(df)


@query("SELECT event_id, CASE WHEN value > 50 THEN value END AS v FROM events WHERE value > 50")
def drop_null_rows(spark, d):
    return cleaning.drop_incomplete(panels.ticks(spark, d).select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("v")))


@query(f"SELECT event_id, CASE WHEN value > 1 THEN round(ln(value) + 1.3e-9, 6) + 0.0 END AS v FROM events")  # noqa: F541
def nonfinite_to_null(spark, d):
    v = F.when(F.col("value") > 1, F.log("value")).when(F.col("value") > 0.5, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return rounded(cleaning.nonfinite_to_null(panels.ticks(spark, d).select("event_id", v.alias("v")), ["v"]))


@query(S.with_(S.PANEL, "SELECT ticker, count(*) AS n FROM panel GROUP BY ticker HAVING count(*) >= 0.2 * (SELECT count(DISTINCT date) FROM panel)"))
def absence_filter(spark, d):
    return cleaning.seen_every_day(panels.panel(spark, d), 0.2)


@query("SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS day FROM events")
def new_york_days(spark, d):
    return panels.ticks(spark, d).select("event_id", new_york_date(F.col("ts")).alias("day"))


@query("SELECT DISTINCT replace(trim(p_brand || '.' || p_size), '.', '-') AS ticker FROM part")
def ticker_names(spark, d):
    return panels.table(spark, d, "part").select(normalised_ticker(F.concat_ws(".", "p_brand", "p_size")).alias("ticker")).distinct()


# Features over the panel


@query(S.with_(S.PANEL, S.RETURNS, f"SELECT ticker, date, {S.r('log_return')} FROM rets WHERE pos > 1"))
def log_return(spark, d):
    return rounded(features.log_returns(panels.panel(spark, d)).select("ticker", "date", "log_return"))


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, f"SELECT ticker, date, {S.r('log_volatility')} FROM vols"))
def log_volatility(spark, d):
    return rounded(_volatility(spark, d).select("ticker", "date", "log_volatility"))


@query(S.with_(S.PANEL, S.RETURNS, f"SELECT ticker, date, {S.r('log_return')}, {S.r('abs(log_return)', 'abs_ret')}, {S.r('log_return * log_return', 'ret_sq')} FROM rets"))
def abs_sq_return(spark, d):
    return rounded(features.with_return_features(panels.panel(spark, d)).select("ticker", "date", "log_return", "abs_ret", "ret_sq"))


@query(S.with_(S.PANEL, f"SELECT ticker, date, {S.r('ln(1 + greatest(volume, 0))', 'log_volume')} FROM panel"))
def log_volume(spark, d):
    return rounded(features.with_log_volume(panels.panel(spark, d)).select("ticker", "date", "log_volume"))


_F = "PARTITION BY ticker ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
_LV = "lv AS (SELECT ticker, date, ln(1 + volume) AS v FROM panel)"


@query(S.with_(S.PANEL, _LV, f"SELECT ticker, date, CASE WHEN count(v) OVER f >= 5 THEN round(v - avg(v) OVER f + 1.3e-9, 6) + 0.0 END AS log_volume_rel_ma_5 FROM lv WINDOW f AS ({_F.format(4)})"))
def volume_rel_ma5(spark, d):
    return rounded(features.with_volume_features(panels.panel(spark, d)).select("ticker", "date", "log_volume_rel_ma_5"))


@query(S.with_(S.PANEL, _LV, f"SELECT ticker, date, CASE WHEN count(v) OVER f >= 20 THEN round((v - avg(v) OVER f) / nullif(stddev_samp(v) OVER f, 0) + 1.3e-9, 6) + 0.0 END AS log_volume_zscore_20 FROM lv WINDOW f AS ({_F.format(19)})"))
def volume_z20(spark, d):
    return rounded(features.with_volume_features(panels.panel(spark, d)).select("ticker", "date", "log_volume_zscore_20"))


@query(S.with_(S.PANEL, "lt AS (SELECT ticker, date, ln(1 + volume * close) AS v FROM panel)", f"SELECT ticker, date, {S.r('v', 'log_turnover')}, CASE WHEN count(v) OVER f >= 5 THEN round(v - avg(v) OVER f + 1.3e-9, 6) + 0.0 END AS turnover_rel_ma_5 FROM lt WINDOW f AS ({_F.format(4)})"))
def turnover_rel_ma5(spark, d):
    return rounded(features.with_turnover_features(panels.panel(spark, d)).select("ticker", "date", "log_turnover", "turnover_rel_ma_5"))


@query(S.with_(S.PANEL, "flow AS (SELECT ticker, date, coalesce(sign(close - lag(close) OVER (PARTITION BY ticker ORDER BY date)), 0) * volume AS v FROM panel)", f"SELECT ticker, date, {S.r('sum(v) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'obv')} FROM flow"))
def obv(spark, d):
    return rounded(features.with_obv(panels.panel(spark, d)).select("ticker", "date", "obv"))


_TR = "tr AS (SELECT ticker, date, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS v FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))"


@query(S.with_(S.PANEL, _TR, f"SELECT ticker, date, CASE WHEN count(v) OVER f >= 14 THEN round(avg(v) OVER f + 1.3e-9, 6) + 0.0 END AS atr FROM tr WINDOW f AS ({_F.format(13)})"))
def atr14_strict(spark, d):
    return rounded(features.with_atr(panels.panel(spark, d), least=14).select("ticker", "date", "atr"))


@query(S.with_(S.PANEL, _TR, f"SELECT ticker, date, {S.r('avg(v) OVER f', 'atr')} FROM tr WINDOW f AS ({_F.format(13)})"))
def atr14_loose(spark, d):
    return rounded(features.with_atr(panels.panel(spark, d)).select("ticker", "date", "atr"))


@query(S.with_(S.PANEL, f"SELECT ticker, date, CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(month(date) AS INT) AS month, CAST(date = last_day(date) AS INT) AS is_month_end, {S.r('day(date) / 31.0', 'day_in_month_norm')} FROM panel"))
def calendar(spark, d):
    return rounded(features.with_calendar(panels.panel(spark, d).select("ticker", "date")))


_FEATURES = ("log_volume", "log_volume_rel_ma_5", "log_volume_zscore_20", "log_return", "abs_ret", "ret_sq", "log_turnover", "turnover_rel_ma_5", "obv", "atr", "day_of_week", "month", "is_month_end", "day_in_month_norm")
_ALL = f"""base AS (
  SELECT *, ln(1 + volume) AS lv, ln(1 + volume * close) AS lt, coalesce(sign(close - lag(close) OVER w), 0) * volume AS flow, ln(close / lag(close) OVER w) AS log_return,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)),
feats AS (
  SELECT ticker, date, close, high, low, volume, log_return, abs(log_return) AS abs_ret, log_return * log_return AS ret_sq, lv AS log_volume, lt AS log_turnover,
    CASE WHEN count(*) OVER f5 >= 5 THEN lv - avg(lv) OVER f5 END AS log_volume_rel_ma_5,
    CASE WHEN count(*) OVER f20 >= 20 THEN (lv - avg(lv) OVER f20) / nullif(stddev_samp(lv) OVER f20, 0) END AS log_volume_zscore_20,
    CASE WHEN count(*) OVER f5 >= 5 THEN lt - avg(lt) OVER f5 END AS turnover_rel_ma_5,
    sum(flow) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS obv, avg(tr) OVER f14 AS atr,
    CASE WHEN count(log_return) OVER f5 >= 5 THEN ln(1 + sqrt(sum(log_return * log_return) OVER f5)) END AS log_volatility,
    CAST(isodow(date) - 1 AS INT) AS day_of_week, CAST(month(date) AS INT) AS month, CAST(date = last_day(date) AS INT) AS is_month_end, day(date) / 31.0 AS day_in_month_norm
  FROM base WINDOW f5 AS ({_F.format(4)}), f14 AS ({_F.format(13)}), f20 AS ({_F.format(19)}))"""
_INTS = ("day_of_week", "month", "is_month_end")


@query(S.with_(S.PANEL, _ALL, "SELECT ticker, date, " + ", ".join(c if c in _INTS else S.r(c) for c in _FEATURES) + " FROM feats"))
def all_features(spark, d):
    return rounded(features.with_all_features(panels.panel(spark, d)).select("ticker", "date", *_FEATURES))


_LAG = "PARTITION BY ticker ORDER BY date"


@query(S.with_(S.PANEL, S.RETURNS, "SELECT ticker, date, " + ", ".join(S.r(f"lag({c}, {k}) OVER ({_LAG})", f"{c}_lag_{k}") for c in ("log_return", "volume") for k in (1, 2, 3)) + " FROM rets"))
def lags_1_3(spark, d):
    df = features.with_lags(features.log_returns(panels.panel(spark, d), drop_first=False), ["log_return", "volume"])
    return rounded(df.select("ticker", "date", *(f"{c}_lag_{k}" for c in ("log_return", "volume") for k in (1, 2, 3))))


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, f"SELECT * FROM (SELECT ticker, date, {S.r('lead(log_volatility) OVER (PARTITION BY ticker ORDER BY date)', 'log_volatility')} FROM vols) WHERE log_volatility IS NOT NULL"))
def target_lead(spark, d):
    return rounded(features.with_next_target(_volatility(spark, d)).select("ticker", "date", "log_volatility"))


@query(S.with_(S.PANEL, f"m AS (SELECT ticker, date, CASE WHEN count(*) OVER f >= 20 THEN avg(volume * close) OVER f END AS v FROM panel WINDOW f AS ({_F.format(19)}))", f"SELECT date, ticker, {S.r('v', 'weight')} FROM (SELECT ticker, date, lag(v) OVER ({_LAG}) AS v FROM m) WHERE v IS NOT NULL"))
def liquidity_weights(spark, d):
    return rounded(features.liquidity_weights(panels.panel(spark, d)))


@query(S.with_(S.INDEX, f"SELECT date, CASE WHEN count(*) OVER f >= 252 THEN round(avg(r) OVER f + 1.3e-9, 6) + 0.0 END AS rolling_mean, CASE WHEN count(*) OVER f >= 252 THEN round(stddev_samp(r) OVER f + 1.3e-9, 6) + 0.0 END AS rolling_std FROM idx WINDOW f AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"))
def rolling_mean_std_252(spark, d):
    return rounded(features.rolling_moments(panels.index(spark, d), "weighted_log_return").select("date", "rolling_mean", "rolling_std"))


_WEEK = "date + CAST((7 - isodow(date)) % 7 AS INT)"


@query(S.with_(S.INDEX, f"SELECT {_WEEK} AS week, {S.r('sum(r)', 'weighted_log_return')} FROM idx GROUP BY 1"))
def weekly_resample_sum(spark, d):
    return rounded(features.weekly(panels.index(spark, d), "weighted_log_return", "sum"))


@query(S.with_(S.INDEX, f"SELECT {_WEEK} AS week, {S.r('avg(r)', 'weighted_log_return')} FROM idx GROUP BY 1"))
def weekly_resample_mean(spark, d):
    return rounded(features.weekly(panels.index(spark, d), "weighted_log_return", "mean"))


@query(S.with_(S.INDEX, """n AS (SELECT date, close, row_number() OVER (ORDER BY date) - 1 AS i, CASE WHEN count(*) OVER f >= 7 THEN avg(close) OVER f END AS trend FROM idx WINDOW f AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
m AS (SELECT i % 7 AS phase, avg(close - trend) AS m FROM n GROUP BY 1), s AS (SELECT phase, m - (SELECT avg(m) FROM m) AS seasonal FROM m)""", f"SELECT date, {S.r('trend')}, {S.r('seasonal')}, {S.r('close - trend - seasonal', 'resid')} FROM n JOIN s ON n.i % 7 = s.phase"))
def seasonal_decomposition(spark, d):
    return rounded(features.seasonal_means(panels.index(spark, d), "close", 7).select("date", "trend", "seasonal", "resid"))


# Splits, warm-up, folds


@query(S.with_(S.PANEL, "r AS (SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS k FROM (SELECT DISTINCT date FROM panel))", "SELECT p.ticker, p.date, CASE WHEN n <= floor(k * 0.8) THEN 'train' ELSE 'test' END AS split FROM panel p JOIN r ON p.date = r.date"))
def split_distinct_dates(spark, d):
    return splits.split_by_distinct_dates(panels.panel(spark, d)).select("ticker", "date", "split")


@query(S.with_(S.INDEX, "SELECT date, CASE WHEN row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM idx"))
def split_row_ratio(spark, d):
    return splits.split_by_rows(panels.index(spark, d)).select("date", "split")


@query(S.with_(S.INDEX, "n AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS k FROM idx)", "SELECT date, CASE WHEN i <= floor(k * 0.7) THEN 'train' WHEN i <= floor(k * 0.7) + floor(k * 0.2) THEN 'validation' ELSE 'test' END AS split FROM n"))
def three_phase(spark, d):
    return splits.three_phase(panels.index(spark, d)).select("date", "split")


@query(S.with_(S.PANEL, f"SELECT ticker, date, volume FROM (SELECT *, row_number() OVER ({_LAG}) AS n FROM panel) WHERE n > 20"))
def warmup_trim(spark, d):
    return splits.trim_warmup(panels.panel(spark, d)).select("ticker", "date", "volume")


@query(S.with_(*_BASE, "SELECT ticker, date, split FROM (SELECT *, row_number() OVER (PARTITION BY ticker, split ORDER BY date) AS n FROM parts) WHERE split = 'train' OR n > 4"))
def contamination_drop(spark, d):
    return splits.drop_contaminated(splits.split_by_time_range(panels.panel(spark, d), least_rows=1)).select("ticker", "date", "split")


@query(S.with_(S.PANEL, f"SELECT ticker, date FROM (SELECT *, row_number() OVER ({_LAG}) AS n FROM panel) WHERE n > 250"))
def skip_first_250(spark, d):
    return splits.skip_first(panels.panel(spark, d)).select("ticker", "date")


@query(S.with_(S.INDEX, "k AS (SELECT count(*) AS n, count(*) // 6 AS size FROM idx)", "SELECT f.range AS fold, n - (5 - f.range) * size AS n_train, n - (5 - f.range) * size AS first_test, n - (5 - f.range) * size + size - 1 AS last_test FROM k, range(0, 5) f"))
def ts_cv_folds(spark, d):
    return splits.ordered_folds(panels.index(spark, d)).select(F.col("fold").cast("long").alias("fold"), *(F.col(c).cast("long").alias(c) for c in ("n_train", "first_test", "last_test")))


_POS = "p AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS position FROM idx)"


@query(S.with_(S.INDEX, _POS, "SELECT date, CAST(position AS INT) AS position, CAST((position - 30) % 21 = 0 AS INT) AS refit FROM p WHERE position >= 30"))
def refit_schedule(spark, d):
    return splits.refit_schedule(panels.index(spark, d))


@query(S.with_(S.INDEX, _POS, "SELECT date, CAST(position AS INT) AS position, CAST(greatest(0, position - 500) AS INT) AS lo, CAST(position AS INT) AS hi FROM p WHERE position >= 30"))
def window_bounds(spark, d):
    return splits.window_bounds(splits.refit_schedule(panels.index(spark, d)).drop("refit"), "rolling", 500)


@query(S.with_(S.PANEL, "SELECT ticker, date FROM (SELECT *, row_number() OVER (ORDER BY date DESC, ticker DESC) AS i, count(*) OVER () AS k FROM panel) WHERE i <= greatest(1, floor(k * 0.3))"))
def recent_share(spark, d):
    return splits.recent_share(panels.panel(spark, d), 0.3).select("ticker", "date")


# Guards: rows are violations


@query(S.with_(*_BASE, "SELECT ticker, max(date) FILTER (split = 'train') AS last_train, min(date) FILTER (split = 'test') AS first_test, CAST(0 AS BIGINT) AS n_unknown FROM parts GROUP BY ticker HAVING max(date) FILTER (split = 'train') >= min(date) FILTER (split = 'test')"))
def check_split_overlap(spark, d):
    return guards.split_violations(splits.split_by_time_range(panels.panel(spark, d), least_rows=1), "ticker")


@query("SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, CAST(count(*) - 1 AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_sorted_unique(spark, d):
    rows = panels.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"))
    return guards.order_violations(rows).groupBy("ticker", "date").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, value FROM events WHERE value <= 0")
def check_positive(spark, d):
    return guards.non_positive(panels.ticks(spark, d), "value").select("event_id", "value")


@query(S.with_(S.INDEX, "s AS (SELECT date, CASE WHEN month(date) = 6 THEN 'test' ELSE 'train' END AS split FROM idx)", "SELECT date FROM s WHERE split = 'train' AND date > (SELECT min(date) FROM s WHERE split = 'test')"))
def check_interleave(spark, d):
    rows = panels.index(spark, d).select("date", F.when(F.month("date") == 6, "test").otherwise("train").alias("split"))
    return guards.interleaved(rows).select("date")


@query(S.with_(S.PANEL, S.RETURNS, "SELECT 'log_return' AS \"column\", count(*) FILTER (log_return IS NULL) AS n_bad FROM rets UNION ALL SELECT 'close', count(*) FILTER (close IS NULL) FROM rets"))
def check_numbers(spark, d):
    return guards.bad_numbers(features.log_returns(panels.panel(spark, d), drop_first=False), ["log_return", "close"])


# Joins, unions, codes


@query(S.with_(S.PANEL, S.INDEX, f"SELECT p.ticker, p.date, {S.r('r', 'weighted_log_return')} FROM panel p LEFT JOIN idx ON p.date = idx.date"))
def join_index_left(spark, d):
    return rounded(cleaning.join_index(panels.panel(spark, d), panels.index(spark, d)).select("ticker", "date", "weighted_log_return"))


def _residuals(spark, d) -> DataFrame:
    """date, y_true, y_pred, arima_resid of the index; e repeats the residual."""
    return arima.mean_forecasts(panels.index(spark, d), "weighted_log_return", 30).withColumn("e", F.col("arima_resid"))


@query(S.with_(S.INDEX, S.RESIDUALS, f"SELECT idx.date, {S.r('r')}, {S.r('e', 'arima_resid')} FROM idx JOIN res ON idx.date = res.date"))
def join_residuals_inner(spark, d):
    left = panels.index(spark, d).select("date", F.col("weighted_log_return").alias("r"))
    return rounded(cleaning.attach_residuals(left, _residuals(spark, d).select("date", "arima_resid")))


_SIG = "sig AS (SELECT date, ln(sqrt(r * r + 0.01)) AS log_sigma_garch FROM idx)"


def _insight(spark, d):
    r = F.col("weighted_log_return")
    return panels.index(spark, d).select("date", F.log(F.sqrt(r * r + 0.01)).alias("log_sigma_garch"))


@query(S.with_(S.PANEL, S.INDEX, _SIG, f"SELECT ticker, n.date, {S.r('log_sigma_garch')} FROM (SELECT *, row_number() OVER ({_LAG}) AS i FROM panel) n LEFT JOIN sig ON n.date = sig.date WHERE i > 250"))
def join_insight(spark, d):
    return rounded(cleaning.join_insight(panels.panel(spark, d), _insight(spark, d)).select("ticker", "date", "log_sigma_garch"))


@query(S.with_(S.INDEX, f"SELECT date, {S.r('CASE WHEN date >= DATE $$1996-01-01$$ THEN r * 2 ELSE r END', 'v')} FROM idx".replace("$$", "'")))
def union_residuals(spark, d):
    rows = panels.index(spark, d).select("date", F.col("weighted_log_return").alias("v"))
    return rounded(cleaning.combine_residuals(rows, rows.filter("date >= '1996-01-01'").withColumn("v", F.col("v") * 2)))


@query("SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS ticker_id FROM orders")
def ticker_code(spark, d):
    return cleaning.ticker_codes(panels.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ticker"))).select("o_orderkey", "ticker_id")


_BITS = "flatten([[ascii(x)] || [256 for k in range(0, 8)] for x in string_split(o_orderpriority, '')])"
_CRC = f"list_reduce([CAST(x AS BIGINT) for x in [4294967295] || {_BITS}], lambda c, x: CASE WHEN x < 256 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"


@query(f"SELECT o_orderpriority, CAST(xor({_CRC}, 4294967295) % 2147483648 AS INT) AS ticker_id FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def ticker_crc32(spark, d):
    return panels.table(spark, d, "orders").select("o_orderpriority").distinct().select("o_orderpriority", crc_code(F.col("o_orderpriority")).alias("ticker_id"))


# Walk-forward means


@query(S.with_(S.INDEX, S.RESIDUALS, f"SELECT date, {S.r('y_true')}, {S.r('y_pred')}, {S.r('e', 'arima_resid')} FROM res"))
def arima_mean_rolling(spark, d):
    return rounded(_residuals(spark, d).drop("e"))


@query(S.with_(S.INDEX, S.RESIDUALS, f"SELECT {S.r('avg(e * e)', 'mse')}, {S.r('sqrt(avg(e * e))', 'rmse')}, {S.r('avg(abs(e))', 'mae')}, {S.r('avg(e)', 'mean_error')}, count(*) AS n FROM res"))
def arima_metrics(spark, d):
    return rounded(arima.forecast_metrics(_residuals(spark, d)))


_DATASET = """tagged AS (SELECT date, r, row_number() OVER (ORDER BY date) - 1 AS i, floor(count(*) OVER () * 0.8) AS cut, avg(r) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM idx),
fits AS (SELECT *, CASE WHEN i < cut THEN CASE WHEN i >= 30 AND (i - 30) % 21 = 0 THEN m END ELSE CASE WHEN (i - cut) % 21 = 0 THEN m END END AS fit FROM tagged),
pred AS (SELECT *, last_value(fit IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM fits)"""


@query(S.with_(S.INDEX, _DATASET, f"SELECT date, CASE WHEN i < cut THEN 'train' ELSE 'test' END AS split, {S.r('r', 'weighted_log_return')}, {S.r('r - p', 'arima_resid')} FROM pred WHERE i >= 30"))
def arima_residual_dataset(spark, d):
    return rounded(arima.residual_dataset(splits.split_by_rows(panels.index(spark, d)), "weighted_log_return"))


@query(S.with_(S.INDEX, "n AS (SELECT date, r, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS k, avg(r) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM idx), b AS (SELECT *, (i - (k - 100)) // 20 AS block FROM n WHERE i >= k - 100), f AS (SELECT *, first_value(m) OVER (PARTITION BY block ORDER BY date) AS p FROM b)", f"SELECT block, {S.r('sqrt(avg((r - p) * (r - p)))', 'rmse')}, {S.r('avg(abs(r - p))', 'mae')}, {S.r('avg(r - p)', 'mean_error')} FROM f GROUP BY block"))
def arima_blocks(spark, d):
    return rounded(arima.walk_forward_blocks(panels.index(spark, d), "weighted_log_return", 5, 20))


_AR1 = """ly AS (SELECT ticker, date, ln(close) AS y, ln(close) - lag(ln(close)) OVER w AS z, row_number() OVER w - 1 AS i FROM prio WINDOW w AS (PARTITION BY ticker ORDER BY date)),
lz AS (SELECT *, lag(z) OVER w AS b FROM ly WINDOW w AS (PARTITION BY ticker ORDER BY date)),
lf AS (SELECT *, lag(y) OVER w + regr_intercept(z, b) OVER f + regr_slope(z, b) OVER f * lag(z) OVER w AS step FROM lz
  WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lp AS (SELECT *, last_value(CASE WHEN i >= 100 AND (i - 100) % 21 = 0 THEN step END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM lf)"""


@query(S.with_(S.PRIO, _AR1, f"SELECT ticker AS series, date, {S.r('y', 'y_true')}, {S.r('p', 'y_pred')}, {S.r('y - p', 'arima_resid')} FROM lp WHERE i >= 100"))
def arima_110(spark, d):
    df = panels.panel_prio(spark, d).select(F.col("ticker").alias("series"), "date", F.log("close").alias("value"))
    return rounded(df.groupBy("series").applyInPandas(arima.arima_forecasts((1, 1, 0), 100), "series string, date date, y_true double, y_pred double, arima_resid double"))


# Conditional variance


def _series(spark, d) -> DataFrame:
    return _residuals(spark, d).select(F.lit("index").alias("series"), "date", "e")


def _path_sql(prm: egarch.Params, select: str) -> str:
    return S.with_(S.INDEX, S.RESIDUALS, S.egarch_path(prm.omega, prm.alpha, prm.gamma, prm.beta, prm.kappa), select, recursive=True)


_PATH = f"SELECT res.date, {S.r('path.ln', 'log_sigma2')} FROM path JOIN res ON res.k = path.k"


def _log_path(spark, d, prm):
    return rounded(egarch.filtered(_series(spark, d), prm).select("date", F.log("sigma2").alias("log_sigma2")))


@query(_path_sql(PRM, _PATH))
def egarch_path_11(spark, d):
    return _log_path(spark, d, PRM)


@query(_path_sql(PRM_21, _PATH))
def egarch_path_21(spark, d):
    return _log_path(spark, d, PRM_21)


@query(_path_sql(PRM_12, _PATH))
def egarch_path_12(spark, d):
    return _log_path(spark, d, PRM_12)


@query(_path_sql(PRM_22, _PATH))
def egarch_path_22(spark, d):
    return _log_path(spark, d, PRM_22)


@query(_path_sql(SKEW, _PATH))
def egarch_path_skewt(spark, d):
    return _log_path(spark, d, SKEW)


@query(_path_sql(PRM, f"SELECT res.date, {S.r('res.e / exp(path.ln / 2)', 'z')} FROM path JOIN res ON res.k = path.k"))
def std_residuals(spark, d):
    return rounded(egarch.filtered(_series(spark, d), PRM).select("date", "z"))


def _forecasts(spark, d) -> DataFrame:
    """date, e, sigma2: the variance of each day as forecast the day before."""
    return egarch.fast_forecasts(_series(spark, d), PRM).select("date", "e", F.col("forecast").alias("sigma2"))


@query(_path_sql(PRM, f"SELECT res.date, CASE WHEN res.k > 0 THEN round(path.ln + 1.3e-9, 6) + 0.0 END AS log_forecast FROM path JOIN res ON res.k = path.k"))  # noqa: F541
def egarch_one_step(spark, d):
    return rounded(_forecasts(spark, d).select("date", F.log("sigma2").alias("log_forecast")))


_MULTI = f"SELECT CAST(h.range AS INT) AS h, round(power(0.97, h.range) * ln(0.04) - 0.31 * (1 - power(0.97, h.range)) / (1 - 0.97) + 1.3e-9, 6) + 0.0 AS log_sigma2 FROM range(1, 31) h"  # noqa: F541


@query(_MULTI)
def egarch_multi_step(spark, d):
    state = spark.createDataFrame([(0.04,)], "s2_last double")
    return rounded(egarch.multi_step(state, 30, PRM).select("h", F.log("sigma2").alias("log_sigma2")))


_SKEWED = {k: special.quantile("skewt", p, SKEW.nu, SKEW.lam) for k, p in (("pi_low", (1 - 0.95) / 2), ("pi_high", 1 - (1 - 0.95) / 2), ("value_at_risk", 1 - 0.95))}


@query("WITH v AS (SELECT CAST(h.range AS INT) AS h, exp(power(0.97, h.range) * ln(0.04) - 0.31 * (1 - power(0.97, h.range)) / (1 - 0.97)) AS sigma2 FROM range(1, 11) h) SELECT h, " + ", ".join([S.r("sigma2"), S.r("sqrt(sigma2)", "sigma"), *(S.r(f"sqrt(sigma2) * CAST({q!r} AS DOUBLE)", k) for k, q in _SKEWED.items())]) + " FROM v")
def forecast_table(spark, d):
    state = spark.createDataFrame([(0.04,)], "s2_last double")
    return rounded(egarch.forecast_table(state, 10, SKEW))


_EXACT = f"""begun AS (SELECT k AS t, date, e, ln(greatest(var_pop(e) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e-10)) AS ln FROM res),
walk AS (
  SELECT begun.t, CAST(0 AS BIGINT) AS k, begun.ln, res.e / exp(begun.ln / 2) AS z FROM begun JOIN res ON res.k = 0 WHERE begun.t >= 100
  UNION ALL
  SELECT n.t, n.k, n.ln, n.e / exp(n.ln / 2) FROM (
    SELECT s.t, s.k + 1 AS k, res.e, {PRM.omega!r} + {PRM.beta[0]!r} * s.ln + {PRM.alpha[0]!r} * (abs(s.z) - {PRM.kappa!r}) + {PRM.gamma[0]!r} * s.z AS ln
    FROM walk s JOIN res ON res.k = s.k + 1 WHERE s.k + 1 < s.t) n)"""


@query(S.with_(S.INDEX, S.RESIDUALS, _EXACT, f"SELECT 'index' AS series, begun.date, {S.r('begun.e', 'e')}, {S.r('exp(walk.ln)', 'forecast')} FROM walk JOIN begun ON begun.t = walk.t WHERE walk.k = walk.t - 1", recursive=True))
def variance_forecast_exact(spark, d):
    df = _series(spark, d)
    return rounded(df.groupBy("series").applyInPandas(egarch.exact_forecasts(PRM, 100), "series string, date date, e double, forecast double"))


_CONST = math.lgamma((PRM.nu + 1) / 2) - math.lgamma(PRM.nu / 2) - 0.5 * math.log(math.pi * (PRM.nu - 2))


@query(_path_sql(PRM, f"SELECT count(*) AS n, {S.r(f'sum({_CONST!r} - 0.5 * path.ln - 0.5 * ({PRM.nu!r} + 1) * ln(1 + res.e * res.e / (exp(path.ln) * ({PRM.nu!r} - 2))))', 'loglik')} FROM path JOIN res ON res.k = path.k"))
def egarch_loglik(spark, d):
    return rounded(egarch.student_loglik(egarch.filtered(_series(spark, d), PRM), PRM.nu).drop("series"))


_TICKER_PATH = f"""rets AS (SELECT ticker, date, ln(close / lag(close) OVER w) AS e, row_number() OVER w - 2 AS k FROM prio WINDOW w AS ({_LAG})),
res AS (SELECT * FROM rets WHERE k >= 0),
start AS (SELECT ticker, ln(greatest(var_pop(e), 1e-10)) AS ln FROM res GROUP BY ticker),
walk AS (
  SELECT res.ticker, res.k, res.date, start.ln, res.e / exp(start.ln / 2) AS z FROM res JOIN start ON res.ticker = start.ticker WHERE res.k = 0
  UNION ALL
  SELECT n.ticker, n.k, n.date, n.ln, n.e / exp(n.ln / 2) FROM (
    SELECT res.ticker, res.k, res.date, res.e, {PRM.omega!r} + {PRM.beta[0]!r} * s.ln + {PRM.alpha[0]!r} * (abs(s.z) - {PRM.kappa!r}) + {PRM.gamma[0]!r} * s.z AS ln
    FROM walk s JOIN res ON res.ticker = s.ticker AND res.k = s.k + 1) n)"""


@query(S.with_(S.PRIO, _TICKER_PATH, f"SELECT ticker AS series, date, {S.r('ln', 'log_sigma2')}, {S.r('z')} FROM walk", recursive=True))
def egarch_by_ticker(spark, d):
    df = features.log_returns(panels.panel_prio(spark, d)).select(F.col("ticker").alias("series"), "date", F.col("log_return").alias("e"))
    return rounded(egarch.filtered(df, PRM).select("series", "date", F.log("sigma2").alias("log_sigma2"), "z"))


def _prio_residuals(spark, d) -> DataFrame:
    return features.log_returns(panels.panel_prio(spark, d)).select(F.col("ticker").alias("series"), "date", F.col("log_return").alias("e"))


@query()
def egarch_mle(spark, d):
    return egarch.best_fit(egarch.fit_rows(_prio_residuals(spark, d))).select("series", "dist", "o", "p", "n", "converged", F.round("loglik", 2).alias("loglik"))


@query()
def egarch_cv(spark, d):
    trials = [{"o": 1, "p": 1, "dist": "student", "refit": 63}, {"o": 1, "p": 1, "dist": "student", "refit": 63, "window": "rolling", "size": 500}]
    return egarch.validation_grid(_series(spark, d), trials, steps=80).groupBy("trial").agg(F.count(F.lit(1)).alias("folds"), F.round(F.avg("score"), 4).alias("score"))


# Evaluation

_FC = "fc AS (SELECT res.date, res.e, exp(path.ln) AS sigma2 FROM path JOIN res ON res.k = path.k WHERE res.k > 0)"


def _eval_sql(*tail: str) -> str:
    return S.with_(S.INDEX, S.RESIDUALS, S.egarch_path(PRM.omega, PRM.alpha, PRM.gamma, PRM.beta, PRM.kappa), _FC, *tail, recursive=True)


@query(_eval_sql(f"SELECT count(*) AS n, {S.r('avg(ln(sigma2) + e * e / sigma2)', 'qlike')} FROM fc"))
def qlike(spark, d):
    return rounded(evaluate.variance_losses(_forecasts(spark, d)).select("n", "qlike"))


@query(_eval_sql(f"SELECT count(*) AS n, {S.r('avg(ln(sigma2) + e * e / sigma2)', 'qlike')}, {S.r('avg((e * e - sigma2) * (e * e - sigma2))', 'mse')}, {S.r('avg(abs(e * e - sigma2))', 'mae')}, {S.r('greatest(0.0, power(corr(e * e, sigma2), 2))', 'r2')} FROM fc"))
def variance_losses(spark, d):
    return rounded(evaluate.variance_losses(_forecasts(spark, d)))


_MZ = "mz AS (SELECT regr_intercept(e * e, sigma2) AS a, regr_slope(e * e, sigma2) AS b, regr_r2(e * e, sigma2) AS r2, regr_count(e * e, sigma2) AS n, regr_sxx(e * e, sigma2) AS sxx, regr_syy(e * e, sigma2) AS syy, avg(sigma2) AS mx FROM fc)"


@query(_eval_sql(_MZ, f"SELECT CAST(n AS BIGINT) AS n, {S.r('a', 'intercept')}, {S.r('b', 'slope')}, {S.r('r2')}, {S.r('a / sqrt(syy * (1 - r2) / (n - 2) * (1.0 / n + mx * mx / sxx))', 't_intercept')}, {S.r('b / sqrt(syy * (1 - r2) / (n - 2) / sxx)', 't_slope')} FROM mz"))
def mincer_zarnowitz(spark, d):
    return rounded(evaluate.mincer_zarnowitz(_forecasts(spark, d)))


_MZ_T = "mt AS (SELECT *, a / sqrt(syy * (1 - r2) / (n - 2) * (1.0 / n + mx * mx / sxx)) AS ta, b / sqrt(syy * (1 - r2) / (n - 2) / sxx) AS tb FROM mz)"


@query(_eval_sql(_MZ, _MZ_T, f"SELECT CAST(n AS BIGINT) AS n, {S.r('a', 'intercept')}, {S.r('b', 'slope')}, {S.r('r2')}, {S.r('ta', 't_intercept')}, {S.r('tb', 't_slope')}, {S.r('1 - 2 * ' + S.t_half('abs(ta)', '(CAST(n AS DOUBLE) - 2)'), 'p_intercept')}, {S.r('1 - 2 * ' + S.t_half('abs(tb)', '(CAST(n AS DOUBLE) - 2)'), 'p_slope')} FROM mt"))
def mincer_zarnowitz_p_values(spark, d):
    return rounded(evaluate.mincer_zarnowitz_p(evaluate.mincer_zarnowitz(_forecasts(spark, d))))


@query(_eval_sql(_MZ, f"SELECT date, {S.r('greatest(1e-12, mz.b * sigma2)', 'sigma2')} FROM fc, mz"))
def mz_calibrated(spark, d):
    rows = _forecasts(spark, d).filter("sigma2 is not null")
    fit = evaluate.mincer_zarnowitz(rows).select("intercept", "slope")
    return rounded(rows.join(F.broadcast(fit)).select("date", evaluate.calibrated(F.col("sigma2"), F.col("intercept"), F.col("slope")).alias("sigma2")))


_Q = {a: special.quantile("student", a, PRM.nu) for a in (0.01, 0.05)}
_HITS = "hits AS (SELECT a.alpha, date, a.q * sqrt(sigma2) AS var, CAST(e < a.q * sqrt(sigma2) AS INT) AS hit FROM fc, (VALUES " + ", ".join(f"(CAST({a} AS DOUBLE), CAST({q!r} AS DOUBLE))" for a, q in _Q.items()) + ") a(alpha, q))"
_KUPIEC = """sums AS (SELECT alpha, count(*) AS n, CAST(sum(hit) AS BIGINT) AS x, sum(hit) / count(*) AS rate FROM hits GROUP BY alpha),
kup AS (SELECT *, -2 * (((n - x) * ln(1 - alpha) + x * ln(alpha)) - ((n - x) * ln(1 - p) + x * ln(p))) AS lr_uc FROM (SELECT *, greatest(1e-12, least(1 - 1e-12, rate)) AS p FROM sums))"""
_CHRIST = """trans AS (SELECT alpha, hit, lag(hit) OVER (PARTITION BY alpha ORDER BY date) AS b FROM hits),
cells AS (SELECT alpha, count(*) FILTER (b = 0 AND hit = 0) AS n00, count(*) FILTER (b = 0 AND hit = 1) AS n01, count(*) FILTER (b = 1 AND hit = 0) AS n10, count(*) FILTER (b = 1 AND hit = 1) AS n11 FROM trans WHERE b IS NOT NULL GROUP BY alpha),
probs AS (SELECT *, greatest(1e-12, least(1 - 1e-12, n01 / greatest(1, n00 + n01))) AS p01, greatest(1e-12, least(1 - 1e-12, n11 / greatest(1, n10 + n11))) AS p11, greatest(1e-12, least(1 - 1e-12, (n01 + n11) / greatest(1, n00 + n01 + n10 + n11))) AS p FROM cells),
chr AS (SELECT *, -2 * ((n00 + n10) * ln(1 - p) + (n01 + n11) * ln(p) - (n00 * ln(1 - p01) + n01 * ln(p01) + n10 * ln(1 - p11) + n11 * ln(p11))) AS lr_ind FROM probs)"""


def _hits(spark, d):
    return evaluate.value_at_risk(_forecasts(spark, d), nu=PRM.nu)


@query(_eval_sql(_HITS, f"SELECT date, alpha, {S.r('var', 'value_at_risk')}, hit FROM hits"))
def var_series(spark, d):
    return rounded(_hits(spark, d).select("date", "alpha", "value_at_risk", "hit"))


@query(_eval_sql(_HITS, _KUPIEC, f"SELECT alpha, n, x, {S.r('rate', 'hit_rate')}, {S.r('lr_uc')} FROM kup"))
def kupiec(spark, d):
    return rounded(evaluate.kupiec(_hits(spark, d)))


@query(_eval_sql(_HITS, _CHRIST, f"SELECT alpha, n00, n01, n10, n11, {S.r('lr_ind')} FROM chr"))
def christoffersen(spark, d):
    return rounded(evaluate.christoffersen(_hits(spark, d)))


@query(_eval_sql(_HITS, _KUPIEC, _CHRIST, f"SELECT kup.alpha, n, x, {S.r('rate', 'hit_rate')}, {S.r('lr_uc')}, n00, n01, n10, n11, {S.r('lr_ind')}, {S.r('lr_uc + lr_ind', 'lr_cc')} FROM kup JOIN chr ON kup.alpha = chr.alpha"))
def var_backtest(spark, d):
    return rounded(evaluate.var_backtest(_forecasts(spark, d), nu=PRM.nu))


@query(_eval_sql(_HITS, _KUPIEC, _CHRIST, f"SELECT kup.alpha, n, x, {S.r('rate', 'hit_rate')}, {S.r('lr_uc')}, n00, n01, n10, n11, {S.r('lr_ind')}, {S.r('lr_uc + lr_ind', 'lr_cc')}, {S.r(S.chi2_sf_1('lr_uc'), 'p_uc')}, {S.r(S.chi2_sf_1('lr_ind'), 'p_ind')}, {S.r('exp(-greatest(lr_uc + lr_ind, 0.0) / 2)', 'p_cc')} FROM kup JOIN chr ON kup.alpha = chr.alpha"))
def var_backtest_p_values(spark, d):
    return rounded(evaluate.with_p_values(evaluate.var_backtest(_forecasts(spark, d), nu=PRM.nu)))


_NAIVE = f"nv AS (SELECT ticker, date, lead(log_volatility) OVER ({_LAG}) AS y, lag(log_volatility) OVER ({_LAG}) AS p FROM vols)"


def _naive(spark, d):
    df = features.with_next_target(features.with_lags(_volatility(spark, d), ["log_volatility"], (1, 2, 3)))
    return evaluate.naive_forecast(df)


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, _NAIVE, f"SELECT count(*) AS n, {S.r('avg(abs(y - p))', 'mae')}, {S.r('avg((y - p) * (y - p))', 'mse')}, {S.r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {S.r('1 - avg((y - p) * (y - p)) / var_pop(y)', 'r2')} FROM nv WHERE y IS NOT NULL AND p IS NOT NULL"))
def naive_baseline(spark, d):
    return rounded(evaluate.regression_metrics(_naive(spark, d), "log_volatility", "pred"))


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, _NAIVE, f"SELECT ticker, count(*) AS n, {S.r('avg(abs(y - p))', 'mae')}, {S.r('avg((y - p) * (y - p))', 'mse')}, {S.r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {S.r('1 - avg((y - p) * (y - p)) / nullif(var_pop(y), 0)', 'r2')} FROM nv WHERE y IS NOT NULL AND p IS NOT NULL GROUP BY ticker"))
def regression_metrics(spark, d):
    return rounded(evaluate.regression_metrics(_naive(spark, d), "log_volatility", "pred", ("ticker",)))


_DM = f"""es AS (SELECT ticker, date, y - p AS e1, y - p2 AS e2 FROM (SELECT ticker, date, lead(log_volatility) OVER ({_LAG}) AS y, lag(log_volatility) OVER ({_LAG}) AS p, lag(log_volatility, 2) OVER ({_LAG}) AS p2 FROM vols) WHERE y IS NOT NULL AND p IS NOT NULL AND p2 IS NOT NULL),
ds AS (SELECT e1 * e1 - e2 * e2 AS dd FROM es)"""


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, _DM, f"SELECT count(*) AS n, {S.r('avg(dd)', 'mean_d')}, {S.r('var_samp(dd)', 'variance')}, {S.r('avg(dd) / sqrt(var_samp(dd) / count(*))', 'dm')} FROM ds"))
def diebold_mariano(spark, d):
    df = _naive(spark, d).filter("log_volatility_lag_1 is not null and log_volatility_lag_2 is not null")
    df = df.withColumn("e1", F.col("log_volatility") - F.col("log_volatility_lag_1")).withColumn("e2", F.col("log_volatility") - F.col("log_volatility_lag_2"))
    return rounded(evaluate.diebold_mariano(df, "e1", "e2"))


_LAGGED = f"bv AS (SELECT * FROM (SELECT {S.text_key('ticker', 'date')} AS key, lead(log_volatility) OVER ({_LAG}) AS y, lag(log_volatility) OVER ({_LAG}) AS a, lag(log_volatility, 2) OVER ({_LAG}) AS b FROM vols) WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL)"
_RESAMPLED = """bs AS (SELECT rep, sum(w) AS n, sum(w * y) AS s, sum(w * y * y) AS ss, sum(w * (y - a) * (y - a)) AS e1, sum(w * (y - b) * (y - b)) AS e2 FROM weighted GROUP BY rep),
bd AS (SELECT (e2 - e1) / (ss - s * s / n) AS difference FROM bs),
bm AS (SELECT avg(difference) AS mean, quantile_cont(difference, 0.025) AS low, quantile_cont(difference, 0.975) AS high, avg(CAST(difference <= 0 AS INT)) AS share FROM bd)"""


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, _LAGGED, S.poisson_weights("weighted", "bv", 1000, 42), _RESAMPLED, f"SELECT {S.r('mean')}, {S.r('low')}, {S.r('high')}, {S.r('2 * least(share, 1 - share)', 'p_value')} FROM bm"))
def bootstrap_r2(spark, d):
    df = _naive(spark, d).select("ticker", "date", "log_volatility", "log_volatility_lag_1", "log_volatility_lag_2")
    return rounded(evaluate.bootstrap_summary(evaluate.bootstrap_r2(df, "log_volatility", "log_volatility_lag_1", "log_volatility_lag_2", reps=1000, keys=("ticker", "date"))))


_DRAWN = f"""lv AS (SELECT ticker, date, {S.r('log_volatility', 'y')} FROM vols WHERE log_volatility IS NOT NULL),
dr AS (SELECT y, avg(y) OVER () AS m, stddev_pop(y) OVER () AS s, ({S.text_key('ticker', 'date', '42', '1')} + 0.5) / {1 << 60}.0 AS u1, ({S.text_key('ticker', 'date', '42', '2')} + 0.5) / {1 << 60}.0 AS u2 FROM lv),
nv AS (SELECT y, sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * s + m AS p FROM dr)"""


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, _DRAWN, f"SELECT count(*) AS n, {S.r('avg(abs(y - p))', 'mae')}, {S.r('avg((y - p) * (y - p))', 'mse')}, {S.r('sqrt(avg((y - p) * (y - p)))', 'rmse')}, {S.r('1 - avg((y - p) * (y - p)) / var_pop(y)', 'r2')} FROM nv"))
def random_baseline(spark, d):
    rows = rounded(_volatility(spark, d).filter("log_volatility is not null").select("ticker", "date", "log_volatility"))
    return rounded(evaluate.regression_metrics(evaluate.random_forecast(rows, keys=("ticker", "date")), "log_volatility", "pred"))


# Diagnostics of the residual series

_CENTRED = "c AS (SELECT date, {0} - avg({0}) OVER () AS x FROM res), s AS (SELECT count(*) AS n, sum(x * x) AS s0 FROM c), i AS (SELECT x, row_number() OVER (ORDER BY date) AS i FROM c), l AS (SELECT b.i - a.i AS lag, sum(a.x * b.x) AS sk FROM i a JOIN i b ON b.i > a.i AND b.i <= a.i + 20 GROUP BY 1)"


@query(S.with_(S.INDEX, S.RESIDUALS, _CENTRED.format("e"), f"SELECT CAST(lag AS INT) AS lag, {S.r('sk / s0', 'r')} FROM l, s"))
def acf20(spark, d):
    return rounded(diagnostics.autocorrelations(_residuals(spark, d), "e").select("lag", "r"))


@query(S.with_(S.INDEX, S.RESIDUALS, _CENTRED.format("(e * e)"), f"SELECT CAST(lag AS INT) AS lag, {S.r('sk / s0', 'r')} FROM l, s"))
def acf_squared20(spark, d):
    return rounded(diagnostics.autocorrelations(_residuals(spark, d), "e", square=True).select("lag", "r"))


@query(S.with_(S.INDEX, S.RESIDUALS, _CENTRED.format("e"), f"SELECT CAST(lag AS INT) AS lag, {S.r('n * (n + 2) * sum((sk / s0) * (sk / s0) / (n - lag)) OVER (ORDER BY lag)', 'q')} FROM l, s"))
def ljung_box(spark, d):
    return rounded(diagnostics.ljung_box(_residuals(spark, d), "e"))


@query(S.with_(S.INDEX, S.RESIDUALS, _CENTRED.format("(e * e)"), f"SELECT CAST(lag AS INT) AS lag, {S.r('n * (n + 2) * sum((sk / s0) * (sk / s0) / (n - lag)) OVER (ORDER BY lag)', 'q')} FROM l, s"))
def mcleod_li(spark, d):
    return rounded(diagnostics.ljung_box(_residuals(spark, d), "e", square=True))


_PACF = """rs AS (SELECT list(sk / s0 ORDER BY lag) AS r FROM l, s),
walk AS (
  SELECT 1 AS k, r, r[1] AS a, [r[1]] AS phi, 1 - r[1] * r[1] AS den FROM rs
  UNION ALL
  SELECT k + 1, r, a, list_concat([phi[j] - a * phi[k + 1 - j] for j in range(1, k + 1)], [a]), den * (1 - a * a)
  FROM (SELECT k, r, phi, den, (r[k + 1] - list_sum([phi[j] * r[k + 1 - j] for j in range(1, k + 1)])) / den AS a FROM walk WHERE k < 20))"""


@query(S.with_(S.INDEX, S.RESIDUALS, _CENTRED.format("e"), _PACF, f"SELECT CAST(k AS INT) AS lag, {S.r('greatest(-1.0, least(1.0, a))', 'r')} FROM walk", recursive=True))
def pacf20(spark, d):
    r = [x["r"] for x in diagnostics.autocorrelations(_residuals(spark, d), "e").orderBy("lag").collect()]
    return rounded(spark.createDataFrame(list(enumerate(diagnostics.partial_autocorrelations(r), 1)), "lag int, r double"))


def _report(spark, rows: dict[str, dict]) -> DataFrame:
    return rounded(spark.createDataFrame([(k, float(v.get("lm", v.get("f"))), float(v["p_value"])) for k, v in rows.items()], "test string, statistic double, p_value double"))


@query(S.with_(S.INDEX, S.RESIDUALS, "q AS (SELECT e * e AS y, lag(e * e) OVER (ORDER BY date) AS x FROM res)", f"SELECT count(x) AS n, {S.r('count(x) * regr_r2(y, x)', 'lm')} FROM q"))
def arch_lm_1(spark, d):
    df = _residuals(spark, d)
    got = diagnostics.arch_lm(df, "e", 1)
    return rounded(df.agg((F.count(F.lit(1)) - 1).alias("n")).withColumn("lm", F.lit(float(got["lm"]))))


_TREND = """bt AS (SELECT e * e AS y, row_number() OVER (ORDER BY date) - 1 AS t FROM res),
bx AS (SELECT y, (t - avg(t) OVER ()) / stddev_pop(t) OVER () AS x1 FROM bt),
bc AS (SELECT count(*) AS n, corr(y, x1) AS a, corr(y, x1 * x1) AS b, corr(x1, x1 * x1) AS c FROM bx),
bp AS (SELECT n * (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS lm FROM bc)"""


@query(S.with_(S.INDEX, S.RESIDUALS, _TREND, f"SELECT 'breusch_pagan' AS test, {S.r('lm', 'statistic')}, {S.r('exp(-lm / 2)', 'p_value')} FROM bp"))
def breusch_pagan(spark, d):
    return _report(spark, {"breusch_pagan": diagnostics.trend_lm(_residuals(spark, d), "e", 2)})


_SIGN = """sb AS (SELECT e * e AS y, lag(e) OVER (ORDER BY date) AS b FROM res),
sx AS (SELECT y, CAST(b < 0 AS DOUBLE) AS negative, CASE WHEN b < 0 THEN b ELSE 0.0 END AS negative_size, CASE WHEN b < 0 THEN 0.0 ELSE b END AS positive_size FROM sb WHERE b IS NOT NULL)"""


_LM = (
    "lw AS (SELECT e * e AS y, " + ", ".join(f"lag(e * e, {k}) OVER (ORDER BY date) AS l{k}" for k in range(1, 13)) + " FROM res)",
    "lc AS (SELECT * FROM lw WHERE l12 IS NOT NULL)",
    S.unexplained("al", "lc", "y", [f"l{k}" for k in range(1, 13)]),
    _TREND,
    "wx AS (SELECT y, x1, power(x1, 2) AS x2, power(x1, 3) AS x3, power(x1, 4) AS x4 FROM bx)",
    S.unexplained("wh", "wx", "y", ["x1", "x2", "x3", "x4"]),
    _SIGN,
    S.unexplained("js", "sx", "y", ["negative", "negative_size", "positive_size"]),
    "jf AS (SELECT ((1 - rest) / 3) / (rest / (n - 4)) AS f, CAST(n - 4 AS DOUBLE) AS d2 FROM js)",
)


@query(
    S.with_(
        S.INDEX,
        S.RESIDUALS,
        *_LM,
        f"SELECT 'arch_lm' AS test, {S.r('n * (1 - rest)', 'statistic')}, {S.r(S.chi2_sf_even('n * (1 - rest)', 12), 'p_value')} FROM al"
        f" UNION ALL SELECT 'breusch_pagan', {S.r('lm')}, {S.r('exp(-lm / 2)', 'p')} FROM bp"
        f" UNION ALL SELECT 'white', {S.r('n * (1 - rest)', 'lm')}, {S.r(S.chi2_sf_even('n * (1 - rest)', 4), 'p')} FROM wh"
        f" UNION ALL SELECT 'joint_sign_bias', {S.r('f')}, {S.r(S.f_sf('f', 3, 'd2'), 'p')} FROM jf",
        recursive=True,
    )
)
def heteroskedasticity(spark, d):
    df = _residuals(spark, d)
    return _report(spark, {"arch_lm": diagnostics.arch_lm(df, "e"), "breusch_pagan": diagnostics.trend_lm(df, "e", 2), "white": diagnostics.trend_lm(df, "e", 4), "joint_sign_bias": diagnostics.joint_sign_bias(df, "e")})


def _slope_sql(c: str) -> str:
    return f"SELECT '{c}' AS test, {S.r(f'regr_slope(y, {c})', 'slope')}, {S.r(f'regr_slope(y, {c}) / sqrt(regr_syy(y, {c}) * (1 - regr_r2(y, {c})) / (count(*) - 2) / regr_sxx(y, {c}))', 't')}, count(*) AS n FROM sx"


@query(S.with_(S.INDEX, S.RESIDUALS, _SIGN, " UNION ALL ".join(_slope_sql(c) for c in ("negative", "negative_size", "positive_size"))))
def sign_size_bias(spark, d):
    return rounded(diagnostics.sign_bias(_residuals(spark, d), "e"))


@query(S.with_(S.INDEX, S.RESIDUALS, "q AS (SELECT date, e * e AS q, e * e - avg(e * e) OVER () AS c FROM res), s AS (SELECT q, sum(c) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM q)", f"SELECT {S.r('sum(s * s) / (count(*) * count(*) * var_samp(q))', 'nyblom')}, count(*) AS n FROM s"))
def nyblom(spark, d):
    return rounded(diagnostics.nyblom(_residuals(spark, d), "e"))


_MOM = "m AS (SELECT avg(e) AS mu FROM res), c AS (SELECT e, e - mu AS x FROM res, m), mm AS (SELECT count(*) AS n, avg(e) AS mean, avg(x * x) AS v, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4, count(*) FILTER (abs(e) > 2) AS beyond_2, count(*) FILTER (abs(e) > 3) AS beyond_3 FROM c)"


@query(S.with_(S.INDEX, S.RESIDUALS, _MOM, f"SELECT n, {S.r('mean')}, {S.r('v', 'variance')}, {S.r('sqrt(v)', 'std')}, {S.r('m3 / power(v, 1.5)', 'skewness')}, {S.r('m4 / (v * v)', 'kurtosis')}, beyond_2, beyond_3 FROM mm"))
def moments(spark, d):
    return rounded(diagnostics.moments(_residuals(spark, d), "e"))


@query(S.with_(S.INDEX, S.RESIDUALS, _MOM, f"SELECT n, {S.r('m3 / power(v, 1.5)', 'skewness')}, {S.r('m4 / (v * v)', 'kurtosis')}, {S.r('n / 6.0 * (m3 * m3 / (v * v * v) + power(m4 / (v * v) - 3, 2) / 4)', 'jb')} FROM mm"))
def jarque_bera(spark, d):
    return rounded(diagnostics.jarque_bera(_residuals(spark, d), "e"))


@query(S.with_(S.INDEX, S.RESIDUALS, f"SELECT row_number() OVER (ORDER BY e) AS position, {S.r('e')}, {S.r('(row_number() OVER (ORDER BY e) - 0.5) / count(*) OVER ()', 'probability')} FROM res"))
def qq_positions(spark, d):
    return rounded(diagnostics.ranked_quantiles(_residuals(spark, d), "e"))


_QQ = f"""zs AS (SELECT res.e / exp(path.ln / 2) AS z FROM path JOIN res ON res.k = path.k),
pr AS (SELECT row_number() OVER (ORDER BY z) AS position, z, (row_number() OVER (ORDER BY z) - 0.5) / count(*) OVER () AS probability FROM zs),
newton AS (
  SELECT position, z, probability, CAST(0 AS DOUBLE) AS x, 0 AS step FROM pr
  UNION ALL
  SELECT position, z, probability, x + (abs(probability - 0.5) - {S.t_half("x", repr(PRM.nu))}) / (exp(lgamma({(PRM.nu + 1) / 2}) - lgamma({PRM.nu / 2})) / sqrt({PRM.nu!r} * pi()) * power(1 + x * x / {PRM.nu!r}, -{(PRM.nu + 1) / 2})), step + 1
  FROM newton WHERE step < 30)"""


@query(S.with_(S.INDEX, S.RESIDUALS, S.egarch_path(PRM.omega, PRM.alpha, PRM.gamma, PRM.beta, PRM.kappa), _QQ, f"SELECT position, {S.r('z')}, {S.r('probability')}, {S.r('sign(probability - 0.5) * x', 'theoretical')} FROM newton WHERE step = 30", recursive=True))
def qq_student(spark, d):
    z = egarch.filtered(_series(spark, d), PRM)
    return rounded(diagnostics.qq_table(z, "z", lambda p: special.t_ppf_array(p, PRM.nu)))


_KS = f"""zs AS (SELECT res.e / exp(path.ln / 2) AS z FROM path JOIN res ON res.k = path.k),
fs AS (SELECT row_number() OVER (ORDER BY z) AS i, count(*) OVER () AS n, 0.5 + sign(z) * {S.t_half("abs(z)", repr(PRM.nu))} AS f FROM zs),
ks AS (SELECT max(greatest(abs(i / n - f), abs((i - 1) / n - f))) AS distance, count(*) AS n FROM fs),
ts AS (SELECT *, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * distance AS t FROM ks)"""


@query(S.with_(S.INDEX, S.RESIDUALS, S.egarch_path(PRM.omega, PRM.alpha, PRM.gamma, PRM.beta, PRM.kappa), _KS, f"SELECT {S.r('distance')}, n, {S.r('greatest(0.0, least(1.0, 2 * list_sum([power(-1, k - 1) * exp(-2 * k * k * t * t) for k in range(1, 101)])))', 'p_value')} FROM ts", recursive=True))
def kolmogorov_smirnov(spark, d):
    z = egarch.filtered(_series(spark, d), PRM)
    got = diagnostics.kolmogorov_smirnov(z, "z", lambda x: special.t_cdf_array(x, PRM.nu))
    return rounded(spark.createDataFrame([(got["distance"], got["n"], got["p_value"])], "distance double, n long, p_value double"))


_KPSS = """kr AS (SELECT ticker, date, ln(close / lag(close) OVER w) AS v FROM prio WINDOW w AS (PARTITION BY ticker ORDER BY date)),
ke AS (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i, v - avg(v) OVER (PARTITION BY ticker) AS e, count(*) OVER (PARTITION BY ticker) AS n FROM kr WHERE v IS NOT NULL),
kn AS (SELECT DISTINCT ticker, n, CAST(least(ceil(12 * power(n / 100.0, 0.25)), n - 1) AS INT) AS q FROM ke),
kg AS (SELECT a.ticker, b.i - a.i AS k, sum(a.e * b.e) / any_value(kn.n) AS g FROM ke a JOIN kn ON kn.ticker = a.ticker JOIN ke b ON b.ticker = a.ticker AND b.i >= a.i AND b.i <= a.i + kn.q GROUP BY 1, 2),
kl AS (SELECT kg.ticker, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (q + 1.0)) * g END) AS s2 FROM kg JOIN kn ON kn.ticker = kg.ticker GROUP BY 1),
kc AS (SELECT ticker, n, sum(e) OVER (PARTITION BY ticker ORDER BY i) AS s FROM ke),
kp AS (SELECT kc.ticker AS series, CAST(any_value(n) AS INT) AS n, sum(s * s) / (any_value(n) * any_value(n) * any_value(s2)) AS kpss FROM kc JOIN kl ON kl.ticker = kc.ticker GROUP BY 1)"""
_KPSS_P = "CASE WHEN kpss <= 0.347 THEN 0.1 WHEN kpss <= 0.463 THEN 0.1 - 0.05 * (kpss - 0.347) / (0.463 - 0.347) WHEN kpss <= 0.574 THEN 0.05 - 0.025 * (kpss - 0.463) / (0.574 - 0.463) WHEN kpss <= 0.739 THEN 0.025 - 0.015 * (kpss - 0.574) / (0.739 - 0.574) ELSE 0.01 END"


@query(S.with_(S.PRIO, _KPSS, f"SELECT series, n, {S.r('kpss')}, {S.r(_KPSS_P, 'kpss_p')} FROM kp"))
def kpss_by_ticker(spark, d):
    rows = _prio_residuals(spark, d).withColumnRenamed("e", "value")
    return rounded(diagnostics.stationarity(rows).select("series", "n", "kpss", "kpss_p"))


# Regressions by Schur complements of centred sums: rd are the rows of the differences (j, target y, level v), rl those with their lags.
_ADF = f"""rv AS (SELECT ticker, v, row_number() OVER w - 1 AS j, lead(v) OVER w - v AS y, count(*) OVER (PARTITION BY ticker) AS n FROM kr WHERE v IS NOT NULL WINDOW w AS (PARTITION BY ticker ORDER BY date)),
rd AS (SELECT *, CAST(least(ceil(12 * power(n / 100.0, 0.25)), n // 2 - 2) AS INT) AS top FROM rv WHERE y IS NOT NULL),
rl AS (SELECT a.ticker, a.j, a.j - b.j AS c, b.y AS x FROM rd a JOIN rd b ON b.ticker = a.ticker AND b.j < a.j AND b.j >= a.j - a.top
  UNION ALL SELECT ticker, j, 900, v FROM rd UNION ALL SELECT ticker, j, 1000, y FROM rd),
wide AS (SELECT r.ticker, r.j, CASE WHEN r.c = 900 THEN 0 ELSE r.c END AS c, r.x FROM rl r JOIN rd ON rd.ticker = r.ticker AND rd.j = r.j WHERE r.j >= rd.top),
ws AS (SELECT a.ticker, a.c AS a, b.c AS b, covar_pop(a.x, b.x) AS s FROM wide a JOIN wide b ON b.ticker = a.ticker AND b.j = a.j GROUP BY 1, 2, 3),
wm AS ({S.matrix('ws', 'ticker')}),
{S.eliminated('we', 'wm')},
wr AS (SELECT ticker, gone - 1 AS lags, m[len(m)][len(m)] AS v FROM we WHERE gone > 0 UNION ALL SELECT ticker, gone, m[2][2] - m[1][2] * m[1][2] / m[1][1] FROM we WHERE len(m) = 2),
best AS (SELECT wr.ticker, CAST(arg_min(lags, (d.n - 1 - d.top) * ln(v) + 2 * (lags + 2)) AS INT) AS lags, any_value(d.n) AS n FROM wr JOIN (SELECT DISTINCT ticker, n, top FROM rd) d ON d.ticker = wr.ticker GROUP BY 1),
narrow AS (SELECT r.* FROM rl r JOIN best ON best.ticker = r.ticker WHERE r.j >= lags AND (r.c <= lags OR r.c >= 900)),
ns AS (SELECT a.ticker, a.c AS a, b.c AS b, covar_pop(a.x, b.x) AS s FROM narrow a JOIN narrow b ON b.ticker = a.ticker AND b.j = a.j GROUP BY 1, 2, 3),
nm AS ({S.matrix('ns', 'ticker')}),
{S.eliminated('ne', 'nm')},
adf AS (SELECT best.ticker, lags, m[1][2] / m[1][1] / sqrt((m[2][2] - m[1][2] * m[1][2] / m[1][1]) / (best.n - 1 - lags - lags - 2) / m[1][1]) AS adf FROM ne JOIN best ON best.ticker = ne.ticker WHERE len(m) = 2),
ap AS (SELECT *, CASE WHEN adf <= -1.61 THEN 2.1659 + 1.4412 * adf + 0.038269 * adf * adf ELSE 1.7339 + 0.93202 * adf - 0.12745 * adf * adf - 0.010368 * power(adf, 3) END AS u FROM adf)"""

#: Of each break, the sums of the step from it on with the trend (1), the lag (2), the level (3) and the target (4).
_ZA = f"""zd AS (SELECT ticker, j, n, CAST(j AS DOUBLE) AS x1, lag(y) OVER (PARTITION BY ticker ORDER BY j) AS x2, v AS x3, y AS x4 FROM rd),
zx AS (SELECT ticker, j, n, unnest([1, 2, 3, 4]) AS c, unnest([x1, x2, x3, x4]) AS x FROM zd WHERE x2 IS NOT NULL),
zc AS (SELECT *, x - avg(x) OVER (PARTITION BY ticker, c) AS e FROM zx),
zb AS (SELECT a.ticker, a.c AS a, b.c AS b, sum(a.e * b.e) AS s FROM zc a JOIN zc b ON b.ticker = a.ticker AND b.j = a.j GROUP BY 1, 2, 3),
zt AS (SELECT ticker, j AS k, c, n, sum(e) OVER (PARTITION BY ticker, c ORDER BY j DESC ROWS UNBOUNDED PRECEDING) AS s, CAST(n - 1 - j AS DOUBLE) AS above FROM zc),
zk AS (SELECT * FROM zt WHERE k >= floor(0.15 * n) AND k < floor((1 - 0.15) * n)),
zs AS (SELECT zk.ticker, zk.k, zb.a, zb.b, zb.s FROM zb JOIN zk ON zk.ticker = zb.ticker AND zk.c = 1
  UNION ALL SELECT ticker, k, 0, c, s FROM zk UNION ALL SELECT ticker, k, c, 0, s FROM zk
  UNION ALL SELECT ticker, k, 0, 0, above - above * above / (n - 2) FROM zk WHERE c = 1),
zm AS ({S.matrix('zs', 'ticker, k')}),
{S.eliminated('ze', 'zm')},
za AS (SELECT ze.ticker, k, m[1][2] / m[1][1] / sqrt((m[2][2] - m[1][2] * m[1][2] / m[1][1]) / (best.n - 2 - 5) / m[1][1]) AS t FROM ze JOIN best ON best.ticker = ze.ticker WHERE len(m) = 2),
zz AS (SELECT ticker, min(t) AS zivot_andrews, CAST(arg_min(k, t) AS INT) AS break_at FROM za GROUP BY 1),
us AS (SELECT kp.series, kp.n, adf, lags AS adf_lags, CASE WHEN adf >= 2.74 THEN 1.0 WHEN adf <= -18.83 THEN 0.0 ELSE {S.normal_cdf("u")} END AS adf_p, kpss, {_KPSS_P} AS kpss_p, zivot_andrews, break_at
  FROM kp JOIN ap ON ap.ticker = kp.series JOIN zz ON zz.ticker = kp.series)"""


@query(S.with_(S.PRIO, _KPSS, _ADF, _ZA, f"SELECT series, n, {S.r('adf')}, adf_lags, {S.r('adf_p')}, {S.r('kpss')}, {S.r('kpss_p')}, {S.r('zivot_andrews')}, break_at, zivot_andrews < -4.93 AS break_rejects, adf_p < 0.05 AND kpss_p >= 0.05 AS stationary FROM us", recursive=True))
def adf_kpss_za(spark, d):
    df = features.log_returns(panels.panel_prio(spark, d)).select(F.col("ticker").alias("series"), "date", F.col("log_return").alias("value"))
    return rounded(diagnostics.stationarity(df))


_AD = f"""az AS (SELECT (e - avg(e) OVER ()) / stddev_samp(e) OVER () AS z FROM res),
af AS (SELECT row_number() OVER (ORDER BY z) AS i, count(*) OVER () AS n, greatest(1e-15, least(1 - 1e-15, 0.5 + sign(z) * {S.integral(lambda u: f"exp(-{u} * {u} / 2)", "abs(z)")} / sqrt(2 * pi()))) AS f FROM az),
ad AS (SELECT a.n, a.i, a.f, b.f AS g FROM af a JOIN af b ON b.i = a.n + 1 - a.i)"""


@query(S.with_(S.INDEX, S.RESIDUALS, _AD, f"SELECT 'index' AS series, CAST(any_value(n) AS INT) AS n, {S.r('-any_value(n) - sum((2 * i - 1) * (ln(f) + ln(1 - g))) / any_value(n)', 'anderson_darling')} FROM ad"))
def anderson_darling(spark, d):
    return rounded(diagnostics.normality(_series(spark, d).withColumnRenamed("e", "value")).select("series", "n", "anderson_darling"))


_SF = f"""sp AS (SELECT e, (row_number() OVER (ORDER BY e) - 0.375) / (count(*) OVER () + 0.25) AS p FROM res),
newton AS (
  SELECT e, p, CAST(0 AS DOUBLE) AS x, 0 AS step FROM sp
  UNION ALL
  SELECT e, p, x + (abs(p - 0.5) * sqrt(2 * pi()) - {S.integral(lambda u: f"exp(-{u} * {u} / 2)", "x")}) * exp(x * x / 2), step + 1 FROM newton WHERE step < 30),
sf AS (SELECT power(corr(e, sign(p - 0.5) * x), 2) AS w FROM newton WHERE step = 30)"""


@query(S.with_(S.INDEX, S.RESIDUALS, _AD, _SF, f"SELECT 'index' AS series, CAST(any_value(n) AS INT) AS n, {S.r('-any_value(n) - sum((2 * i - 1) * (ln(f) + ln(1 - g))) / any_value(n)', 'anderson_darling')}, (SELECT {S.r('w')} FROM sf) AS shapiro_francia FROM ad", recursive=True))
def normality(spark, d):
    return rounded(diagnostics.normality(_series(spark, d).withColumnRenamed("e", "value")))


# Learning tables


_READY: dict[tuple[str, str], DataFrame] = {}


def _learning(spark, d) -> DataFrame:
    """The wide table that all ablations project; its dates and tickers are found once an application and input."""
    key = spark.sparkContext.applicationId, d
    if key not in _READY:
        df = panels.panel(spark, d, for_windows=True).join(F.broadcast(_insight(spark, d)), "date", "left")  # a row a calendar day
        _READY[key] = datasets.prepare(df)
    return _READY[key]


_TECH = features.TECHNICAL
_LAGGED = (*_TECH, "log_volatility", "log_sigma_garch")
_PREP = f"""joined AS (SELECT f.*, sig.log_sigma_garch FROM feats f JOIN sig ON f.date = sig.date),
lagged AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in _LAGGED for k in (1, 2, 3))}, lead(log_volatility) OVER w AS target FROM joined WINDOW w AS ({_LAG})),
whole AS (SELECT * FROM lagged WHERE target IS NOT NULL AND log_volatility_lag_3 IS NOT NULL AND {" AND ".join(f"{c}_lag_3 IS NOT NULL AND {c}_lag_2 IS NOT NULL AND {c}_lag_1 IS NOT NULL AND {c} IS NOT NULL" for c in (*_TECH, "log_sigma_garch"))} AND log_volatility_lag_2 IS NOT NULL AND log_volatility_lag_1 IS NOT NULL),
ranked AS (SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS k FROM (SELECT DISTINCT date FROM whole)),
ready AS (SELECT w.*, CASE WHEN n <= floor(k * 0.8) THEN 'train' ELSE 'test' END AS split, CAST(dense_rank() OVER (ORDER BY ticker) - 1 AS INT) AS ticker_id FROM whole w JOIN ranked ON w.date = ranked.date)"""


def _own_columns(name: str) -> list[str]:
    lag = lambda cs: [f"{c}_lag_{k}" for c in cs for k in (1, 2, 3)]
    tech = [c for c in _TECH if c != "log_volume"]
    family = {"technical": [*tech, *lag(_TECH)], "target_lags": lag(["log_volatility"]), "calendar": list(features.CALENDAR), "insight": ["log_sigma_garch", *lag(["log_sigma_garch"])]}
    return [c for f in datasets.VARIANTS[name] for c in family[f]]


def _variant(name: str) -> None:
    columns = _own_columns(name)
    body = ", ".join(["date", "split", "ticker", "ticker_id", S.r("target", "log_volatility"), *(c if c in _INTS else S.r(c) for c in columns)])

    def run(spark, d):
        return rounded(datasets.variant(_learning(spark, d), name))

    run.__name__ = f"variant_{name}"
    query(S.with_(S.PANEL, S.INDEX, _SIG, _ALL, _PREP, f"SELECT {body} FROM ready"))(run)


for _name in datasets.VARIANTS:
    _variant(_name)


_SP = ("close", "volume", "high", "low", *_TECH, "log_volatility", *features.CALENDAR)


@query(
    S.with_(
        S.PANEL,
        _ALL,
        "rk AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _SP) + " FROM (SELECT " + ", ".join(S.r(c) for c in _SP) + " FROM feats WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _SP) + "))",
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {S.r(f'corr({a}, {b})', 'rho')} FROM rk" for i, a in enumerate(_SP) for b in _SP[i:]),
    )
)
def spearman_matrix(spark, d):
    """Over values rounded to six digits, so that both engines see the same ties."""
    df = features.with_volatility(features.with_all_features(panels.panel(spark, d)))
    return rounded(datasets.spearman(rounded(df), list(_SP)))


# Labels

_BARRIER = f"""tb AS (SELECT ticker, date, close, max(close) OVER f AS hi, min(close) OVER f AS lo, lead(close, 6) OVER w IS NOT NULL AS whole FROM panel
  WINDOW w AS ({_LAG}), f AS ({_LAG} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
lb AS (SELECT ticker, date, CAST(CASE WHEN hi >= close * 1.02 THEN 1 WHEN lo <= close * 0.98 THEN -1 WHEN whole THEN 0 END AS INT) AS triple_barrier_label FROM tb)"""


@query(S.with_(S.PANEL, _BARRIER, "SELECT * FROM lb"))
def triple_barrier(spark, d):
    return labels.triple_barrier(panels.panel(spark, d)).select("ticker", "date", "triple_barrier_label")


@query(S.with_(S.PANEL, _BARRIER, "SELECT ticker, date, CAST(triple_barrier_label > 0 AS INT) AS meta_label FROM lb WHERE triple_barrier_label <> 0"))
def meta_label(spark, d):
    return labels.meta_events(labels.triple_barrier(panels.panel(spark, d))).select("ticker", "date", "meta_label")


# Models on the few long histories


_INPUTS = ["log_volatility_lag_1", "log_volatility_lag_2", "log_return_lag_1", "obv", "atr", "day_of_week"]


def _model_table(spark, d) -> DataFrame:
    df = features.with_volatility(features.with_all_features(panels.panel_prio(spark, d)))
    df = features.with_next_target(features.with_lags(df, ["log_volatility", "log_return"]))
    return splits.split_by_distinct_dates(df.select("date", "ticker", "log_volatility", *_INPUTS).na.drop())


_SMALL = {"maxDepth": 3, "maxIter": 20}


@query()
def gbt_train_eval(spark, d):
    return rounded(models.train_and_evaluate(_model_table(spark, d), _SMALL), 4)


@query()
def cv_grid(spark, d):
    return rounded(models.tune(_model_table(spark, d), {"maxDepth": (2, 3), "maxIter": (5,)}, 5), 4)


@query()
def permutation_importance(spark, d):
    df = _model_table(spark, d)
    model = models.train(df.filter("split = 'train'"), _SMALL)
    return rounded(models.block_permutation(df.filter("split = 'test'"), model, _INPUTS, repeats=10), 4)


@query()
def leakage_shuffle(spark, d):
    return rounded(models.leakage_test(_model_table(spark, d), _SMALL), 4)


@query()
def model_choice(spark, d):
    kind, params, model = models.choose(_model_table(spark, d), {"linear": {"regParam": (0.0, 0.1)}, "forest": {"maxDepth": (3,), "numTrees": (20,)}}, 5)
    test = model.transform(_model_table(spark, d).filter("split = 'test'"))
    return rounded(evaluate.regression_metrics(test, "log_volatility", "pred").withColumn("kind", F.lit(kind)).withColumn("params", F.lit(str(params))), 4)


@query()
def meta_model(spark, d):
    df = labels.meta_events(labels.triple_barrier(features.with_all_features(panels.panel_prio(spark, d))))
    inputs = ["log_return", "atr", "obv", "day_of_week"]
    df = splits.split_by_distinct_dates(df.select("date", "ticker", "meta_label", *inputs).na.drop())
    model = models.meta_model(labels.balance_weights(df.filter("split = 'train'")), inputs)
    return rounded(labels.classification_metrics(models.scores(model, df.filter("split = 'test'"))), 4)


# Selections and reports


@query(S.with_(S.PANEL, "SELECT ticker, date FROM panel WHERE date BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'"))
def date_range(spark, d):
    return selection.by_date_range(panels.panel(spark, d), "1995-03-01", "1995-06-30", strict=False).select("ticker", "date")


@query(S.with_(S.PANEL, "SELECT ticker, date FROM panel WHERE year(date) = 1996"))
def year_slice(spark, d):
    return selection.by_year(panels.panel(spark, d), 1996).select("ticker", "date")


@query(S.with_(S.INDEX, "SELECT date, CASE WHEN date < DATE '1996-07-01' THEN 'train' ELSE 'test' END AS split FROM idx"))
def split_at_date(spark, d):
    return selection.split_by_date(panels.index(spark, d), "1996-07-01").select("date", "split")


@query(S.with_(S.PANEL, "SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n FROM panel GROUP BY ticker"))
def date_extent(spark, d):
    return selection.date_extent(panels.panel(spark, d), ("ticker",))


@query(S.with_(S.INDEX, "s AS (SELECT r, CASE WHEN row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM idx)", "SELECT split, count(*) AS n, " + ", ".join([S.r("avg(r)", "mean"), S.r("stddev_samp(r)", "std"), S.r("min(r)", "min"), *(S.r(f"quantile_cont(r, {q})", f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), S.r("max(r)", "max")]) + " FROM s GROUP BY split"))
def series_summary(spark, d):
    return rounded(selection.described(splits.split_by_rows(panels.index(spark, d)), "weighted_log_return"))


@query(S.with_(S.PANEL, f"SELECT ticker, {S.r('sum(volume * close)', 'turnover')} FROM panel GROUP BY ticker ORDER BY sum(volume * close) DESC, ticker LIMIT 20"))
def top_turnover(spark, d):
    sums = panels.panel(spark, d).groupBy("ticker").agg(F.sum(F.col("volume") * F.col("close")).alias("turnover"))
    return rounded(selection.top(sums, "turnover", 20, "ticker"))


@query(S.with_(S.INDEX, "n AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS k FROM idx)", f"SELECT date, {S.r('close')}, {S.r('r', 'weighted_log_return')} FROM n WHERE i % greatest(1, k // 500) = 0"))
def plotting_sample(spark, d):
    return rounded(selection.plotting_sample(panels.index(spark, d), 500))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS text, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_texts(spark, d):
    text = selection.date_text(F.col("o_orderdate"), "yyyy/MM/dd")
    return panels.table(spark, d, "orders").select("o_orderkey", text.alias("text"), selection.parsed_date(text).alias("day"))


@query("SELECT event_id, round(ln(greatest(exp(least(700.0, greatest(-700.0, value * 20 - 1000))), 1e-10)) + 1.3e-9, 6) + 0.0 AS log_s2 FROM events")
def bounded_variance(spark, d):
    return rounded(panels.ticks(spark, d).select("event_id", F.log(selection.bounded_variance(F.col("value") * 20 - 1000)).alias("log_s2")))


@query(S.with_(S.INDEX, S.RESIDUALS, _CENTRED.format("(e * e)"), f"SELECT CAST(lag AS INT) AS lag, {S.r('sk / s0', 'r')}, n, {S.r('1.96 / sqrt(n)', 'band')}, abs(sk / s0) > 1.96 / sqrt(n) AS outside FROM l, s"))
def acf_bands(spark, d):
    return rounded(selection.correlation_bands(diagnostics.autocorrelations(_residuals(spark, d), "e", square=True)))


@query(_eval_sql(_MZ, "both_ AS (SELECT 'plain' AS kind, e, sigma2 FROM fc UNION ALL SELECT 'calibrated', e, greatest(1e-12, mz.b * sigma2) FROM fc, mz)", f"SELECT kind, count(*) AS n, {S.r('avg(ln(sigma2) + e * e / sigma2)', 'qlike')}, {S.r('avg((e * e - sigma2) * (e * e - sigma2))', 'mse')}, {S.r('avg(abs(e * e - sigma2))', 'mae')}, {S.r('greatest(0.0, power(corr(e * e, sigma2), 2))', 'r2')} FROM both_ GROUP BY kind"))
def calibrated_losses(spark, d):
    return rounded(comparison.calibrated_metrics(_forecasts(spark, d)))


_PAIRS = f"""lags AS (SELECT ticker, date, lead(log_volatility) OVER ({_LAG}) AS y, lag(log_volatility) OVER ({_LAG}) AS p1, lag(log_volatility, 2) OVER ({_LAG}) AS p2, lag(log_volatility, 3) OVER ({_LAG}) AS p3 FROM vols),
pairs AS (SELECT 'lag_1' AS a, 'lag_2' AS b, (y - p1) * (y - p1) - (y - p2) * (y - p2) AS dd FROM lags WHERE y IS NOT NULL UNION ALL SELECT 'lag_2', 'lag_3', (y - p2) * (y - p2) - (y - p3) * (y - p3) FROM lags WHERE y IS NOT NULL)"""


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, _PAIRS, f"SELECT a, b, count(dd) AS n, {S.r('avg(dd)', 'mean_d')}, {S.r('avg(dd) / sqrt(var_samp(dd) / count(dd))', 'dm')} FROM pairs WHERE dd IS NOT NULL GROUP BY a, b"))
def model_pairs(spark, d):
    rows = _naive(spark, d)
    tall = rows.select("ticker", "date", F.col("log_volatility").alias("y"), F.explode(F.array(*(F.struct(F.lit(f"lag_{k}").alias("model"), F.col(f"log_volatility_lag_{k}").alias("pred")) for k in (1, 2, 3)))).alias("m")).select("ticker", "date", "y", "m.*")
    return rounded(comparison.pairwise(tall, (("lag_1", "lag_2"), ("lag_2", "lag_3"))))


@query()
def egarch_refit_forecast(spark, d):
    df = splits.split_by_rows(_series(spark, d))
    return rounded(refits.forecasts(df, start=250, every=63, steps=60).select("series", "date", "split", "e", "sigma2", "refit"), 4)


@query()
def egarch_search(spark, d):
    trials = refits.search_space((1,), ("student",), (63,), (500,))
    return rounded(refits.search(_series(spark, d), trials, 250, 40), 3)


# Streaming extension


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value) + 1.3e-9, 6) + 0.0 AS mean, round(min(value) + 1.3e-9, 6) + 0.0 AS low, round(max(value) + 1.3e-9, 6) + 0.0 AS high FROM events GROUP BY 1, 2")
def stream_hourly(spark, d):
    """The windowed aggregate of the stream, over the table as a batch."""
    from chronopanel.streaming import live

    return rounded(live.windowed(panels.table(spark, d, "events")).drop("end"))


from . import reports  # noqa: E402, F401  (registers its queries here)
