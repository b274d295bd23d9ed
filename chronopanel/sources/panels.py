"""Panels derived from the order and event tables: deterministic, and free of tie breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.columns import log_ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, for_windows: bool = False) -> DataFrame:
    """(ticker, date, close, high, low, volume) by supplier and ship date.

    for_windows: line items are dealt by ticker at once, so that windows by ticker need no exchange of their own. Without sums before that
    exchange, which hardly pay where few line items share a supplier and day.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
    return (
        (items.repartition("ticker") if for_windows else items)
        .groupBy("ticker", "date")
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"))
    )


def panel_prio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, high, low, volume) by order priority and date: few tickers with long histories."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("date"))
        .agg(F.max_by("o_totalprice", "o_orderkey").alias("close"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count(F.lit(1)).cast("double").alias("volume"))
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, close, weighted_log_return): one series, a row a day; the window is over calendar days only."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))
    w = Window.orderBy("date")
    return days.withColumn("weighted_log_return", log_ratio(F.col("close"), F.lag("close").over(w))).filter("weighted_log_return is not null")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
