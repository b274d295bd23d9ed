"""Readers and writers: parquet first, csv else; schema checks; reports as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise KeyError(f"{what} lacks {missing}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def read_table(spark: SparkSession, path: str, *, schema: T.StructType | None = None, required: Iterable[str] = (), dates: Iterable[str] = (), renames: dict[str, str] | None = None, not_null: Iterable[str] = (), file_format: str | None = None) -> DataFrame:
    """The table at path, or at path with the suffix .parquet or .csv; errors stay loud."""
    stem = path.removesuffix(".parquet").removesuffix(".csv")
    found = [(f, p) for f, p in (("parquet", f"{stem}.parquet"), ("csv", f"{stem}.csv"), (file_format or "parquet", path)) if file_format in (None, f) and _exists(spark, p)]
    if not found:
        raise FileNotFoundError(path)
    kind, where = found[0]
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(where) if kind == "parquet" else reader.csv(where, header=True, inferSchema=schema is None)
    for old, new in (renames or {}).items():
        df = df.withColumnRenamed(old, new)
    require_columns(df, [*required, *dates], where)
    for c in dates:
        df = df.withColumn(c, F.to_date(c))
    return df.na.drop(subset=list(not_null)) if not_null else df


def write_both(df: DataFrame, stem: str) -> None:
    """Parquet and CSV side by side; the CSV comes from the Parquet just written, so df is computed once."""
    df.write.mode("overwrite").parquet(f"{stem}.parquet")
    df.sparkSession.read.schema(df.schema).parquet(f"{stem}.parquet").write.mode("overwrite").option("header", True).csv(f"{stem}.csv")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small report as one JSON document, on any file system."""
    spark.createDataFrame([(json.dumps(report, indent=2, sort_keys=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def read_report(spark: SparkSession, path: str, required: Iterable[str] = ()) -> dict:
    report = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    missing = sorted(set(required) - set(report))
    if missing:
        raise KeyError(f"{path} lacks {missing}")
    return report


def write_tickers(df: DataFrame, path: str) -> None:
    df.select("ticker").distinct().orderBy("ticker").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_tickers(spark: SparkSession, path: str) -> DataFrame:
    """What write_tickers wrote: ticker, trimmed, without empty names and repeats."""
    df = require_columns(spark.read.schema("ticker string").csv(path, header=True), ["ticker"], path)
    return df.select(F.trim("ticker").alias("ticker")).filter("ticker <> ''").distinct()


def with_volume(df: DataFrame, base: DataFrame | None) -> DataFrame:
    """df with the volume of base by date and ticker, where df has none of its own; base may call tickers either way."""
    if "volume" in df.columns or base is None:
        return df
    base = base.withColumnRenamed("tickers", "ticker")
    return df.join(require_columns(base, ["date", "ticker", "volume"], "base").select("date", "ticker", "volume"), ["date", "ticker"], "left")


def first_available(spark: SparkSession, paths: Iterable[str], base: str | None = None) -> DataFrame:
    """The first table of paths that exists (insights before plain ones), tickers named alike, with the volume of base if it lacks one."""
    for path in paths:
        try:
            df = read_table(spark, path, dates=["date"])
        except FileNotFoundError:
            continue
        if "ticker" not in df.columns:
            df = require_columns(df, ["tickers"], path).withColumnRenamed("tickers", "ticker")
        return with_volume(df, read_table(spark, base, dates=["date"]) if base and "volume" not in df.columns else None)
    raise FileNotFoundError(", ".join(paths))


def ingest(raw: DataFrame) -> DataFrame:
    """Downloaded quotes to (date, tickers, high, low, close, volume): renamed, complete rows only."""
    df = raw
    for c in raw.columns:
        df = df.withColumnRenamed(c, "tickers" if c.lower() in ("ticker", "tickers") else c.lower())
    require_columns(df, ["date", "tickers", "close", "volume", "high", "low"], "download")
    return df.select(F.to_date("date").alias("date"), "tickers", "high", "low", "close", "volume").na.drop("any")


def overlaps(low: Column, high: Column, start: str, end: str) -> Column:
    """Whether [low, high] meets the requested range."""
    return (low <= F.to_date(F.lit(end))) & (high >= F.to_date(F.lit(start)))


def covered_tickers(df: DataFrame, start: str, end: str) -> DataFrame:
    """Tickers whose dates meet the range, with their own range."""
    return df.groupBy("tickers").agg(F.min("date").alias("first"), F.max("date").alias("last")).filter(overlaps(F.col("first"), F.col("last"), start, end))


def failed_tickers(constituents: DataFrame, covered: DataFrame) -> DataFrame:
    return constituents.select(F.col("ticker").alias("tickers")).join(covered.select("tickers"), "tickers", "left_anti")


def fetch_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
