"""Global order without a global task: ranks and positions from buckets of sampled quantiles or of dates.

A window without partitions sends all rows to one task. Here rows are numbered within buckets, and a table with a row a
bucket gives what lies before each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def splitters(df: DataFrame, columns: list[str], buckets: int = BUCKETS) -> dict[str, list[float]]:
    """Approximate quantiles of each column, at most buckets - 1 numbers; one pass for all columns."""
    found = df.stat.approxQuantile(columns, [i / buckets for i in range(1, buckets)], 0.01)
    return {c: sorted(set(v)) for c, v in zip(columns, found, strict=True)}


def bucket_of(c: Column, bounds: list[float]) -> Column:
    """How many bounds do not exceed the value: a search tree of comparisons."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(c < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def before(counts: DataFrame, column: str, n: str = "n", out: str = "before", bounds: list[float] | None = None) -> DataFrame:
    """counts (distinct values of a numeric column, and n) with the sum of n of all smaller values."""
    bounds = splitters(counts, [column])[column] if bounds is None else bounds
    rows = counts.withColumn("__b", bucket_of(F.col(column), bounds))
    small = rows.groupBy("__b").agg(F.sum(n).alias("__t"))
    offsets = small.select("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inside = Window.partitionBy("__b").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn(out, F.coalesce(F.sum(n).over(inside), F.lit(0)))
    return ranked.join(F.broadcast(offsets), "__b").withColumn(out, F.col(out) + F.col("__o")).drop("__b", "__o")  # BUCKETS rows


def positions(df: DataFrame, date: str, *ties: str, out: str = "position") -> DataFrame:
    """df with its position (from 0) by date, then ties: days are counted, and rows numbered within their day."""
    days = df.groupBy(date).agg(F.count(F.lit(1)).alias("__n"))
    offsets = days.select(date, F.coalesce(F.sum("__n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    inside = Window.partitionBy(date).orderBy(*(ties or (F.lit(0),)))
    return df.withColumn(out, F.row_number().over(inside) - 1).join(offsets, date).withColumn(out, F.col(out) + F.col("__o")).drop("__o")
