"""Barrier labels and the table for a secondary model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.ranks import before

from .features import by_date


def triple_barrier(df: DataFrame, price: str = "close", horizon: int = 5, up: float = 0.02, down: float = 0.02, ticker: str | None = "ticker") -> DataFrame:
    """1 if a price of the next horizon rows reaches the upper barrier, else -1 if one reaches the lower, else 0; null where neither
    is reached and the horizon runs past the end. The upper barrier has precedence, whichever is touched first."""
    ahead = by_date(ticker).rowsBetween(1, horizon)
    c = F.col(price)
    complete = F.lead(price, horizon + 1).over(by_date(ticker)).isNotNull()
    label = F.when(F.max(c).over(ahead) >= c * (1 + up), 1).when(F.min(c).over(ahead) <= c * (1 - down), -1).when(complete, 0)
    return df.withColumn("triple_barrier_label", label.cast("int"))


def test_only(df: DataFrame, label: str = "triple_barrier_label") -> DataFrame:
    """Train rows have no label."""
    return df.withColumn(label, F.when(F.col("split") == "test", F.col(label)))


def meta_events(df: DataFrame, label: str = "triple_barrier_label") -> DataFrame:
    """Rows with a decided label; meta_label is 1 for the upper barrier."""
    return df.filter(F.col(label).isNotNull() & (F.col(label) != 0)).withColumn("meta_label", (F.col(label) > 0).cast("int"))


def filled(df: DataFrame, columns: list[str], ticker: str = "ticker") -> DataFrame:
    """Nulls take the last value before, else the first after."""
    w = Window.partitionBy(ticker).orderBy("date")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)) for c in columns})


def balance_weights(df: DataFrame, label: str = "meta_label") -> DataFrame:
    """weight: n / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"), F.count(F.lit(1)).alias("__k"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return df.join(F.broadcast(weights), label)  # a row a class


def classification_metrics(df: DataFrame, label: str = "meta_label", pred: str = "prediction", score: str = "score") -> DataFrame:
    """accuracy, precision, recall, f1, roc_auc; the area is the mean rank of positives, over counts of distinct scores."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    by_score = df.groupBy(score).agg(F.count_if(y).alias("a"), F.count_if(~y).alias("b"))
    area = before(by_score, score, "b", "below").withColumn("u", F.col("a") * (F.col("below") + F.col("b") / 2)).agg((F.sum("u") / (F.sum("a") * F.sum("b"))).alias("roc_auc"))
    precision, recall = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.join(F.broadcast(area)).select("n", ((F.col("n") - F.col("fp") - F.col("fn")) / F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "roc_auc")
