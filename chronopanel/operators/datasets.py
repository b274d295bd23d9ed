"""Learning tables: one window stage for features and lags, then projections for the ablations."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.sources.staging import staged

from . import features, splits
from .cleaning import drop_incomplete, ticker_codes

TARGET = "log_volatility"
INSIGHT = ("log_sigma_garch",)
META = ("date", "split", "ticker", "ticker_id")


def prepare(df: DataFrame) -> DataFrame:
    """From quotes with log_sigma_garch: volatility, indicators, lags, next-day target, complete rows, date split, ticker code.

    The wide table is worked out twice and never written or shuffled: of the first pass only its dates and tickers are kept, and the
    joins of the second leave its rows where the windows have put them. So df is to be deterministic.
    """
    df = features.with_volatility(features.with_all_features(df)).filter("log_sigma_garch is not null")
    df = features.with_lags(df, [*features.TECHNICAL, TARGET, *INSIGHT])
    df = drop_incomplete(features.with_next_target(df, TARGET))
    seen = staged(df.groupingSets([["date"], ["ticker"]], "date", "ticker").agg(F.grouping("date").alias("of_ticker")), "learning-keys")
    df = ticker_codes(df, seen.filter("of_ticker = 1").select("ticker"))  # before the other join: by the key of the windows
    return splits.split_by_distinct_dates(df, days=seen.filter("of_ticker = 0").select("date")).drop("log_volume", "high", "low")


def _lags(columns: tuple[str, ...], with_lags: bool = True) -> list[str]:
    return [f"{c}_lag_{k}" for c in columns for k in features.LAGS] if with_lags else []


def families(df: DataFrame, with_lags: bool = True) -> dict[str, list[str]]:
    """Columns of each family that df has, in order."""
    wanted = {
        "meta": list(META),
        "target": [TARGET],
        "target_lags": _lags((TARGET,), with_lags),
        "technical": [*features.TECHNICAL, *_lags(features.TECHNICAL, with_lags)],
        "calendar": list(features.CALENDAR),
        "insight": [*INSIGHT, *_lags(INSIGHT, with_lags)],
    }
    return {k: [c for c in v if c in df.columns] for k, v in wanted.items()}


#: What each ablation keeps beside meta data and target.
VARIANTS: dict[str, tuple[str, ...]] = {
    "complete": ("technical", "target_lags", "calendar", "insight"),
    "without_insight": ("technical", "target_lags", "calendar"),
    "technical_only": ("technical", "calendar"),
    "technical_plus_insight": ("technical", "calendar", "insight"),
    "insight_only": ("insight",),
    "log_volatility_only": ("target_lags",),
    "log_volatility_plus_insight": ("target_lags", "insight"),
    "without_sigma2": ("technical", "target_lags", "calendar", "insight"),
}


def variant(df: DataFrame, name: str) -> DataFrame:
    own = families(df)
    keep = [*own["meta"], *own["target"], *(c for f in VARIANTS[name] for c in own[f])]
    if name == "without_sigma2":
        keep = [c for c in keep if not c.startswith("sigma2_garch")]
    return df.select(*keep)


def features_of(df: DataFrame) -> list[str]:
    """Model inputs: all numbers but the target, the split, names and raw volume."""
    skip = {"date", "split", TARGET, "volume", "ticker", "tickers"}
    return [c for c, t in df.dtypes if c not in skip and t in ("double", "float", "int", "bigint")]


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long correlation matrix of average ranks over complete rows: a, b, rho.

    All columns are ranked together: their distinct values are range-partitioned by column and value, counted within a part, and
    offset by what lies in the parts before. Ranks then go back to their rows by one join and one aggregation.
    """
    spark, at = df.sparkSession, range(len(columns))
    rows = df.select(*(F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns))).na.drop()
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "ranks")
    tall = rows.select("row", F.posexplode(F.array(*(f"v{i}" for i in at))).alias("c", "x"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = tall.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(parts, "c", "x")
    counts = staged(counts.withColumn("part", F.spark_partition_id()), "rank-counts")
    ahead = lambda order, *keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("c", "part").agg(F.sum("n").alias("t"))
    sums = sums.select("c", "part", F.coalesce(F.sum("t").over(ahead("part", "c")), F.lit(0)).alias("offset"))
    ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead("x", "c", "part")), F.lit(0)))
    ranked = ranked.join(F.broadcast(sums), ["c", "part"])  # a row a column and part
    ranked = staged(ranked.select("c", "x", (F.col("offset") + F.col("before") + (F.col("n") + 1) / 2).alias("rank")), "rank-values")
    wide = tall.join(ranked, ["c", "x"]).groupBy("row").agg(*(F.max(F.when(F.col("c") == i, F.col("rank"))).alias(f"r{i}") for i in at))
    vectors = VectorAssembler(inputCols=[f"r{i}" for i in at], outputCol="ranks").transform(wide).select("ranks")
    matrix = Correlation.corr(vectors, "ranks").first()[0].toArray()  # a number a pair of columns
    pairs = [(a, b, float(matrix[i][j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    return spark.createDataFrame(pairs, "a string, b string, rho double")
