"""Time-ordered training, tuning, importance and leakage tests of tree models on Spark ML."""

from __future__ import annotations

from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.ranks import positions
from chronopanel.sources.staging import staged

from . import evaluate
from .datasets import TARGET, features_of

LEAKAGE_R2 = 0.1
GRID = {"maxDepth": (3, 5), "stepSize": (0.1,), "maxIter": (20,)}
REGISTRY = {"gbt": GBTRegressor, "forest": RandomForestRegressor, "linear": LinearRegression}


def inputs_of(df: DataFrame, target: str) -> list[str]:
    return [c for c in features_of(df) if c not in (target, "fold")]


def train(df: DataFrame, params: dict | None = None, target: str = TARGET, inputs: list[str] | None = None, kind: str = "gbt") -> PipelineModel:
    inputs = inputs or inputs_of(df, target)
    model = REGISTRY[kind](labelCol=target, featuresCol="features", predictionCol="pred", **(params or {}))
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip"), model]).fit(df)


def train_and_evaluate(df: DataFrame, params: dict | None = None, target: str = TARGET) -> DataFrame:
    """Metrics of a model of the train rows on the test rows."""
    model = train(df.filter("split = 'train'"), params, target)
    return evaluate.regression_metrics(model.transform(df.filter("split = 'test'")), target, "pred")


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    names, values = model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def fold_dates(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """df with fold: 0 for rows that are never validated, k for those of the k-th validation block of dates; whole dates stay together."""
    days = df.select("date").distinct()
    n, k = F.row_number().over(Window.orderBy("date")) - 1, F.count(F.lit(1)).over(Window.partitionBy())
    size = F.floor(k / (n_splits + 1))
    fold = F.greatest(F.lit(0), F.floor((n - (k - size * n_splits)) / size) + 1).cast("int")
    return df.join(days.select("date", fold.alias("fold")), "date")


def cross_validate(df: DataFrame, params: dict, n_splits: int = 5, target: str = TARGET, kind: str = "gbt") -> list[float]:
    """RMSE of each fold; a model sees only dates before its fold."""
    folds = staged(fold_dates(df, n_splits), "folds")  # every fit reads it
    out = []
    for k in range(1, n_splits + 1):
        model = train(folds.filter(F.col("fold") < k), params, target, inputs_of(df, target), kind)
        out.append(evaluate.regression_metrics(model.transform(folds.filter(F.col("fold") == k)), target, "pred").first()["rmse"])
    return out


def tune(df: DataFrame, grid: dict = GRID, n_splits: int = 3, target: str = TARGET) -> DataFrame:
    """A row a combination: params as JSON and mean RMSE; best first."""
    import json

    rows = []
    for values in product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        scores = cross_validate(df, params, n_splits, target)
        rows.append((json.dumps(params, sort_keys=True), sum(scores) / len(scores)))
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0])), "params string, rmse double")


def choose(df: DataFrame, grids: dict[str, dict], n_splits: int = 3, target: str = TARGET) -> tuple[str, dict, PipelineModel]:
    """The kind and parameters of least mean RMSE over time folds of the train rows, fitted on all of them."""
    train_rows = df.filter("split = 'train'")
    best = None
    for kind, grid in sorted(grids.items()):
        for values in product(*grid.values()):
            params = dict(zip(grid, values, strict=True))
            found = cross_validate(train_rows, params, n_splits, target, kind)
            score = sum(found) / len(found)
            if best is None or score < best[0]:
                best = (score, kind, params)
    return best[1], best[2], train(train_rows, best[2], target, inputs_of(df, target), best[1])


def primary_labels(df: DataFrame, grids: dict[str, dict], target: str = "log_return", n_splits: int = 5, **barriers) -> tuple[str, dict, DataFrame]:
    """The kind and parameters chosen over time folds of the train rows, and df with primary_pred and barrier labels of the test rows.

    df: date, ticker, close, split, target and inputs; the price is no input. Train rows keep a null label.
    """
    from .labels import test_only, triple_barrier

    labelled = test_only(triple_barrier(df, **barriers))
    kind, params, model = choose(df.drop("close"), grids, n_splits, target)
    return kind, params, model.transform(labelled).withColumnRenamed("pred", "primary_pred").drop("features")


def shuffled_target(df: DataFrame, target: str = TARGET, seed: int = 42, rows_a_group: int = 50_000) -> DataFrame:
    """Every row has another row's target: rows fall into random groups, and in each group rows and targets are ranked by two
    hashes and joined by rank."""
    groups = max(1, df.count() // rows_a_group)
    key = F.xxhash64(*df.columns)

    def ranked(s: int) -> DataFrame:
        keyed = df.withColumn("__g", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(groups)))
        return keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__g").orderBy(F.xxhash64(key, F.lit(s)), *df.columns)))

    values = ranked(seed + 1).select("__g", "__r", F.col(target).alias("__t"))
    return ranked(seed + 2).join(values, ["__g", "__r"]).withColumn(target, F.col("__t")).drop("__g", "__r", "__t")


def leakage_test(df: DataFrame, params: dict | None = None, target: str = TARGET, seed: int = 42) -> DataFrame:
    """r2 on test after training on a shuffled target, and whether it betrays a leak."""
    model = train(shuffled_target(df.filter("split = 'train'"), target, seed), params, target, inputs_of(df, target))
    got = evaluate.regression_metrics(model.transform(df.filter("split = 'test'")), target, "pred")
    return got.select("n", "r2", (F.coalesce("r2", F.lit(0.0)) > LEAKAGE_R2).alias("leak"))


def block_permutation(df: DataFrame, model: PipelineModel, columns: list[str], block: int = 20, repeats: int = 5, share: float = 0.3, target: str = TARGET, seed: int = 42) -> DataFrame:
    """column, delta_r2_mean, delta_r2_std, delta_rmse_mean: a column's blocks of rows in time order trade places within a contiguous window.

    Blocks are dealt by a hash; the permuted values are joined by position. All repeats are scored in one pass.
    """
    n = df.count()
    size = max(block, int(n * share) // block * block)
    rows = positions(df, "date", "ticker", out="__i").filter(F.col("__i") < size)
    base = evaluate.regression_metrics(model.transform(rows), target, "pred").first()
    blocks = df.sparkSession.range(0, max(1, size // block)).select(F.col("id").alias("__b"))
    reps = df.sparkSession.range(0, repeats).select(F.col("id").alias("rep"))
    dealt = blocks.join(F.broadcast(reps))  # a few numbers a block
    dealt = dealt.withColumn("__to", F.row_number().over(Window.partitionBy("rep").orderBy(F.xxhash64("__b", "rep", F.lit(seed)), "__b")) - 1)
    out = []
    for c in columns:
        values = rows.select(F.floor(F.col("__i") / block).alias("__b"), (F.col("__i") % block).alias("__o"), F.col(c).alias("__v")).join(dealt, "__b").select("rep", (F.col("__to") * block + F.col("__o")).alias("__i"), "__v")
        changed = rows.join(values, "__i").withColumn(c, F.col("__v")).drop("__v")
        got = evaluate.regression_metrics(model.transform(changed), target, "pred", ("rep",))
        out.append(got.agg(F.lit(c).alias("column"), F.avg(base["r2"] - F.col("r2")).alias("delta_r2_mean"), F.stddev_samp(base["r2"] - F.col("r2")).alias("delta_r2_std"), F.avg(F.col("rmse") - base["rmse"]).alias("delta_rmse_mean")))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.orderBy(F.desc("delta_r2_mean"), "column")


def meta_model(df: DataFrame, inputs: list[str], label: str = "meta_label") -> PipelineModel:
    """Scaled, class-balanced logistic regression. df: inputs, label, weight."""
    stages = [VectorAssembler(inputCols=inputs, outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)]
    return Pipeline(stages=stages).fit(df)


def stratified_auc(df: DataFrame, inputs: list[str], label: str = "meta_label", folds: int = 3) -> float:
    """Mean area under the curve over folds that share out each class evenly: rows are dealt by rank of a hash within their class and day."""
    from .labels import balance_weights, classification_metrics

    w = Window.partitionBy(label, "date").orderBy(F.xxhash64(*df.columns))
    dealt = df.withColumn("__fold", F.pmod(F.row_number().over(w) + F.xxhash64(label, "date"), F.lit(folds)))
    areas = []
    for k in range(folds):
        model = meta_model(balance_weights(dealt.filter(F.col("__fold") != k), label), inputs, label)
        areas.append(classification_metrics(scores(model, dealt.filter(F.col("__fold") == k)), label).first()["roc_auc"])
    return sum(areas) / folds


def scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])
