"""Shapley values of tree ensembles, exact for the value that a tree has when a feature is unknown: both ways by their share of rows.

Every leaf is a product game over the features on its path: known features let a row through or not, unknown ones let through a
fixed share. The Shapley values of such a game follow from elementary symmetric sums over the path, so a tree costs its leaves times
the square of its depth, for a whole Arrow batch of rows at once. The trees alone are on the driver and broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Leaf(NamedTuple):
    """value times the tree's weight; per feature of the path its bounds (low, high] and the share of rows let through."""

    value: float
    bounds: dict[int, tuple[float, float]]
    share: dict[int, float]


def leaves_of(node, weight: float, bounds: dict | None = None, share: dict | None = None) -> list[Leaf]:
    """The leaves below a node of a fitted tree."""
    bounds, share = bounds or {}, share or {}
    if node.subtreeDepth() == 0:
        return [Leaf(weight * node.prediction(), bounds, share)]
    at, split = node.split().featureIndex(), node.split()
    low, high = bounds.get(at, (-math.inf, math.inf))
    found, whole = [], node.impurityStats().count()
    for child, own in ((node.leftChild(), (low, min(high, split.threshold()))), (node.rightChild(), (max(low, split.threshold()), high))):
        passed = share.get(at, 1.0) * child.impurityStats().count() / whole
        found += leaves_of(child, weight, bounds | {at: own}, share | {at: passed})
    return found


def ensemble_leaves(model: PipelineModel) -> list[Leaf]:
    """Of a boosted or bagged ensemble of regression trees with continuous features, the last stage of model."""
    last = model.stages[-1]
    weights = list(last.treeWeights)
    scale = sum(weights) if "Forest" in type(last).__name__ else 1.0
    return [leaf for tree, w in zip(last.trees, weights, strict=True) for leaf in leaves_of(tree._java_obj.rootNode(), w / scale)]


def shapley(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """(rows, features + 1): the value of each feature for each row, and last the value with no feature known."""
    out = np.zeros((len(x), x.shape[1] + 1))
    for leaf in leaves:
        features = list(leaf.bounds)
        d = len(features)
        known = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, (lo, hi) in leaf.bounds.items()]
        unknown = [leaf.share[f] for f in features]
        out[:, -1] += leaf.value * math.prod(unknown)
        weights = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for i, f in enumerate(features):
            # sums[k]: over the sets of k other features, the product of what known and unknown ones let through
            sums = [np.ones(len(x))] + [np.zeros(len(x)) for _ in range(d - 1)]
            for j in range(d):
                if j != i:
                    for k in range(d - 1, 0, -1):
                        sums[k] = sums[k] * unknown[j] + sums[k - 1] * known[j]
                    sums[0] = sums[0] * unknown[j]
            out[:, f] += leaf.value * (known[i] - unknown[i]) * sum(w * s for w, s in zip(weights, sums, strict=True))
    return out


def shap_values(model: PipelineModel, df: DataFrame) -> DataFrame:
    """date, ticker, values (by input), base, pred of every row of df: base and values add up to pred."""
    leaves = df.sparkSession.sparkContext.broadcast(ensemble_leaves(model))
    rows = model.transform(df).select("date", "ticker", vector_to_array("features").alias("x"), "pred")
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = shapley(leaves.value, np.stack(pdf["x"].to_numpy()))
                yield pd.DataFrame({"date": pdf["date"], "ticker": pdf["ticker"], "values": list(v[:, :-1]), "base": v[:, -1], "pred": pdf["pred"]})

    return rows.mapInPandas(run, f"date {kind['date']}, ticker {kind['ticker']}, values array<double>, base double, pred double")


def shap_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """feature, importance (mean absolute value), place; by importance."""
    names = F.array(*(F.lit(c) for c in model.stages[0].getInputCols()))
    each = shap_values(model, df).select(F.explode(F.arrays_zip(names.alias("feature"), F.col("values").alias("value"))).alias("x")).select("x.*")
    means = each.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance"))  # a row a feature
    return means.selectExpr("feature", "importance", "cast(row_number() over (order by importance desc, feature) as int) as place")
