"""Forecast evaluation: losses, calibration, value-at-risk backtests and forecast comparison, each as one aggregation."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import special
from chronopanel.functions.columns import INF, clamp, text_key

EPS = 1e-12


def usable(df: DataFrame, e: str = "e", s2: str = "sigma2") -> DataFrame:
    """Rows with a finite residual and a finite positive variance."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)
    return df.filter(good(e) & good(s2) & (F.col(s2) > 0))


def variance_losses(df: DataFrame, e: str = "e", s2: str = "sigma2", keys: tuple[str, ...] = ()) -> DataFrame:
    r2, v = F.col(e) * F.col(e), F.col(s2)
    return (
        usable(df, e, s2)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.log(v) + r2 / v).alias("qlike"),
            F.avg((r2 - v) * (r2 - v)).alias("mse"),
            F.avg(F.abs(r2 - v)).alias("mae"),
            F.greatest(F.lit(0.0), F.pow(F.corr(r2, v), F.lit(2.0))).alias("r2"),
        )
    )


def mincer_zarnowitz(df: DataFrame, e: str = "e", s2: str = "sigma2") -> DataFrame:
    """e^2 = intercept + slope * s2: coefficients, R2 and t statistics."""
    y, x = F.col(e) * F.col(e), F.col(s2)
    fit = usable(df, e, s2).agg(
        F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_avgx(y, x).alias("mx"),
    )
    noise = F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2)
    t_slope = F.col("slope") / F.sqrt(noise / F.col("sxx"))
    t_intercept = F.col("intercept") / F.sqrt(noise * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx")))
    return fit.select("n", "intercept", "slope", "r2", t_intercept.alias("t_intercept"), t_slope.alias("t_slope"))


def mincer_zarnowitz_p(fit: DataFrame) -> DataFrame:
    """The row of mincer_zarnowitz with two-sided p values of intercept 0 and slope 0."""
    r = fit.first()
    p = {f"p_{k}": 2 * (1 - special.t_cdf(abs(r[f"t_{k}"]), r["n"] - 2)) for k in ("intercept", "slope")}
    return fit.select("*", *(F.lit(v).alias(k) for k, v in p.items()))


def calibrated(s2: Column, intercept: Column, slope: Column, with_intercept: bool = False) -> Column:
    return F.when(s2.isNotNull(), F.greatest(F.lit(EPS), slope * s2 + (intercept if with_intercept else F.lit(0.0))))


def value_at_risk(df: DataFrame, alphas: tuple[float, ...] = (0.01, 0.05), dist: str = "student", nu: float = 8.0, lam: float | None = None) -> DataFrame:
    """A row a level: alpha, value_at_risk, hit."""
    levels = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(special.quantile(dist, a, nu, lam)).alias("q")) for a in alphas))
    rows = usable(df).withColumn("__l", F.explode(levels)).withColumn("alpha", F.col("__l.alpha")).withColumn("value_at_risk", F.col("__l.q") * F.sqrt("sigma2")).drop("__l")
    return rows.withColumn("hit", (F.col("e") < F.col("value_at_risk")).cast("int"))


def kupiec(hits: DataFrame) -> DataFrame:
    """alpha, n, x, hit_rate, lr_uc of unconditional coverage."""
    likelihood = lambda p: (F.col("n") - F.col("x")) * F.log(1 - p) + F.col("x") * F.log(p)
    sums = hits.groupBy("alpha").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("x")).withColumn("hit_rate", F.col("x") / F.col("n"))
    lr = -2 * (likelihood(clamp(F.col("alpha"), EPS, 1 - EPS)) - likelihood(clamp(F.col("hit_rate"), EPS, 1 - EPS)))
    return sums.withColumn("lr_uc", lr)


def christoffersen(hits: DataFrame, order: str = "date") -> DataFrame:
    """alpha, transition counts and lr_ind of independence, of a single series: a task orders the days of a level."""
    before = F.lag("hit").over(Window.partitionBy("alpha").orderBy(order))
    pairs = hits.withColumn("__b", before).filter("__b is not null")
    counts = pairs.groupBy("alpha").agg(*(F.count_if((F.col("__b") == i) & (F.col("hit") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)))
    at_least_one = lambda *c: F.greatest(F.lit(1), sum((F.col(x) for x in c[1:]), F.col(c[0])))
    p01, p11 = F.col("n01") / at_least_one("n00", "n01"), F.col("n11") / at_least_one("n10", "n11")
    p = (F.col("n01") + F.col("n11")) / at_least_one("n00", "n01", "n10", "n11")
    term = lambda q, no, yes: F.col(no) * F.log(1 - clamp(q, EPS, 1 - EPS)) + F.col(yes) * F.log(clamp(q, EPS, 1 - EPS))
    free = term(p01, "n00", "n01") + term(p11, "n10", "n11")
    tied = term(p, "n00", "n01") + term(p, "n10", "n11")
    return counts.withColumn("lr_ind", -2 * (tied - free))


def var_backtest(df: DataFrame, alphas: tuple[float, ...] = (0.01, 0.05), dist: str = "student", nu: float = 8.0, lam: float | None = None) -> DataFrame:
    hits = value_at_risk(df, alphas, dist, nu, lam)
    return kupiec(hits).join(christoffersen(hits), "alpha").withColumn("lr_cc", F.col("lr_uc") + F.col("lr_ind"))


def with_p_values(backtest: DataFrame) -> DataFrame:
    """p values of the few rows of a backtest, evaluated on the driver."""
    rows = [(*r, special.chi2_sf(r["lr_uc"], 1), special.chi2_sf(r["lr_ind"], 1), special.chi2_sf(r["lr_cc"], 2)) for r in backtest.collect()]
    names = ", ".join(f"{c} {t}" for c, t in backtest.dtypes)
    return backtest.sparkSession.createDataFrame(rows, f"{names}, p_uc double, p_ind double, p_cc double")


def regression_metrics(df: DataFrame, y: str, pred: str, keys: tuple[str, ...] = ()) -> DataFrame:
    e = F.col(y) - F.col(pred)
    sums = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys)
    return sums.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )


def diebold_mariano(df: DataFrame, e1: str, e2: str, power: int = 2, h: int = 1, order: str = "date") -> DataFrame:
    """Mean loss difference over its standard error; h > 1 adds autocovariances, at lags below h, of the mean difference of each date.

    One row a date is left before the window, so its size is that of the calendar.
    """
    d = F.pow(F.abs(e1), F.lit(float(power))) - F.pow(F.abs(e2), F.lit(float(power)))
    rows = df.withColumn("__d", d)
    stats = rows.agg(F.count("__d").alias("n"), F.avg("__d").alias("mean_d"), F.var_samp("__d").alias("variance"))
    if h > 1:
        w = Window.orderBy(order)
        daily = rows.filter("__d is not null").groupBy(order).agg(F.avg("__d").alias("__d"))
        centred = daily.join(F.broadcast(stats.select("mean_d"))).withColumn("__c", F.col("__d") - F.col("mean_d"))  # one row
        lagged = centred.select(*((F.col("__c") * F.lag("__c", k).over(w)).alias(f"g{k}") for k in range(1, h)))
        extra = lagged.agg(sum((F.coalesce(F.avg(f"g{k}"), F.lit(0.0)) for k in range(1, h)), F.lit(0.0)).alias("extra"))
        stats = stats.join(F.broadcast(extra)).withColumn("variance", F.col("variance") + 2 * F.col("extra")).drop("extra")
    return stats.withColumn("dm", F.when(F.col("variance") > 0, F.col("mean_d") / F.sqrt(F.col("variance") / F.col("n"))).otherwise(F.lit(0.0)))


def _poisson_weights(keys: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """Poisson(1) weight of each row in a repetition, the same however rows are dealt.

    Multilinear hashing of three 20-bit parts of the key, with coefficients of 40 bits from the repetition and the top 21 bits as the
    uniform number: weights of two rows are independent, and those of two repetitions have coefficients of their own.
    """
    digest = hashlib.sha256(f"{seed}|{rep}".encode()).hexdigest()
    c0, c1, c2, c3 = (int(digest[i : i + 10], 16) for i in (0, 10, 20, 30))
    part = (1 << 20) - 1
    x = (keys & part) * c0 + (keys >> 20 & part) * c1 + (keys >> 40 & part) * c2 + c3
    return np.searchsorted(_POISSON, ((x & ((1 << 40) - 1)) >> 19) / float(1 << 21), side="right").astype(float)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap_r2(df: DataFrame, y: str, p1: str, p2: str, reps: int = 1000, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """rep, r2_1, r2_2, difference: Poisson(1) weights stand for resampled rows, so no row moves or multiplies.

    keys (all columns if none) name a row; rows of the same name have the same weights. Each task keeps five sums a repetition over its Arrow batches; those alone are shuffled.
    """
    rows = df.filter(F.col(y).isNotNull() & F.col(p1).isNotNull() & F.col(p2).isNotNull()).select(text_key(*map(F.col, keys or df.columns)).alias("k"), F.col(y).cast("double").alias("y"), F.col(p1).cast("double").alias("a"), F.col(p2).cast("double").alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((reps, 5))
        for pdf in batches:
            keys, v = pdf["k"].to_numpy(), pdf["y"].to_numpy()
            terms = np.column_stack([np.ones(len(v)), v, v * v, (v - pdf["a"].to_numpy()) ** 2, (v - pdf["b"].to_numpy()) ** 2])
            for rep in range(reps):
                sums[rep] += _poisson_weights(keys, rep, seed) @ terms
        yield pd.DataFrame(sums, columns=["n", "s", "ss", "e1", "e2"]).assign(rep=range(1, reps + 1))

    parts = rows.mapInPandas(run, "n double, s double, ss double, e1 double, e2 double, rep int")
    sums = parts.groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss", "e1", "e2")))
    sst = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return sums.select("rep", (1 - F.col("e1") / sst).alias("r2_1"), (1 - F.col("e2") / sst).alias("r2_2"), ((F.col("e2") - F.col("e1")) / sst).alias("difference"))


def bootstrap_summary(reps: DataFrame) -> DataFrame:
    share = F.avg((F.col("difference") <= 0).cast("int"))
    ends = [F.expr(f"percentile(difference, {q})").alias(name) for q, name in ((0.025, "low"), (0.975, "high"))]
    return reps.agg(F.avg("difference").alias("mean"), *ends, (2 * F.least(share, 1 - share)).alias("p_value"))


def naive_forecast(df: DataFrame, target: str = "log_volatility") -> DataFrame:
    """The first lag as a forecast of the shifted target."""
    return df.withColumn("pred", F.col(f"{target}_lag_1"))


def random_forecast(df: DataFrame, target: str = "log_volatility", seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """Normal draws with the target's mean and deviation, from hashes of the row's keys (all columns if none): the same however rows are dealt."""
    uniform = lambda k: (text_key(*map(F.col, keys or df.columns), F.lit(seed), F.lit(k)) + 0.5) / float(1 << 60)
    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    stats = df.agg(F.avg(target).alias("__m"), F.stddev_pop(target).alias("__s"))
    return df.withColumn("__z", normal).join(F.broadcast(stats)).withColumn("pred", F.col("__z") * F.col("__s") + F.col("__m")).drop("__m", "__s", "__z")  # one row
