"""Hypothesis tests of residual series: autocorrelation, heteroskedasticity, asymmetry, stability, normality, unit roots.

Sums over lags and regressors are aggregations; what is left for the driver is a handful of numbers: normal equations of
a few regressors, and p values. Unit-root searches over many regressions run in grouped pandas, a task a series.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions import special
from chronopanel.functions.ranks import before

from .features import by_date


def centred(df: DataFrame, value: str, square: bool = False) -> DataFrame:
    """date, x: the value (or its square) less its mean."""
    v = F.col(value) * F.col(value) if square else F.col(value)
    rows = df.filter(F.col(value).isNotNull()).select("date", v.alias("v"))
    return rows.withColumn("x", F.col("v") - F.avg("v").over(Window.partitionBy())).select("date", "x")


def autocorrelations(df: DataFrame, value: str, lags: int = 20, square: bool = False) -> DataFrame:
    """lag, r, n: sum x_t x_{t-k} over sum x^2, for k = 1 .. lags, in one pass."""
    w = by_date(None)
    rows = centred(df, value, square)
    rows = rows.select("x", *(F.lag("x", k).over(w).alias(f"x{k}") for k in range(1, lags + 1)))
    sums = rows.agg(F.count("x").alias("n"), F.sum(F.col("x") * F.col("x")).alias("s0"), *(F.sum(F.col("x") * F.col(f"x{k}")).alias(f"s{k}") for k in range(1, lags + 1)))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.col("s0")).alias("r")) for k in range(1, lags + 1))))
    return sums.select("n", pairs.alias("p")).select("p.lag", "p.r", "n")


def partial_autocorrelations(r: list[float]) -> list[float]:
    """Durbin-Levinson on r_1 .. r_k, clipped to [-1, 1]."""
    out, phi, den = [], [], 1.0
    for k, rk in enumerate(r):
        a = (rk - sum(p * r[k - 1 - i] for i, p in enumerate(phi))) / den if den else 0.0
        phi = [p - a * q for p, q in zip(phi, phi[::-1], strict=True)] + [a]
        den *= 1 - a * a
        out.append(max(-1.0, min(1.0, a)))
    return out


def ljung_box(df: DataFrame, value: str, lags: int = 20, square: bool = False) -> DataFrame:
    """lag, q: n (n + 2) times the running sum of r_k^2 / (n - k)."""
    w = Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    r = autocorrelations(df, value, lags, square)
    part = F.sum(F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))).over(w)
    return r.select("lag", (F.col("n") * (F.col("n") + 2) * part).alias("q"))


def with_chi2_p(df: DataFrame, statistic: str, freedom: str) -> DataFrame:
    rows = [(*r, special.chi2_sf(r[statistic], r[freedom])) for r in df.collect()]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", p_value double")


def gramian(df: DataFrame, y: Column, xs: list[Column]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """X'X (with a constant first), X'y, y'y and n of the complete rows, by one aggregation."""
    cols = [F.lit(1.0), *xs]
    rows = df.select(y.alias("__y"), *(c.alias(f"__x{i}") for i, c in enumerate(cols))).na.drop()
    k = len(cols)
    xy = [F.sum(F.col(f"__x{i}") * F.col("__y")) for i in range(k)]
    xx = [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")) for i in range(k) for j in range(i, k)]
    got = [float(v or 0.0) for v in rows.agg(F.count(F.lit(1)), F.sum(F.col("__y") * F.col("__y")), *xy, *xx).first()]
    g, at = np.zeros((k, k)), 2 + k
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = got[at]
            at += 1
    return g, np.array(got[2 : 2 + k]), got[1], int(got[0])


def ols(df: DataFrame, y: Column, xs: list[Column]) -> dict:
    """Coefficients, R2, residual sum of squares, standard errors and n."""
    g, xy, yy, n = gramian(df, y, xs)
    beta = np.linalg.lstsq(g, xy, rcond=None)[0]
    ssr = max(yy - float(beta @ xy), 0.0)
    sst = yy - xy[0] ** 2 / n
    dof = n - len(beta)
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(g)) * ssr / dof, 0)) if dof > 0 else np.full(len(beta), math.nan)
    return {"beta": beta, "r2": 1 - ssr / sst if sst > 0 else 0.0, "ssr": ssr, "sst": sst, "se": se, "n": n}


def arch_lm(df: DataFrame, value: str, lags: int = 12) -> dict:
    """(n - L) R2 of squared residuals on their L lags."""
    w = by_date(None)
    rows = df.select(F.col("date"), (F.col(value) * F.col(value)).alias("e2"))
    rows = rows.select("e2", *(F.lag("e2", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)))
    fit = ols(rows, F.col("e2"), [F.col(f"l{k}") for k in range(1, lags + 1)])
    lm = fit["n"] * fit["r2"]
    return {"lm": lm, "df": lags, "p_value": special.chi2_sf(lm, lags)}


def trend_lm(df: DataFrame, value: str, powers: int) -> dict:
    """n R2 of squared residuals on powers of time: 2 for Breusch-Pagan, 4 (standardised time) for White."""
    w = by_date(None)
    t = (F.row_number().over(w) - 1).cast("double")
    rows = df.filter(F.col(value).isNotNull()).select((F.col(value) * F.col(value)).alias("e2"), t.alias("t"))
    rows = rows.withColumn("t", (F.col("t") - F.avg("t").over(Window.partitionBy())) / F.stddev_pop("t").over(Window.partitionBy()))
    fit = ols(rows, F.col("e2"), [F.pow("t", F.lit(float(k))) for k in range(1, powers + 1)])
    lm = fit["n"] * fit["r2"]
    return {"lm": lm, "df": powers, "p_value": special.chi2_sf(lm, powers)}


def _signed(z: DataFrame, value: str) -> DataFrame:
    w = by_date(None)
    before = F.lag(value).over(w)
    rows = z.select("date", (F.col(value) * F.col(value)).alias("z2"), before.alias("b")).filter("b is not null")
    down = (F.col("b") < 0).cast("double")
    return rows.withColumn("negative", down).withColumn("negative_size", down * F.col("b")).withColumn("positive_size", (1 - down) * F.col("b"))


def sign_bias(z: DataFrame, value: str = "z") -> DataFrame:
    """test, slope, t of z^2 on the sign of the shock before, and on its size by sign."""
    rows = _signed(z, value)
    out = []
    for name in ("negative", "negative_size", "positive_size"):
        y, x = F.col("z2"), F.col(name)
        noise = F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2)
        fit = rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.count(F.lit(1)).alias("n"))
        out.append(fit.select(F.lit(name).alias("test"), "slope", (F.col("slope") / F.sqrt(noise / F.col("sxx"))).alias("t"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def joint_sign_bias(z: DataFrame, value: str = "z") -> dict:
    rows = _signed(z, value)
    fit = ols(rows, F.col("z2"), [F.col(c) for c in ("negative", "negative_size", "positive_size")])
    dof = fit["n"] - 4
    f = ((fit["sst"] - fit["ssr"]) / 3) / (fit["ssr"] / dof)
    return {"f": f, "df1": 3, "df2": dof, "p_value": special.f_sf(f, 3, dof)}


def nyblom(z: DataFrame, value: str = "z") -> DataFrame:
    """Sum of squared running sums of z^2 less its mean, over n^2 times its variance."""
    w = by_date(None)
    rows = z.select("date", (F.col(value) * F.col(value)).alias("q"))
    rows = rows.withColumn("c", F.col("q") - F.avg("q").over(Window.partitionBy()))
    rows = rows.withColumn("s", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.agg((F.sum(F.col("s") * F.col("s")) / (F.count(F.lit(1)) * F.count(F.lit(1)) * F.var_samp("q"))).alias("nyblom"), F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, variance and standard deviation of the population, skewness, fourth standardised moment, counts beyond 2 and 3."""
    v = F.col(value)
    return df.filter(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skewness"), (F.kurtosis(v) + 3).alias("kurtosis"),
        F.count_if(F.abs(v) > 2).alias("beyond_2"), F.count_if(F.abs(v) > 3).alias("beyond_3"),
    )


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    m = moments(df, value)
    k = F.col("kurtosis") - 3
    return m.select("n", "skewness", "kurtosis", (F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + k * k / 4)).alias("jb"))


def ranked(df: DataFrame, value: str) -> DataFrame:
    """value, position (from 1, equal values numbered on), n."""
    counts = before(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias(value)).agg(F.count(F.lit(1)).alias("__n")), value, "__n")
    total = counts.agg(F.sum("__n").alias("n"))
    each = counts.select(value, F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("__n"))).alias("position"))
    return each.join(F.broadcast(total))  # one row


def ranked_quantiles(df: DataFrame, value: str) -> DataFrame:
    """position, value, probability (i - 0.5) / n of the sorted values."""
    return ranked(df, value).select("position", value, ((F.col("position") - 0.5) / F.col("n")).alias("probability"))


def qq_table(df: DataFrame, value: str, ppf: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """ranked_quantiles with the theoretical quantile of each probability; ppf takes an Arrow batch at a time."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(theoretical=ppf(pdf["probability"].to_numpy(float)))

    return ranked_quantiles(df, value).mapInPandas(run, f"position long, {value} double, probability double, theoretical double")


def kolmogorov_smirnov(df: DataFrame, value: str, cdf: Callable[[np.ndarray], np.ndarray]) -> dict:
    """distance (the largest of the empirical from the given distribution function), n and p_value; cdf takes an Arrow batch at a time."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(f=cdf(pdf[value].to_numpy(float)))

    rows = ranked(df, value).select(value, "position", "n").mapInPandas(run, f"{value} double, position long, n long, f double")
    i = F.col("position")
    got = rows.agg(F.max(F.greatest(F.abs(i / F.col("n") - F.col("f")), F.abs((i - 1) / F.col("n") - F.col("f")))).alias("distance"), F.count(F.lit(1)).alias("n")).first()
    return {"distance": got["distance"], "n": got["n"], "p_value": special.kolmogorov_sf(got["distance"], got["n"])}


def _regress(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    s2 = float(e @ e) / (len(y) - x.shape[1])
    return beta, np.sqrt(np.diag(np.linalg.pinv(x.T @ x)) * s2), float(e @ e)


def adf_statistic(y: np.ndarray, max_lags: int | None = None, trend: str = "c") -> tuple[float, int]:
    """t statistic of the lagged level with a constant (ct: and a trend); lags by least AIC on a common sample."""
    n = len(y)
    top = max_lags if max_lags is not None else min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    d = np.diff(y)

    def design(lags: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        rows = range(start, len(d))
        slope = [np.arange(len(rows), dtype=float)] if trend == "ct" else []
        x = np.column_stack([np.ones(len(rows)), y[start : len(d)], *(d[start - i : len(d) - i] for i in range(1, lags + 1)), *slope])
        return d[start:], x

    def aic(lags: int) -> float:
        target, x = design(lags, top)
        rss = _regress(target, x)[2]
        return len(target) * math.log(rss / len(target)) + 2 * x.shape[1]

    best = min(range(top + 1), key=aic)
    target, x = design(best, best)
    beta, se, _ = _regress(target, x)
    return float(beta[1] / se[1]), best


#: Fixed value: 5 % critical value of the test with a break in the level.
ZIVOT_ANDREWS_5 = -4.93


def kpss_statistic(y: np.ndarray, trend: str = "c") -> float:
    """Stationarity around a level (ct: a trend) with a Bartlett kernel of 12 (n / 100)^(1/4) lags."""
    n = len(y)
    t = np.arange(n, dtype=float)
    e = y - (np.polyval(np.polyfit(t, y, 1), t) if trend == "ct" else y.mean())
    lags = min(int(math.ceil(12 * (n / 100) ** 0.25)), n - 1)
    s2 = float(e @ e) / n + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return float(np.sum(np.cumsum(e) ** 2) / (n * n * s2))


def zivot_andrews(y: np.ndarray, trim: float = 0.15, lags: int = 1) -> tuple[float, int]:
    """Least t statistic over breaks in the level, and the break's position."""
    n, d = len(y), np.diff(y)
    best = (math.inf, -1)
    t = np.arange(lags, len(d))
    base = np.column_stack([np.ones(len(t)), t, y[lags : len(d)], *(d[lags - i : len(d) - i] for i in range(1, lags + 1))])
    for k in range(int(trim * n), int((1 - trim) * n)):
        x = np.column_stack([base, (t >= k).astype(float)])
        beta, se, _ = _regress(d[lags:], x)
        best = min(best, (float(beta[2] / se[2]), k))
    return best


def stationarity(df: DataFrame, value: str = "value", trend: str = "c", alpha: float = 0.05) -> DataFrame:
    """A row a series: statistics and p values, and whether the unit root is rejected at alpha while stationarity is not.

    df: series, date, value; trend: c (a level) or ct (a trend). Series of fewer than 20 values have nulls.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")[value].dropna().to_numpy(float)
        row = {"series": pdf.series.iloc[0], "n": len(y)}
        if len(y) >= 20:
            adf, lags = adf_statistic(y, trend=trend)
            kpss = kpss_statistic(y, trend)
            za, at = zivot_andrews(y)
            p_adf, p_kpss = special.mackinnon_p(adf, trend), special.kpss_p(kpss, trend)
            row |= {"adf": adf, "adf_lags": lags, "adf_p": p_adf, "kpss": kpss, "kpss_p": p_kpss, "zivot_andrews": za, "break_at": at, "break_rejects": za < ZIVOT_ANDREWS_5, "stationary": p_adf < alpha <= p_kpss}
        return pd.DataFrame([row], columns=[x.split()[0] for x in schema.split(", ")])

    schema = "series string, n int, adf double, adf_lags int, adf_p double, kpss double, kpss_p double, zivot_andrews double, break_at int, break_rejects boolean, stationary boolean"
    picked = df.select(F.col("series").cast("string").alias("series"), "date", F.col(value).cast("double").alias(value))
    return picked.groupBy("series").applyInPandas(run, schema)


def anderson_darling(x: np.ndarray) -> float:
    z = np.sort((x - x.mean()) / x.std(ddof=1))
    n = len(z)
    f = np.clip([special.normal_cdf(v) for v in z], 1e-15, 1 - 1e-15)
    i = np.arange(1, n + 1)
    return float(-n - np.sum((2 * i - 1) * (np.log(f) + np.log(1 - f[::-1]))) / n)


def shapiro_francia(x: np.ndarray) -> float:
    """Squared correlation of the sorted values with normal scores, the large-sample form of Shapiro-Wilk."""
    z, n = np.sort(x), len(x)
    m = np.array([special.normal_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return float(np.corrcoef(z, m)[0, 1] ** 2)


def normality(df: DataFrame, value: str = "value") -> DataFrame:
    """A row a series; fewer than three values give null statistics."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[value].dropna().to_numpy(float)
        ok = len(x) >= 3 and x.std() > 0
        return pd.DataFrame([{"series": pdf.series.iloc[0], "n": len(x), "anderson_darling": anderson_darling(x) if ok else None, "shapiro_francia": shapiro_francia(x) if ok else None}])

    return df.select(F.col("series").cast("string").alias("series"), F.col(value).cast("double").alias(value)).groupBy("series").applyInPandas(run, "series string, n int, anderson_darling double, shapiro_francia double")
