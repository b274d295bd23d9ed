"""Asymmetric conditional variance: the log-variance recursion, its likelihood, fits, forecasts and validation.

ln s2_t = omega + sum_j beta_j ln s2_{t-j} + sum_i [alpha_i (|z_{t-i}| - kappa) + gamma_i z_{t-i}], z = e / s. The first max(o, p)
values are the population variance of the input (or a given one); s2 has a floor and ln s2 a bound. The recursion is
sequential within a series, so it runs in grouped pandas, many series in parallel; a one-series scan with aggregate() serves
short series without Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions import special

FLOOR, BOUND = 1e-10, 300.0
EPS = 1e-12


@dataclass
class Params:
    omega: float
    alpha: tuple[float, ...]
    gamma: tuple[float, ...]
    beta: tuple[float, ...]
    nu: float = 8.0
    lam: float | None = None
    dist: str = "student"
    loglik: float | None = None
    converged: bool = True
    extra: dict = field(default_factory=dict)

    @property
    def o(self) -> int:
        return len(self.alpha)

    @property
    def p(self) -> int:
        return len(self.beta)

    @property
    def kappa(self) -> float:
        return special.kappa(self.dist, self.nu, self.lam)

    def is_stationary(self) -> bool:
        return abs(sum(self.beta)) < 1

    def as_row(self) -> dict:
        row = asdict(self)
        row.pop("extra")
        return row


def step_log(omega: float, alpha: tuple, gamma: tuple, beta: tuple, kappa: float, logs: list[float], zs: list[float]) -> float:
    """Next ln s2 from the newest-first logs and standardised shocks."""
    x = omega + sum(b * v for b, v in zip(beta, logs, strict=False)) + sum(a * (abs(z) - kappa) + g * z for a, g, z in zip(alpha, gamma, zs, strict=False))
    return max(-BOUND, min(BOUND, x))


def variance_path(e: np.ndarray, prm: Params, init: float | None = None) -> np.ndarray:
    """s2 of each row; all NaN as soon as a value is not finite."""
    n, lead, kappa = len(e), max(prm.o, prm.p), prm.kappa
    s2 = np.empty(n)
    first = init if init and init > 0 else max(float(np.var(e)) if n else FLOOR, FLOOR)
    s2[:lead] = first
    logs = np.full(n, math.log(first))
    z = np.full(n, 0.0)
    z[:lead] = e[:lead] / math.sqrt(first)
    omega, alpha, gamma, beta = prm.omega, prm.alpha, prm.gamma, prm.beta
    for t in range(lead, n):
        x = omega
        for j, b in enumerate(beta):
            x += b * logs[t - 1 - j]
        for i, a in enumerate(alpha):
            zi = z[t - 1 - i]
            x += a * (abs(zi) - kappa) + gamma[i] * zi
        if not math.isfinite(x):
            return np.full(n, np.nan)
        x = max(-BOUND, min(BOUND, x))
        v = max(math.exp(x), FLOOR)
        s2[t], logs[t], z[t] = v, math.log(v), e[t] / math.sqrt(v)
    return s2


def filtered(df: DataFrame, prm: Params, series: str = "series", value: str = "e", order: str = "date") -> DataFrame:
    """df's series, order and value with sigma2, sigma and z, one task a series."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        e = pdf[value].to_numpy(float)
        s2 = variance_path(e, prm)
        return pdf.assign(sigma2=s2, sigma=np.sqrt(s2), z=e / np.sqrt(s2))

    picked = df.select(series, order, value)
    return picked.groupBy(series).applyInPandas(run, f"{series} {types[series]}, {order} {types[order]}, {value} double, sigma2 double, sigma double, z double")


def one_step(e_last: Column, s2_last: Column, prm: Params) -> Column:
    """Next variance from the last shock and variance (o = p = 1)."""
    z = e_last / F.sqrt(F.greatest(s2_last, F.lit(FLOOR)))
    x = F.lit(prm.omega) + F.lit(prm.beta[0]) * F.log(F.greatest(s2_last, F.lit(FLOOR))) + F.lit(prm.alpha[0]) * (F.abs(z) - F.lit(prm.kappa)) + F.lit(prm.gamma[0]) * z
    return F.greatest(F.exp(F.least(F.greatest(x, F.lit(-BOUND)), F.lit(BOUND))), F.lit(FLOOR))


def multi_step(state: DataFrame, horizon: int, prm: Params) -> DataFrame:
    """h, sigma2 for h = 1 .. horizon: ln s2 = omega + beta ln s2 from s2_last; the last shock has no part in it."""
    b = prm.beta[0]
    h = F.col("h")
    power = F.pow(F.lit(b), h)
    total = F.lit(prm.omega) * ((F.lit(1.0) - power) / F.lit(1 - b)) if b != 1 else F.lit(prm.omega) * h
    ln = power * F.log(F.greatest("s2_last", F.lit(FLOOR))) + total
    return state.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn("sigma2", F.exp(ln))


def forecast_table(state: DataFrame, horizon: int, prm: Params, level: float = 0.95, mean: float = 0.0) -> DataFrame:
    """h, sigma2, sigma, interval bounds and value at risk of each horizon."""
    lo, hi = (special.quantile(prm.dist, p, prm.nu, prm.lam) for p in ((1 - level) / 2, 1 - (1 - level) / 2))
    var = special.quantile(prm.dist, 1 - level, prm.nu, prm.lam)
    sigma = F.sqrt("sigma2")
    return multi_step(state, horizon, prm).select("h", "sigma2", sigma.alias("sigma"), (F.lit(mean) + sigma * lo).alias("pi_low"), (F.lit(mean) + sigma * hi).alias("pi_high"), (F.lit(mean) + sigma * var).alias("value_at_risk"))


def fast_forecasts(df: DataFrame, prm: Params, series: str = "series") -> DataFrame:
    """s2 forecast of each row from the row before: one scan, the path starts once."""
    from pyspark.sql import Window

    w = Window.partitionBy(series).orderBy("date")
    path = filtered(df, prm, series)
    return path.withColumn("forecast", F.lag(one_step(F.col("e"), F.col("sigma2"), prm)).over(w)).select(series, "date", "e", "forecast")


def exact_forecasts(prm: Params, start: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas by series: at t the last element of the path over the rows before t, begun anew at each t."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        e = pdf["e"].to_numpy(float)
        out = [variance_path(e[:t], prm)[-1] for t in range(start, len(e))]
        return pdf.iloc[start:].assign(forecast=out)[["series", "date", "e", "forecast"]]

    return run


def loglik(e: np.ndarray, s2: np.ndarray, dist: str, nu: float, lam: float | None = None) -> float:
    if nu <= 2 or not np.all(np.isfinite(s2)) or np.any(s2 <= 0):
        return -math.inf
    if dist == "skewt":
        a, b, c = special.skewt_constants(nu, lam or 0.0)
        z = e / np.sqrt(s2)
        side = np.where(z < -a / b, 1 - (lam or 0.0), 1 + (lam or 0.0))
        return float(np.sum(math.log(b * c) - 0.5 * np.log(s2) - 0.5 * (nu + 1) * np.log1p(((b * z + a) / side) ** 2 / (nu - 2))))
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    return float(np.sum(const - 0.5 * np.log(s2) - 0.5 * (nu + 1) * np.log1p(e * e / (s2 * (nu - 2)))))


def student_loglik(path: DataFrame, nu: float, series: str = "series") -> DataFrame:
    """series, n, loglik of a filtered path (columns e, sigma2) under Student innovations, as one aggregation."""
    const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
    term = F.lit(const) - F.log("sigma2") / 2 - F.lit(0.5 * (nu + 1)) * F.log1p(F.col("e") * F.col("e") / (F.col("sigma2") * F.lit(nu - 2)))
    return path.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.sum(term).alias("loglik"))


def to_params(x: np.ndarray, o: int, p: int, dist: str) -> Params:
    at = 1 + 2 * o + p
    return Params(x[0], tuple(x[1 : 1 + o]), tuple(x[1 + o : 1 + 2 * o]), tuple(x[1 + 2 * o : at]), x[at], x[at + 1] if dist == "skewt" else None, dist)


def start_vector(e: np.ndarray, o: int, p: int, dist: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and bounds: omega from the sample variance, the first beta near one, the rest small."""
    v = max(float(np.var(e)), FLOOR)
    x = [(1 - 0.95) * math.log(v)] + [0.1] + [0.01] * (o - 1) + [0.0] * o + [0.95] + [0.01] * (p - 1) + [8.0]
    lo = [-5.0] + [-1.0] * (2 * o) + [-0.999] * p + [2.6]
    hi = [5.0] + [1.0] * (2 * o) + [0.999] * p + [100.0]
    if dist == "skewt":
        x, lo, hi = [*x, -0.1], [*lo, -0.98], [*hi, 0.98]
    return np.array(x), np.array(lo), np.array(hi)


def minimise(f: Callable[[np.ndarray], float], x: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: int = 600, tol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """Downhill simplex with the points kept inside the bounds."""
    n = len(x)
    clip = lambda v: np.minimum(np.maximum(v, lo), hi)
    points = [clip(x)] + [clip(x + np.eye(n)[i] * (0.1 * abs(x[i]) + 0.05)) for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values, kind="stable")
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < tol * (1 + abs(values[0])):
            return points[0], values[0], True
        centre = np.mean(points[:-1], axis=0)
        away = clip(centre + (centre - points[-1]))
        fa = f(away)
        if fa < values[0]:
            far = clip(centre + 2 * (centre - points[-1]))
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < fa else (away, fa)
        elif fa < values[-2]:
            points[-1], values[-1] = away, fa
        else:
            near = clip(centre + 0.5 * ((away if fa < values[-1] else points[-1]) - centre))
            fn = f(near)
            if fn < min(fa, values[-1]):
                points[-1], values[-1] = near, fn
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best], False


def fit(e: np.ndarray, o: int = 1, p: int = 1, dist: str = "student", steps: int = 600) -> Params:
    """Maximum likelihood within bounds."""
    x, lo, hi = start_vector(e, o, p, dist)

    def cost(v: np.ndarray) -> float:
        prm = to_params(v, o, p, dist)
        if abs(sum(prm.beta)) >= 0.9999:
            return 1e50
        value = -loglik(e, variance_path(e, prm), dist, prm.nu, prm.lam)
        return value if math.isfinite(value) else 1e50

    best, value, good = minimise(cost, x, lo, hi, steps)
    prm = to_params(best, o, p, dist)
    prm.loglik, prm.converged = -value, good
    return prm


FIT_SCHEMA = "series string, dist string, o int, p int, omega double, alpha array<double>, gamma array<double>, beta array<double>, nu double, lam double, loglik double, aic double, bic double, converged boolean, n int"


def fit_rows(df: DataFrame, specs: list[tuple[int, int, str]] = ((1, 1, "student"), (1, 1, "skewt")), steps: int = 600) -> DataFrame:
    """A fit for each series and specification; both are dealt over the cluster. df: series, date, e."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(specs), "o int, p int, dist string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        e = pdf["e"].dropna().to_numpy(float)
        first = pdf.iloc[0]
        prm = fit(e, int(first.o), int(first.p), first.dist, steps)
        k = 2 + 2 * prm.o + prm.p + (prm.dist == "skewt")
        return pd.DataFrame([{"series": first.series, "dist": prm.dist, "o": prm.o, "p": prm.p, "omega": prm.omega, "alpha": list(prm.alpha), "gamma": list(prm.gamma), "beta": list(prm.beta), "nu": prm.nu, "lam": prm.lam, "loglik": prm.loglik, "aic": 2 * k - 2 * prm.loglik, "bic": k * math.log(len(e)) - 2 * prm.loglik, "converged": prm.converged, "n": len(e)}])

    wide = df.select(F.col("series").cast("string").alias("series"), "date", "e").join(F.broadcast(table))  # a few specifications
    return wide.groupBy("series", "o", "p", "dist").applyInPandas(run, FIT_SCHEMA)


def best_fit(fits: DataFrame) -> DataFrame:
    """Of each series the converged fit of least AIC; ties by distribution name."""
    from .cleaning import keep_one

    return keep_one(fits.filter("converged"), ["series"], [F.col("aic"), F.col("dist"), F.col("o"), F.col("p")])


def qlike(e: np.ndarray, s2: np.ndarray) -> float:
    ok = np.isfinite(e) & np.isfinite(s2) & (s2 > 0)
    return float(np.mean(np.log(s2[ok]) + e[ok] ** 2 / s2[ok])) if ok.any() else math.nan


def window_of(position: int, kind: str, size: int | None) -> tuple[int, int]:
    return (0, position) if kind == "expanding" else (max(0, position - (size or position)), position)


def walk_forward(prm_of: Callable[[np.ndarray], Params], e: np.ndarray, start: int, every: int, kind: str = "expanding", size: int | None = None) -> np.ndarray:
    """One-step forecasts from start on; parameters come from the latest refit, the state is carried from row to row."""
    out, prm = np.full(len(e), np.nan), None
    for t in range(start, len(e)):
        if prm is None or (every > 0 and (t - start) % every == 0):
            lo, hi = window_of(t, kind, size)
            prm = prm_of(e[lo:hi])
            past = variance_path(e[lo:hi], prm)
            logs, zs = [math.log(v) for v in past[::-1][: prm.p]], list((e[lo:hi] / np.sqrt(past))[::-1][: prm.o])
        x = step_log(prm.omega, prm.alpha, prm.gamma, prm.beta, prm.kappa, logs, zs)
        out[t] = max(math.exp(x), FLOOR)
        logs, zs = [x, *logs][: prm.p], [e[t] / math.sqrt(out[t]), *zs][: prm.o]
    return out


def validation_grid(df: DataFrame, trials: list[dict], burn_in: float = 0.17, least: int = 20, worst: float = 100.0, steps: int = 200) -> DataFrame:
    """trial, fold, score: QLIKE of each trial's folds over one series, a task a trial. Folds of fewer than least rows or a score above worst are left out.

    A trial: o, p, dist, refit, window ('expanding' or 'rolling'), size.
    """
    spark = df.sparkSession
    rows = [(i, t["o"], t["p"], t["dist"], t["refit"], t.get("window", "expanding"), t.get("size")) for i, t in enumerate(trials)]
    table = spark.createDataFrame(rows, "trial int, o int, p int, dist string, refit int, window string, size int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        e, t = pdf["e"].to_numpy(float), pdf.iloc[0]
        size = int(t["size"]) if pd.notna(t["size"]) else None
        out, refit = [], int(t.refit)
        for fold, start in enumerate(range(int(len(e) * burn_in), len(e), refit)):
            stop = min(start + refit, len(e))
            if stop - start < least:
                continue
            s2 = walk_forward(lambda x: fit(x, int(t.o), int(t.p), t.dist, steps), e[:stop], start, 0, t.window, size)
            score = qlike(e[start:stop], s2[start:stop])
            if math.isfinite(score) and score <= worst:
                out.append((int(t.trial), fold, score))
        return pd.DataFrame(out, columns=["trial", "fold", "score"])

    wide = df.select("date", "e").join(F.broadcast(table))  # a row a trial
    return wide.groupBy("trial").applyInPandas(run, "trial int, fold int, score double")
