"""Walk-forward variance forecasts with refits: train by schedule, test continuing, with a log of fits; and model choice."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .egarch import Params, fit, qlike, step_log, variance_path, window_of

FORECAST = "series string, date date, split string, e double, sigma2 double, refit boolean, converged boolean, loglik double"


def schedule(start: int, end: int, every: int) -> list[int]:
    """Positions that refit; every 0 refits at start only."""
    return list(range(start, end, every)) if every > 0 else [start]


def forecaster(o: int = 1, p: int = 1, dist: str = "student", start: int = 250, every: int = 21, window: str = "expanding", size: int | None = None, frozen: bool = True, steps: int = 300) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For applyInPandas by series (series, date, split, e): one-step forecasts from row start on.

    Train rows refit by schedule. With frozen parameters the test rows use the last train fit, so nothing of them is learned;
    otherwise the schedule goes on.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        e, test = pdf["e"].to_numpy(float), (pdf["split"] == "test").to_numpy()
        due = set(schedule(start, len(e), every))
        rows, prm = [], None
        for t in range(start, len(e)):
            refit = prm is None or (t in due and not (frozen and test[t]))
            if refit:
                lo, hi = window_of(t, window, size)
                prm = fit(e[lo:hi], o, p, dist, steps)
                past = variance_path(e[lo:hi], prm)
                logs = [math.log(v) for v in past[::-1][: prm.p]]
                zs = list((e[lo:hi] / np.sqrt(past))[::-1][: prm.o])
            x = step_log(prm.omega, prm.alpha, prm.gamma, prm.beta, prm.kappa, logs, zs)
            s2 = max(math.exp(x), 1e-10)
            logs, zs = [x, *logs][: prm.p], [e[t] / math.sqrt(s2), *zs][: prm.o]
            rows.append((pdf.series[t], pdf.date[t], pdf.split[t], e[t], s2, refit, prm.converged, prm.loglik))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FORECAST.split(", ")])

    return run


def forecasts(df: DataFrame, **how) -> DataFrame:
    """df: series, date, split, e."""
    picked = df.select(F.col("series").cast("string").alias("series"), "date", "split", "e")
    return picked.groupBy("series").applyInPandas(forecaster(**how), FORECAST)


def convergence(found: DataFrame) -> DataFrame:
    """Refits and the share that converged, by series."""
    return found.filter("refit").groupBy("series").agg(F.count(F.lit(1)).alias("n_refits"), F.avg(F.col("converged").cast("int")).alias("convergence_rate"))


def log_sigma(found: DataFrame) -> DataFrame:
    """The learning feature: date, log of the forecast standard deviation."""
    return found.groupBy("date").agg((F.log(F.min("sigma2")) / 2).alias("log_sigma_garch"))


def search(df: DataFrame, trials: list[dict], start: int, steps: int = 100) -> DataFrame:
    """trial and QLIKE over one series, best first; a task a trial. Trials without a finite score come last."""
    spark = df.sparkSession
    rows = [(i, t.get("o", 1), t.get("p", 1), t.get("dist", "student"), t.get("refit", 21), t.get("window", "expanding"), t.get("size")) for i, t in enumerate(trials)]
    table = spark.createDataFrame(rows, "trial int, o int, p int, dist string, refit int, window string, size int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.iloc[0]
        size = int(t["size"]) if pd.notna(t["size"]) else None
        got = forecaster(int(t.o), int(t.p), t.dist, start, int(t.refit), t.window, size, False, steps)(pdf)
        score = qlike(got.e.to_numpy(), got.sigma2.to_numpy())
        return pd.DataFrame([{"trial": int(t.trial), "score": score if math.isfinite(score) else None}])

    wide = df.select(F.lit("s").alias("series"), "date", F.lit("train").alias("split"), "e").join(F.broadcast(table))  # a row a trial
    return wide.groupBy("trial").applyInPandas(run, "trial int, score double").orderBy(F.asc_nulls_last("score"), "trial")


def search_space(orders: tuple = (1, 2), dists: tuple = ("student", "skewt"), refits: tuple = (1, 5, 15, 21, 63), sizes: tuple = (500, 1000, 1500, 2000)) -> list[dict]:
    """All combinations of orders, distribution, refit frequency and window."""
    windows = [("expanding", None), *(("rolling", s) for s in sizes)]
    return [{"o": o, "p": p, "dist": d, "refit": r, "window": w, "size": s} for o in orders for p in orders for d in dists for r in refits for w, s in windows]


def with_params(prm: Params) -> Callable[[np.ndarray], Params]:
    return lambda _: prm
