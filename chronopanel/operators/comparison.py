"""Comparison of forecasting models over one long table of predictions: metrics, pairwise tests, evaluation bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions import special

from . import diagnostics, evaluate

#: Pairs of ablations whose difference is of interest.
PAIRS = (
    ("complete", "without_insight"),
    ("technical_plus_insight", "technical_only"),
    ("log_volatility_plus_insight", "log_volatility_only"),
    ("complete", "log_volatility_only"),
    ("insight_only", "log_volatility_only"),
)


def metrics(predictions: DataFrame) -> DataFrame:
    """predictions: model, ticker, date, y, pred."""
    return evaluate.regression_metrics(predictions, "y", "pred", ("model",))


def pairwise(predictions: DataFrame, pairs: tuple[tuple[str, str], ...] = PAIRS) -> DataFrame:
    """a, b, n, mean_d, dm of each pair over the rows that both predict; pairs with a differing target are left out.

    Errors of all models of a row are gathered once (a few models), then each pair is an expression of that row.
    """
    rows = predictions.groupBy("ticker", "date").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("y", "pred")))).alias("m"))
    entry = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs)))
    both = rows.select("m", entry.alias("pair")).select(F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), F.try_element_at("m", F.col("pair.a")).alias("x"), F.try_element_at("m", F.col("pair.b")).alias("z"))
    both = both.filter("x.pred is not null and z.pred is not null")
    d = F.pow(F.col("x.y") - F.col("x.pred"), F.lit(2.0)) - F.pow(F.col("z.y") - F.col("z.pred"), F.lit(2.0))
    stats = both.withColumn("d", d).groupBy("a", "b").agg(F.count("d").alias("n"), F.avg("d").alias("mean_d"), F.var_samp("d").alias("v"), F.count_if(F.col("x.y") != F.col("z.y")).alias("differing"))
    dm = F.when(F.col("v") > 0, F.col("mean_d") / F.sqrt(F.col("v") / F.col("n"))).otherwise(0.0)
    return stats.filter("differing = 0").select("a", "b", "n", "mean_d", dm.alias("dm"))


def p_value(dm: float, n: int) -> float:
    """Two-sided: normal above 1000 rows, Student below."""
    return 2 * (1 - special.normal_cdf(abs(dm))) if n > 1000 else 2 * (1 - special.t_cdf(abs(dm), n - 1))


def verdicts(pairs: DataFrame) -> DataFrame:
    """p value and better model of the few pairs."""
    out = []
    for r in pairs.collect():
        p = p_value(r["dm"], r["n"])
        out.append((r["a"], r["b"], r["n"], r["mean_d"], r["dm"], p, "equal" if p >= 0.05 or not r["dm"] else r["a"] if r["dm"] < 0 else r["b"]))
    return pairs.sparkSession.createDataFrame(out, "a string, b string, n long, mean_d double, dm double, p_value double, better string")


def diagnostic_report(z: DataFrame, value: str = "z") -> dict:
    """All tests of a standardised residual series."""
    lb = lambda square: {r["lag"]: r["q"] for r in diagnostics.ljung_box(z, value, 20, square).collect() if r["lag"] in (10, 20)}
    box = {name: {k: {"q": q, "p_value": special.chi2_sf(q, k)} for k, q in lb(sq).items()} for name, sq in (("ljung_box", False), ("ljung_box_squared", True))}
    signs = {r["test"]: {"slope": r["slope"], "t": r["t"], "p_value": 2 * (1 - special.t_cdf(abs(r["t"]), r["n"] - 2))} for r in diagnostics.sign_bias(z, value).collect()}
    return {
        **box,
        "arch_lm": diagnostics.arch_lm(z, value),
        "breusch_pagan": diagnostics.trend_lm(z, value, 2),
        "white": diagnostics.trend_lm(z, value, 4),
        "moments": diagnostics.moments(z, value).first().asDict(),
        "jarque_bera": diagnostics.jarque_bera(z, value).first()["jb"],
        "sign_bias": signs,
        "joint_sign_bias": diagnostics.joint_sign_bias(z, value),
        "nyblom": diagnostics.nyblom(z, value).first()["nyblom"],
    }


def has_arch_effect(e: DataFrame, value: str = "e", lags: int = 12, alpha: float = 0.05) -> dict:
    """ARCH-LM below alpha, or any squared autocorrelation outside its band."""
    lm = diagnostics.arch_lm(e, value, lags)
    acf = diagnostics.autocorrelations(e, value, 20, square=True).collect()
    outside = [r["lag"] for r in acf if abs(r["r"]) > 1.96 / r["n"] ** 0.5]
    return {**lm, "significant_lags": outside, "arch_effect": lm["p_value"] < alpha or bool(outside)}


def calibrated_metrics(df: DataFrame) -> DataFrame:
    """Losses of forecasts before and after Mincer-Zarnowitz scaling."""
    fit = evaluate.mincer_zarnowitz(df).select("intercept", "slope")
    scaled = df.join(F.broadcast(fit)).withColumn("sigma2", evaluate.calibrated(F.col("sigma2"), F.col("intercept"), F.col("slope")))  # one row
    both = df.select(F.lit("plain").alias("kind"), "e", "sigma2").unionByName(scaled.select(F.lit("calibrated").alias("kind"), "e", "sigma2"))
    return evaluate.variance_losses(both, keys=("kind",))
