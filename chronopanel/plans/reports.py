"""Queries on files, selections and guards, registered with the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronopanel.functions.columns import rounded
from chronopanel.operators import comparison, guards, selection, splits
from chronopanel.sources import files, panels
from chronopanel.sources.staging import fresh_path

from . import sql as S
from .catalog import _CENTRED, _LM, _MOM, _SIGN, PRM, _forecasts, _prio_residuals, _residuals, query

_ORDERS = "SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS ticker, round(o_totalprice + 1.3e-9, 6) + 0.0 AS price FROM orders WHERE o_totalprice IS NOT NULL"


@query(f"SELECT 'parquet' AS kind, * FROM ({_ORDERS}) UNION ALL SELECT 'csv', * FROM ({_ORDERS})")
def table_round_trip(spark, d):
    """Written as Parquet and CSV, read back with schema, dates, renames and required columns."""
    rows = panels.table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", "o_totalprice")
    stem = fresh_path(spark, "orders")
    files.write_both(rows, stem)
    renames = {"o_orderkey": "order_id", "o_orderpriority": "ticker", "o_totalprice": "price"}
    read = lambda kind: files.read_table(spark, f"{stem}.{kind}", schema=rows.schema, required=["order_id", "price"], dates=["day"], renames=renames, not_null=["price"], file_format=kind)
    both = read("parquet").withColumn("kind", F.lit("parquet")).unionByName(read("csv").withColumn("kind", F.lit("csv")))
    return rounded(both)


@query(S.with_(S.PANEL, "SELECT 'n_rows' AS name, count(*) AS value FROM panel UNION ALL SELECT 'n_tickers', count(DISTINCT ticker) FROM panel"))
def report_round_trip(spark, d):
    """A report as JSON, read back with required keys."""
    path = fresh_path(spark, "report")
    files.write_report(spark, files.fetch_report(panels.panel(spark, d)).first().asDict(), path)
    report = files.read_report(spark, path, ["n_rows", "n_tickers", "first_date"])
    return spark.createDataFrame([(k, int(report[k])) for k in ("n_rows", "n_tickers")], "name string, value long")


@query("SELECT DISTINCT trim(o_orderpriority) AS ticker FROM orders WHERE trim(o_orderpriority) <> ''")
def tickers_round_trip(spark, d):
    path = fresh_path(spark, "tickers")
    files.write_tickers(panels.table(spark, d, "orders").select(F.col("o_orderpriority").alias("ticker")), path)
    return files.read_tickers(spark, path)


_SPLIT = "s AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY date) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM idx)"


@query(S.with_(S.INDEX, _SPLIT, f"SELECT date, {S.r('r', 'weighted_log_return')} FROM s WHERE split = 'test'"))
def rows_of_split(spark, d):
    df = selection.by_split(splits.split_by_rows(panels.index(spark, d)), "test")
    return rounded(df.select("date", "weighted_log_return"))


@query(S.with_(S.PANEL, S.RETURNS, S.VOLATILITY, f"SELECT 'features' AS part, count(*) AS n, {S.r('avg(volume)', 'mean')} FROM vols WHERE log_volatility IS NOT NULL UNION ALL SELECT 'target', count(*), {S.r('avg(log_volatility)', 'm')} FROM vols WHERE log_volatility IS NOT NULL"))
def features_and_target(spark, d):
    """Inputs without date, ticker and target, and the target beside them, as sums of each."""
    from chronopanel.operators import features

    df = features.with_volatility(features.log_returns(panels.panel(spark, d))).filter("log_volatility is not null")
    inputs, target = selection.features_and_target(df)
    if {"date", "ticker", "log_volatility"} & set(inputs.columns) or target.columns != ["log_volatility"]:
        raise ValueError(f"inputs {inputs.columns}, target {target.columns}")
    summed = lambda part, name, column: part.agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean")).select(F.lit(name).alias("part"), "n", "mean")
    return rounded(summed(inputs, "features", "volume").unionByName(summed(target, "target", "log_volatility")))


@query(S.with_(S.INDEX, S.RESIDUALS, "SELECT * FROM (VALUES ('e', FALSE), ('none', TRUE)) t(\"column\", all_null)"))
def all_null_columns(spark, d):
    df = _residuals(spark, d).withColumn("none", F.lit(None).cast("double"))
    bad = guards.all_null_columns(df, ["e", "none"])
    return spark.createDataFrame([(c, c in bad) for c in ("e", "none")], "column string, all_null boolean")


@query(S.with_(S.INDEX, _SPLIT, f"SELECT split, date, {S.r('r', 'weighted_log_return')}, row_number() OVER (ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, date) AS position FROM s"))
def sorted_output(spark, d):
    """Train before test, then date: what a sink writes, with the position in the file."""
    df = splits.split_by_rows(panels.index(spark, d)).withColumn("ticker", F.lit("index"))
    path = fresh_path(spark, "sorted")
    selection.ordered_output(df.select("split", "date", "ticker", "weighted_log_return")).coalesce(1).write.parquet(path)
    back = spark.read.parquet(path).withColumn("position", F.monotonically_increasing_id() + 1)
    return rounded(back.select("split", "date", "weighted_log_return", "position"))


@query(S.with_(S.PANEL, f"SELECT date, ticker, {S.r('close')} FROM panel QUALIFY row_number() OVER (PARTITION BY date ORDER BY ticker) = 1"))
def first_of_each_date(spark, d):
    return rounded(selection.first_per_date(panels.panel(spark, d), "ticker").select("date", "ticker", "close"))


_SQUARES = "q AS (SELECT e * e AS y, lag(e * e) OVER (ORDER BY date) AS x FROM res), c AS (SELECT date, e * e - avg(e * e) OVER () AS x FROM res), s AS (SELECT count(*) AS n, sum(x * x) AS s0 FROM c), i AS (SELECT x, row_number() OVER (ORDER BY date) AS i FROM c), l AS (SELECT b.i - a.i AS lag, sum(a.x * b.x) AS sk FROM i a JOIN i b ON b.i > a.i AND b.i <= a.i + 20 GROUP BY 1), lm AS (SELECT count(x) * regr_r2(y, x) AS lm FROM q)"


@query(S.with_(S.INDEX, S.RESIDUALS, _SQUARES, f"SELECT {S.r('lm')}, {S.r(S.chi2_sf_1('lm'), 'p_value')}, (SELECT count(*) FROM l, s WHERE abs(sk / s0) > 1.96 / sqrt(n)) AS n_outside, {S.chi2_sf_1('lm')} < 0.05 OR (SELECT count(*) FROM l, s WHERE abs(sk / s0) > 1.96 / sqrt(n)) > 0 AS arch_effect FROM lm"))
def arch_effect(spark, d):
    got = comparison.has_arch_effect(_residuals(spark, d), "e", lags=1)
    return rounded(spark.createDataFrame([(float(got["lm"]), float(got["p_value"]), len(got["significant_lags"]), bool(got["arch_effect"]))], "lm double, p_value double, n_outside long, arch_effect boolean"))


def _figures(names: list[str], values: list[str]) -> str:
    return f"unnest([{', '.join(repr(n) for n in names)}]) AS figure, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in values)}]) AS value"


def _part(*parts: str) -> str:
    """A query over the standardised residuals in place of res."""
    return "(" + S.with_("res AS (SELECT * FROM zs)", *parts, recursive=True) + ")"


def _box_sql(name: str, of: str) -> str:
    ctes = _CENTRED.format(of) + ", qs AS (SELECT lag, n * (n + 2) * sum((sk / s0) * (sk / s0) / (n - lag)) OVER (ORDER BY lag) AS q FROM l, s)"
    return " UNION ALL ".join(_part(ctes, f"SELECT {_figures([f'{name}.{k}.q', f'{name}.{k}.p_value'], ['q', S.chi2_sf_even('q', k)])} FROM qs WHERE lag = {k}") for k in (10, 20))


def _slope_figures(c: str) -> str:
    t = f"regr_slope(y, {c}) / sqrt(regr_syy(y, {c}) * (1 - regr_r2(y, {c})) / (count(*) - 2) / regr_sxx(y, {c}))"
    fit = f"sf AS (SELECT regr_slope(y, {c}) AS slope, {t} AS t, count(*) AS n FROM sx)"
    return _part(_SIGN, fit, f"SELECT {_figures([f'sign_bias.{c}.{x}' for x in ('slope', 't', 'p_value')], ['slope', 't', '1 - 2 * ' + S.t_half('abs(t)', 'n - 2')])} FROM sf")


_REPORT = " UNION ALL ".join([
    _box_sql("ljung_box", "e"),
    _box_sql("ljung_box_squared", "(e * e)"),
    _part(*_LM, f"SELECT {_figures(['arch_lm.lm', 'arch_lm.df', 'arch_lm.p_value'], ['n * (1 - rest)', '12', S.chi2_sf_even('n * (1 - rest)', 12)])} FROM al"),
    _part(*_LM, f"SELECT {_figures(['breusch_pagan.lm', 'breusch_pagan.df', 'breusch_pagan.p_value'], ['lm', '2', 'exp(-lm / 2)'])} FROM bp"),
    _part(*_LM, f"SELECT {_figures(['white.lm', 'white.df', 'white.p_value'], ['n * (1 - rest)', '4', S.chi2_sf_even('n * (1 - rest)', 4)])} FROM wh"),
    _part(*_LM, f"SELECT {_figures(['joint_sign_bias.f', 'joint_sign_bias.df1', 'joint_sign_bias.df2', 'joint_sign_bias.p_value'], ['f', '3', 'd2', S.f_sf('f', 3, 'd2')])} FROM jf"),
    _part(_MOM, f"SELECT {_figures([f'moments.{x}' for x in ('n', 'mean', 'variance', 'std', 'skewness', 'kurtosis', 'beyond_2', 'beyond_3')] + ['jarque_bera'], ['n', 'mean', 'v', 'sqrt(v)', 'm3 / power(v, 1.5)', 'm4 / (v * v)', 'beyond_2', 'beyond_3', 'n / 6.0 * (m3 * m3 / (v * v * v) + power(m4 / (v * v) - 3, 2) / 4)'])} FROM mm"),
    *(_slope_figures(c) for c in ("negative", "negative_size", "positive_size")),
    _part("q AS (SELECT date, e * e AS q, e * e - avg(e * e) OVER () AS c FROM res), s AS (SELECT q, sum(c) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM q)", f"SELECT {_figures(['nyblom'], ['sum(s * s) / (count(*) * count(*) * var_samp(q))'])} FROM s"),
])


@query(S.with_(S.INDEX, S.RESIDUALS, S.egarch_path(PRM.omega, PRM.alpha, PRM.gamma, PRM.beta, PRM.kappa), "zs AS (SELECT res.date, res.k, res.e / exp(path.ln / 2) AS e FROM path JOIN res ON res.k = path.k WHERE res.k > 0)", f"SELECT figure, {S.r('value')} FROM ({_REPORT})", recursive=True))
def diagnostic_report(spark, d):
    """All tests of the standardised residuals, a row a figure; the tests themselves are queries of their own."""
    z = _forecasts(spark, d).filter("sigma2 is not null").select("date", (F.col("e") / F.sqrt("sigma2")).alias("z"))
    rows: list[tuple[str, float]] = []

    def walk(name: str, x) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(f"{name}.{k}" if name else str(k), v)
        elif x is not None:
            rows.append((name, float(x)))

    walk("", comparison.diagnostic_report(z))
    return rounded(spark.createDataFrame(rows, "figure string, value double"))


@query(S.with_(S.PRIO, "pr AS (SELECT ticker, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY date)) AS v FROM prio)", f"SELECT ticker AS series, count(v) AS n, {S.r('avg(v)', 'mean')}, {S.r('var_pop(v)', 'variance')}, {S.r('0.05 * ln(greatest(var_pop(v), 1e-10))', 'omega')} FROM pr WHERE v IS NOT NULL GROUP BY ticker"))
def egarch_starts(spark, d):
    """Where the likelihood search of each series begins: omega from its sample variance."""
    from chronopanel.operators.egarch import FLOOR

    v = F.var_pop("e")
    rows = _prio_residuals(spark, d).filter("e is not null").groupBy("series")
    return rounded(rows.agg(F.count("e").alias("n"), F.avg("e").alias("mean"), v.alias("variance"), (F.lit(0.05) * F.log(F.greatest(v, F.lit(FLOOR)))).alias("omega")))


@query(S.with_(S.PRIO, f"SELECT ticker, date, {S.r('close')}, volume FROM prio"))
def volume_from_base(spark, d):
    """The first table that exists has no volume, so the base's is joined."""
    whole, stem = panels.panel_prio(spark, d), fresh_path(spark, "quotes")
    whole.select("date", F.col("ticker").alias("tickers"), "close").write.parquet(f"{stem}-plain.parquet")
    whole.select("date", F.col("ticker").alias("tickers"), "volume").write.parquet(f"{stem}-base.parquet")
    df = files.first_available(spark, [f"{stem}-insights", f"{stem}-plain"], f"{stem}-base")
    return rounded(df.select("ticker", "date", "close", "volume"))


_BARRIER = """tb AS (SELECT ticker, date, close, max(close) OVER f AS hi, min(close) OVER f AS lo, lead(close, 6) OVER w IS NOT NULL AS whole FROM pv
  WINDOW w AS (PARTITION BY ticker ORDER BY date), f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
lb AS (SELECT ticker, date, CASE WHEN hi >= close * 1.02 THEN 1 WHEN lo <= close * 0.98 THEN -1 WHEN whole THEN 0 END AS label FROM tb)"""


@query(S.with_(
    S.PRIO,
    "pl AS (SELECT *, ln(close / lag(close) OVER w) AS r, lag(close) OVER w AS c1, lag(close, 2) OVER w AS c2, lag(close, 3) OVER w AS c3 FROM prio WINDOW w AS (PARTITION BY ticker ORDER BY date))",
    "pv AS (SELECT * FROM pl WHERE r IS NOT NULL AND c3 IS NOT NULL)",
    "pd AS (SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS k FROM (SELECT DISTINCT date FROM pv))",
    _BARRIER,
    "SELECT lb.ticker, lb.date, CAST(CASE WHEN n > floor(k * 0.8) THEN label END AS INT) AS triple_barrier_label, TRUE AS predicted FROM lb JOIN pd ON pd.date = lb.date",
))
def label_primary(spark, d):
    """A primary model of the return chosen over five time folds, its predictions, and barrier labels of the test rows."""
    from chronopanel.operators import features, models

    df = features.with_lags(features.log_returns(panels.panel_prio(spark, d)), ["log_return"], (1, 2))
    df = splits.split_by_distinct_dates(df.select("date", "ticker", "close", "log_return", "log_return_lag_1", "log_return_lag_2").na.drop())
    _, _, out = models.primary_labels(df, {"linear": {"regParam": (0.0, 0.1)}, "forest": {"maxDepth": (3,), "numTrees": (10,)}})
    return out.select("ticker", "date", "triple_barrier_label", F.col("primary_pred").isNotNull().alias("predicted"))


@query()
def shap_ranking(spark, d):
    """Shapley importances of a boosted model on the test rows."""
    from chronopanel.operators import attribution, models

    from .catalog import _SMALL, _model_table

    df = _model_table(spark, d)
    model = models.train(df.filter("split = 'train'"), _SMALL)
    return rounded(attribution.shap_importance(model, df.filter("split = 'test'")), 4)


@query("SELECT TRUE AS adds_up, CAST(0 AS BIGINT) AS n_off")
def shap_adds_up(spark, d):
    """Base and values of every test row add up to its forecast."""
    from chronopanel.operators import attribution, models

    from .catalog import _model_table

    df = _model_table(spark, d)
    model = models.train(df.filter("split = 'train'"), {"maxDepth": 3, "maxIter": 5})
    rows = attribution.shap_values(model, df.filter("split = 'test'"))
    off = F.abs(F.aggregate("values", F.col("base"), lambda a, v: a + v) - F.col("pred")) > 1e-9
    return rows.agg(F.count_if(off).alias("n_off")).select((F.col("n_off") == 0).alias("adds_up"), "n_off")
