"""Distribution functions against known values and inverses, and column rules."""

import math
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronopanel.functions import columns, special


@pytest.mark.parametrize(("x", "df", "p"), [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2(x, df, p):
    assert special.chi2_sf(x, df) == pytest.approx(p, abs=1e-6)


@pytest.mark.parametrize(("p", "df", "x"), [(0.975, 10, 2.228139), (0.95, 5, 2.015048), (0.01, 8, -2.896459)])
def test_student(p, df, x):
    assert special.t_ppf(p, df) == pytest.approx(x, abs=1e-5)
    assert special.t_cdf(x, df) == pytest.approx(p, abs=1e-6)


def test_f_and_normal():
    assert special.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert special.chi2_sf(2.5, 1) == pytest.approx(math.erfc(math.sqrt(1.25)))


@settings(max_examples=25, deadline=None)
@given(st.floats(0.01, 0.99), st.floats(2.6, 40), st.floats(-0.9, 0.9))
def test_skewed_quantiles_invert(p, nu, lam):
    assert special.skewt_cdf(special.skewt_ppf(p, nu, lam), nu, lam) == pytest.approx(p, abs=1e-6)


def test_skewed_without_skew_is_scaled_student():
    assert special.skewt_ppf(0.05, 8, 0.0) == pytest.approx(special.t_ppf(0.05, 8) * math.sqrt(6 / 8), abs=1e-8)


def test_kappa_and_bounds():
    assert special.kappa("student", 1e6) == pytest.approx(math.sqrt(2 / math.pi), abs=1e-5)
    assert special.kappa("skewt", 8, -0.3) == pytest.approx(1.03 * special.kappa("student", 8))
    with pytest.raises(ValueError, match="nu"):
        special.quantile("student", 0.05, 2.0)


def test_column_rules(spark):
    df = spark.createDataFrame([(1.0, 2.0, "A.B"), (0.0, 0.0, None), (-1.0, 1.0, ""), (float("inf"), 1.0, "x"), (float("nan"), 1.0, " y ")], "a double, b double, s string")
    rows = df.select(columns.finite(F.col("a")).alias("f"), columns.log_ratio(F.col("a"), F.col("b")).alias("r"), columns.log1p_clamped(F.col("a")).alias("l"), columns.crc_code(F.col("s")).alias("c"), columns.normalised_ticker(F.col("s")).alias("t")).collect()
    assert [r["f"] for r in rows] == [1.0, 0.0, -1.0, None, None]
    assert [r["r"] for r in rows] == [pytest.approx(math.log(0.5)), None, None, None, None]
    assert rows[2]["l"] == 0.0
    assert [r["c"] for r in rows] == [zlib.crc32((s or "").encode()) & 0x7FFFFFFF for s in ("A.B", None, "", "x", " y ")]
    assert [r["t"] for r in rows] == ["A-B", None, "", "x", "y"]


def test_week_ends_on_sunday(spark):
    rows = spark.sql("SELECT DATE'2024-01-07' + i AS d FROM (SELECT explode(sequence(0, 13)) AS i)").select("d", columns.week_end(F.col("d")).alias("w")).collect()
    assert all(r["w"].isoweekday() == 7 and 0 <= (r["w"] - r["d"]).days < 7 for r in rows)


def test_distribution_functions_of_arrays():
    import numpy as np

    x = np.concatenate([np.linspace(-12, 12, 49), [0.0, 1e-9, 300.0, -300.0]])
    for nu in (2.7, 7.3, 40.0):
        np.testing.assert_allclose(special.t_cdf_array(x, nu), [special.t_cdf(float(v), nu) for v in x], atol=1e-13)
        p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999])
        np.testing.assert_allclose(special.t_ppf_array(p, nu), [special.t_ppf(float(v), nu) for v in p], rtol=1e-9, atol=1e-9)


def test_p_values_of_unit_root_tests():
    assert special.mackinnon_p(-2.861) == pytest.approx(0.05, abs=2e-3) and special.mackinnon_p(-3.43) == pytest.approx(0.01, abs=1e-3)
    assert special.mackinnon_p(-3.41, "ct") == pytest.approx(0.05, abs=2e-3)
    assert special.mackinnon_p(5.0) == 1.0 and special.mackinnon_p(-30.0) == 0.0
    assert special.kpss_p(0.463) == 0.05 and special.kpss_p(0.146, "ct") == 0.05
    assert special.kpss_p(9.0) == 0.01 and special.kpss_p(0.0) == 0.1
    assert special.kolmogorov_sf(1.36 / 1000**0.5, 1000) == pytest.approx(0.05, abs=2e-3) and special.kolmogorov_sf(1e-6, 100) == 1.0
