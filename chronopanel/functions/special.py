"""Distribution functions for test statistics: evaluated on the driver for a few numbers, or inside grouped pandas."""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-300


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _invert(normal_cdf, p, -40.0, 40.0)


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or TINY)
        c = b + an / c or TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by the continued fraction that converges fast on either side of the mean."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            top = 1.0
        elif i % 2 == 0:
            top = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            top = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + top * d or TINY)
        c = 1 + top / c or TINY
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + x * x))
    return 1 - tail if x > 0 else tail


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda x: t_cdf(x, df), p, -1e6, 1e6)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1 is needed")
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def skewt_constants(nu: float, lam: float) -> tuple[float, float, float]:
    """a, b, c of Hansen's skewed t with unit variance."""
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2)))
    a = 4 * lam * c * (nu - 2) / (nu - 1)
    return a, math.sqrt(1 + 3 * lam * lam - a * a), c


def skewt_cdf(z: float, nu: float, lam: float) -> float:
    a, b, _ = skewt_constants(nu, lam)
    scale, x = math.sqrt(nu / (nu - 2)), b * z + a
    if z < -a / b:
        return (1 - lam) * t_cdf(scale * x / (1 - lam), nu)
    return (1 - lam) / 2 + (1 + lam) * (t_cdf(scale * x / (1 + lam), nu) - 0.5)


def skewt_ppf(q: float, nu: float, lam: float) -> float:
    a, b, _ = skewt_constants(nu, lam)
    scale = math.sqrt((nu - 2) / nu)
    if q < (1 - lam) / 2:
        return ((1 - lam) * scale * t_ppf(q / (1 - lam), nu) - a) / b
    return ((1 + lam) * scale * t_ppf((q + lam) / (1 + lam), nu) - a) / b


def kappa(dist: str, nu: float, lam: float | None = None) -> float:
    """Mean absolute value of a standardised innovation; the skewed one is an approximation of the reference figure."""
    k = math.sqrt(nu - 2) * math.exp(math.lgamma((nu - 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    return k * (1 + 0.1 * abs(lam or 0.0)) if dist == "skewt" else k


def quantile(dist: str, p: float, nu: float, lam: float | None = None) -> float:
    """Student quantiles are not scaled to unit variance, skewed ones are."""
    if nu <= 2.5:
        raise ValueError("nu must exceed 2.5")
    return skewt_ppf(p, nu, lam or 0.0) if dist == "skewt" else t_ppf(p, nu)


def beta_inc_array(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """beta_inc of many points at once."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    inside = np.clip(y, TINY, 1 - 1e-16)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(inside) + q * np.log1p(-inside)) / p
    f, c, d = np.ones_like(y), np.ones_like(y), np.zeros_like(y)
    for i in range(2000):
        m = i // 2
        if i == 0:
            top = np.ones_like(y)
        elif i % 2 == 0:
            top = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            top = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 + top * d
        d = 1 / np.where(d == 0, TINY, d)
        c = 1 + top / c
        c = np.where(c == 0, TINY, c)
        f = f * c * d
        if i and np.all(np.abs(c * d - 1) < 1e-15):
            break
    out = np.where(y <= 0, 0.0, front * (f - 1))
    return np.where(turned, 1 - out, out)


def t_cdf_array(x: np.ndarray, df: float) -> np.ndarray:
    x = np.asarray(x, float)
    tail = 0.5 * beta_inc_array(df / 2, 0.5, df / (df + x * x))
    return np.where(x > 0, 1 - tail, tail)


def t_ppf_array(p: np.ndarray, df: float) -> np.ndarray:
    """Quantiles of many probabilities: bisection in all of them at once."""
    p = np.asarray(p, float)
    lo, hi = np.full_like(p, -1e6), np.full_like(p, 1e6)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = t_cdf_array(mid, df) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def kolmogorov_sf(distance: float, n: int) -> float:
    """p value of a Kolmogorov-Smirnov distance: the limiting series at (sqrt n + 0.12 + 0.11 / sqrt n) times it."""
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * distance
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)))) if t > 0.2 else 1.0


#: MacKinnon's response surface of the unit-root t statistic for one series (small, large, least, greatest, switch).
MACKINNON = {
    "c": ((2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -18.83, 2.74, -1.61),
    "ct": ((3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285), -16.18, 0.7, -2.89),
}
#: Statistics of the level and trend stationarity test at 10, 5, 2.5 and 1 %.
KPSS_LEVELS = (0.1, 0.05, 0.025, 0.01)
KPSS_TABLE = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}


def mackinnon_p(t: float, trend: str = "c") -> float:
    small, large, least, greatest, switch = MACKINNON[trend]
    if t >= greatest or t <= least:
        return 1.0 if t >= greatest else 0.0
    return normal_cdf(sum(c * t**k for k, c in enumerate(small if t <= switch else large)))


def kpss_p(statistic: float, trend: str = "c") -> float:
    """By linear interpolation, within the table's 1 and 10 %."""
    return float(np.interp(statistic, KPSS_TABLE[trend], KPSS_LEVELS))
