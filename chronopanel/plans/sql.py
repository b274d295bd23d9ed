"""SQL building blocks of the oracle: the panels and series that most queries start from."""

from __future__ import annotations

import math
from collections.abc import Callable

PANEL = """panel AS (
  SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS close,
    max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

PRIO = """prio AS (
  SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS close,
    max(o_totalprice) AS high, min(o_totalprice) AS low, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""

INDEX = """days AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1),
idx AS (SELECT date, close, r FROM (SELECT *, ln(close / lag(close) OVER (ORDER BY date)) AS r FROM days) WHERE r IS NOT NULL)"""

RETURNS = """rets AS (
  SELECT *, CASE WHEN close / lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS log_return, row_number() OVER w AS pos
  FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date))"""

VOLATILITY = """vols AS (
  SELECT *, CASE WHEN count(log_return) OVER f >= 5 THEN ln(1 + sqrt(sum(log_return * log_return) OVER f)) END AS log_volatility
  FROM rets WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""

RANGE_SPLIT = """cut AS (SELECT min(date) AS lo, max(date) AS hi FROM vols),
parts AS (SELECT v.*, CASE WHEN date - DATE '1970-01-01' > (lo - DATE '1970-01-01') + (hi - lo) * 0.8 THEN 'test' ELSE 'train' END AS split FROM vols v, cut)"""

RESIDUALS = """numbered AS (
  SELECT date, r, row_number() OVER (ORDER BY date) - 1 AS i, avg(r) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM idx),
forecasts AS (
  SELECT *, last_value(CASE WHEN i >= 30 AND (i - 30) % 21 = 0 THEN m END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y_pred
  FROM numbered),
res AS (SELECT date, r AS y_true, y_pred, r - y_pred AS e, i - 30 AS k FROM forecasts WHERE i >= 30)"""


def with_(*parts: str, recursive: bool = False) -> str:
    """WITH all parts but the last, which is the query."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def r(x: str, name: str | None = None) -> str:
    """Rounded like columns.rounded: a little off ties, without negative zero."""
    return f"round({x} + 1.3e-9, 6) + 0.0 AS {name or x}"


def egarch_path(omega: float, alpha: tuple, gamma: tuple, beta: tuple, kappa: float) -> str:
    """path(k, ln): the log-variance recursion over res(k, e) with up to two lags of either kind."""
    a1, a2 = (*alpha, 0.0)[:2]
    g1, g2 = (*gamma, 0.0)[:2]
    b1, b2 = (*beta, 0.0)[:2]
    lead = max(len(alpha), len(beta))
    k2 = kappa if len(alpha) > 1 else 0.0
    nxt = f"{omega!r} + {b1!r} * s.ln + {b2!r} * s.ln1 + {a1!r} * (abs(s.z) - {kappa!r}) + {g1!r} * s.z + {a2!r} * (abs(s.z1) - {k2!r}) + {g2!r} * s.z1"
    return f"""start AS (SELECT ln(greatest(var_pop(e), 1e-10)) AS ln FROM res),
walk AS (
  SELECT res.k, start.ln, start.ln AS ln1, res.e / exp(start.ln / 2) AS z,
    (SELECT x.e FROM res x WHERE x.k = {max(lead - 2, 0)}) / exp(start.ln / 2) AS z1 FROM res, start WHERE res.k = {lead - 1}
  UNION ALL
  SELECT n.k, n.ln, n.ln1, n.e / exp(n.ln / 2), n.z1
  FROM (SELECT res.k, res.e, greatest(-300.0, least(300.0, {nxt})) AS ln, s.ln AS ln1, s.z AS z1 FROM walk s JOIN res ON res.k = s.k + 1) n),
path AS (SELECT k, ln FROM walk UNION ALL SELECT res.k, start.ln FROM res, start WHERE res.k < {lead - 1})"""


def integral(f: Callable[[str], str], upper: str, steps: int = 400) -> str:
    """Simpson's rule from 0 to upper; f makes SQL of a point."""
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({upper}) / {3 * steps} * list_sum([{weight} * {f(f'(({upper}) * i / {steps})')} for i in range(0, {steps + 1})]))"


def chi2_sf_1(x: str) -> str:
    """Upper tail of chi squared with one degree of freedom."""
    inner = integral(lambda u: f"exp(-{u} * {u} / 2)", f"sqrt(greatest({x}, 0.0))")
    return f"(1 - 2 * {inner} / sqrt(2 * pi()))"


def t_half(x: str, df: str) -> str:
    """Student probability between 0 and x >= 0."""
    inner = integral(lambda u: f"power(1 + {u} * {u} / ({df}), -(({df}) + 1) / 2.0)", x)
    return f"({inner} * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()))"


def unexplained(name: str, source: str, y: str, xs: list[str]) -> str:
    """CTEs name(n, rest): rows, and 1 - R2 of y on xs: what Schur complements of the correlations, y last, leave of y."""
    columns = [*xs, y]
    matrix = "[" + ", ".join("[" + ", ".join("1.0" if a == b else f"corr({a}, {b})" for b in columns) + "]" for a in columns) + "]"
    return f"""{name}_m AS (SELECT 1 AS k, count(*) AS n, {matrix} AS m FROM {source}),
{name}_s AS (
  SELECT * FROM {name}_m
  UNION ALL
  SELECT k + 1, n, [[m[i][j] - m[i][1] * m[1][j] / m[1][1] for j in range(2, len(m) + 1)] for i in range(2, len(m) + 1)] FROM {name}_s WHERE len(m) > 1),
{name} AS (SELECT n, m[1][1] AS rest FROM {name}_s WHERE len(m) = 1)"""


def eliminated(name: str, source: str) -> str:
    """CTE name(the columns of source, gone): Schur complements of the matrices m of source, column by column, down to two columns."""
    return f"""{name} AS (
  SELECT *, 0 AS gone FROM {source}
  UNION ALL
  SELECT * REPLACE ([[m[i][j] - m[i][1] * m[1][j] / m[1][1] for j in range(2, len(m) + 1)] for i in range(2, len(m) + 1)] AS m, gone + 1 AS gone) FROM {name} WHERE len(m) > 2)"""


def matrix(source: str, keys: str) -> str:
    """Matrices m of the sums s of source(keys, a, b, s), in the order of a and b."""
    return f"SELECT {keys}, list(r ORDER BY a) AS m FROM (SELECT {keys}, a, list(s ORDER BY b) AS r FROM {source} GROUP BY {keys}, a) GROUP BY {keys}"


def normal_cdf(x: str) -> str:
    return f"(0.5 + sign({x}) * {integral(lambda u: f'exp(-{u} * {u} / 2)', f'abs({x})')} / sqrt(2 * pi()))"


def chi2_sf_even(x: str, df: int) -> str:
    """Upper tail of chi squared with an even number of degrees of freedom."""
    return f"(exp(-({x}) / 2) * ({' + '.join(f'power(({x}) / 2, {i}) / {math.factorial(i)}' for i in range(df // 2))}))"


def f_sf(x: str, d1: int, d2: str) -> str:
    """Upper tail of the F distribution; the substitution u^2 keeps the integrand smooth at 0."""
    pdf = lambda u: f"2 * {u} * power({u} * {u}, {d1 / 2 - 1}) * power(1 + {d1} * {u} * {u} / ({d2}), -({d1} + ({d2})) / 2.0)"
    scale = f"power({d1}.0 / ({d2}), {d1 / 2}) * exp(lgamma(({d1} + ({d2})) / 2.0) - lgamma({d1} / 2.0) - lgamma(({d2}) / 2.0))"
    return f"(1 - {integral(pdf, f'sqrt({x})', 800)} * {scale})"


def text_key(*columns: str) -> str:
    """60 bits of the MD5 of the columns as text."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(columns)})), 1, 15) AS BIGINT)"


def poisson_weights(name: str, source: str, reps: int, seed: int) -> str:
    """CTE name(rep, w and the columns of source): Poisson(1) weights of each repetition by multilinear hashing of the column key."""
    coefficients = ", ".join(f"CAST('0x' || substr(h, {10 * i + 1}, 10) AS BIGINT) AS c{i}" for i in range(4))
    part = (1 << 20) - 1
    x = f"(key & {part}) * c0 + ((key >> 20) & {part}) * c1 + ((key >> 40) & {part}) * c2 + c3"
    least = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    counted = " + ".join(f"CAST(u >= {x!r}::DOUBLE AS INT)" for x in least)
    return f"""{name}_c AS (SELECT rep, {coefficients} FROM (SELECT rep, sha256(concat('{seed}|', rep)) AS h FROM (SELECT unnest(range(0, {reps})) AS rep))),
{name}_u AS (SELECT rep, s.*, CAST((({x}) & {(1 << 40) - 1}) >> 19 AS DOUBLE) / {1 << 21}.0 AS u FROM {source} s, {name}_c),
{name} AS (SELECT *, {counted} AS w FROM {name}_u)"""
