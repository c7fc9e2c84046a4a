"""p-values of t and F statistics, for the few rows that hold test results.

Moments come from Spark aggregates; only the regularised incomplete beta function is
evaluated here, by the continued fraction of the Digital Library of Mathematical
Functions, 8.17.22.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_gamma_step(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)); by Stirling's series where the plain difference would cancel."""
    if a < 1e4:
        return math.lgamma(a + b) - math.lgamma(a)
    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + 1 / (12 * (a + b)) - 1 / (12 * a)


def _fraction(a: float, b: float, x: float, y: float) -> float:
    value = 1.0
    for k in range(60 + 4 * math.isqrt(int(max(a, b)) + 1), 0, -1):
        m = k // 2
        if k % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + term / value
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    log_front = a * log_x + b * log_y - math.log(a)
    log_front += _log_gamma_step(max(a, b), min(a, b)) - math.lgamma(min(a, b))
    return math.exp(log_front) / value


def incomplete_beta(a: float, b: float, x: float, y: float) -> float:
    """Regularised I_x(a, b); y is 1 - x, given apart so that it keeps its precision."""
    if any(math.isnan(v) for v in (a, b, x, y)):
        return math.nan
    if x <= 0.0 or y <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    # with a very large a, the fraction of the near side would cancel for small statistics
    if x > (a + 1.0) / (a + b + 2.0) or (a > 1e4 and a * y < 15.0):
        return 1.0 - _fraction(b, a, y, x)
    return _fraction(a, b, x, y)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with df degrees of freedom."""
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    """P(F >= f) with df1 and df2 degrees of freedom."""
    if math.isinf(f):
        return 0.0
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(*row) for row in zip(t.astype(float), df.astype(float))], dtype=float)


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    rows = zip(f.astype(float), df1.astype(float), df2.astype(float))
    return pd.Series([f_upper(*row) for row in rows], dtype=float)
