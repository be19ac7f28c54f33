"""Statistics that Spark SQL has no function for."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            c = 1.0 + numerator / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return total


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def pearson_p(r: float | None, n: int | None) -> float | None:
    """Two-sided p-value of a Pearson correlation of n pairs."""
    if r is None or n is None or math.isnan(r) or n < 3:
        return None
    # P(|T| > t) with n-2 degrees of freedom, where t^2 = r^2 (n-2) / (1-r^2)
    return incomplete_beta((n - 2) / 2.0, 0.5, 1.0 - min(r * r, 1.0))


def p_value(r: Column, n: Column) -> Column:
    """``pearson_p`` over aggregated rows: one value per group."""

    @F.pandas_udf("double")
    def tail(r: pd.Series, n: pd.Series) -> pd.Series:
        pairs = zip(r, n)
        return pd.Series(
            [None if pd.isna(a) or pd.isna(b) else pearson_p(a, int(b)) for a, b in pairs], dtype="float64"
        )

    return tail(r.cast("double"), n.cast("bigint"))
