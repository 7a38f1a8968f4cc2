"""Distribution functions: normal as a Column, Student and F as an Arrow UDF for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - p * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def normal_cdf_sql(x: str) -> str:
    """The same as SQL."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + 0.3275911 * {z}))"
    p = f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))))"
    return f"(CASE WHEN {x} >= 0 THEN (2 - {p} * exp(-{z} * {z})) / 2 ELSE ({p} * exp(-{z} * {z})) / 2 END)"


def two_sided_normal(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):  # the number of steps follows the root of a and b
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


def beta_cdf(a: float, b: float, x: float) -> float:
    if not 0 < x < 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def _binomial_tail(n: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if np.isnan([a, b]).any() else 1.0 if b <= 0 else 0.0 if b > a else beta_cdf(b, a - b + 1, 0.5) for a, b in zip(n.astype(float), k.astype(float))], dtype="float64")


def binomial_tail(n: Column, k: Column) -> Column:
    """P(X >= k) of n fair throws, by the incomplete beta function; for result tables of any n."""
    return _binomial_tail(n, k)


def binomial_two_sided(n: Column, k: Column) -> Column:
    """Two-sided sign test with p = 1/2: twice the smaller tail, at most 1."""
    return F.least(F.lit(1.0), 2 * F.least(binomial_tail(n, k), binomial_tail(n, n - k)))


@F.pandas_udf(DoubleType())
def f_tail(value: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """P(F > value); null where a value is missing or a degree of freedom isn't positive."""
    return pd.Series([None if np.isnan([v, a, b]).any() or a <= 0 or b <= 0 else beta_cdf(b / 2, a / 2, b / (b + a * max(v, 0.0)))
                      for v, a, b in zip(value.astype(float), df1.astype(float), df2.astype(float))], dtype="float64")


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return f_tail(t * t, F.lit(1.0), df.cast("double"))


def f_tail_sql(f: str, df1: str, df2: str, steps: int = 4000) -> str:
    """P(F > f) as SQL, by Simpson's rule over the root of the variable, which has no pole at 0; beyond 1600 it counts as 0."""
    h = f"(sqrt(least({f}, 1600.0)) / {steps})"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    density = f"pow(i * {h}, {df1} - 1) * pow(1 + {df1} * pow(i * {h}, 2) / {df2}, -({df1} + {df2}) / 2.0)"
    front = f"(2 * exp(lgamma(({df1} + {df2}) / 2.0) - lgamma({df1} / 2.0) - lgamma({df2} / 2.0) + {df1} / 2.0 * ln({df1} / CAST({df2} AS DOUBLE))))"
    return f"greatest(0, 1 - {front} * {h} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {density})))"


def t_two_sided_sql(t: str, df: str) -> str:
    return f_tail_sql(f"(({t}) * ({t}))", "1", df)


#: Coefficients of MacKinnon (1994) for one series with a constant, below and above tau = -1.61.
_ADF_LOW, _ADF_HIGH, _ADF_MAX, _ADF_MIN, _ADF_STAR = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), 2.74, -18.83, -1.61


def adf_p(tau: Column) -> Column:
    """MacKinnon's approximate p-value of the Dickey-Fuller statistic with a constant."""

    def one(t: Column) -> Column:
        poly = lambda c: sum((x * F.pow(t, F.lit(i)) for i, x in enumerate(c)), F.lit(0.0))
        return F.when(t > _ADF_MAX, 1.0).when(t < _ADF_MIN, 0.0).when(t <= _ADF_STAR, normal_cdf(poly(_ADF_LOW))).otherwise(normal_cdf(poly(_ADF_HIGH)))

    # As a lambda's variable the statistic is computed once, not once for each place that uses it.
    return F.transform(F.array(tau), one)[0]
