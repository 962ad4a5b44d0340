"""Statistics in closed form, and distribution functions for grouped numeric code."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson_from_counts(n: Column, sx: Column, sy: Column, sxy: Column) -> Column:
    """Pearson's r of two 0/1 variables from four counts; 0 where either is constant."""
    n, sx, sy, sxy = (c.cast("double") for c in (n, sx, sy, sxy))
    return F.coalesce(F.try_divide(n * sxy - sx * sy, F.sqrt((n * sx - sx * sx) * (n * sy - sy * sy))), F.lit(0.0))


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums; null where either variable is constant."""
    n, sx, sy, sxx, syy, sxy = (c.cast("double") for c in (n, sx, sy, sxx, syy, sxy))
    return F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest((n * sxx - sx * sx) * (n * syy - sy * sy), F.lit(0.0))))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for step in range(600):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15 and step:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with df degrees of freedom."""
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def p_of_r(r: Column, n: Column) -> Column:
    """Two-sided p of Pearson's r with n pairs; 1 where r is null."""

    def run(rs: pd.Series, ns: pd.Series) -> pd.Series:
        out = []
        for x, m in zip(rs, ns, strict=True):
            if x is None or np.isnan(x) or m < 3:
                out.append(1.0)
            else:
                out.append(0.0 if abs(x) >= 1 else t_two_sided(abs(x) * math.sqrt((m - 2) / (1 - x * x)), m - 2))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(r, n)
