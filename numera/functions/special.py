"""Special functions that Spark lacks, over Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def _each(f):
    def run(x: pd.Series) -> pd.Series:
        def one(v):
            try:
                return f(v) if v == v and v is not None else None
            except (ValueError, OverflowError):
                return math.nan

        return x.map(one)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def lgamma(x):
    """Log of the absolute gamma function; NaN at its poles."""
    return _each(math.lgamma)(x)


def gamma(x):
    return _each(math.gamma)(x)


def erf(x):
    return _each(math.erf)(x)


def erfc(x):
    return _each(math.erfc)(x)


def incomplete_gamma(a: float, x):
    """The regularised lower incomplete gamma function P(a, x): the distribution function of a gamma variable."""

    def p(v: float) -> float:
        if v <= 0:
            return 0.0
        if v < a + 1:  # series
            term = total = 1 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= v / k
                total += term
            return total * math.exp(-v + a * math.log(v) - math.lgamma(a))
        b, c = v + 1 - a, 1e300  # continued fraction
        d = h = 1 / b
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / ((an * d + b) or 1e-300)
            c = (b + an / c) or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - h * math.exp(-v + a * math.log(v) - math.lgamma(a))

    return _each(p)(x)


def chi2_sf(x, df: int):
    """Upper tail of chi-square."""
    return 1 - incomplete_gamma(df / 2, x / 2)
