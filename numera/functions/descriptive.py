"""Descriptive statistics as aggregate columns: use them in agg(), grouped or not. Empty input gives 0.0 unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def mean(x: Column) -> Column:
    return _or_zero(F.avg(x))


def var(x: Column) -> Column:
    return _or_zero(F.var_samp(x))


def stddev(x: Column) -> Column:
    return _or_zero(F.stddev_samp(x))


def median(x: Column) -> Column:
    return _or_zero(F.median(x))


def mode(x: Column) -> Column:
    """Of equally frequent values the smallest."""
    return F.mode(x, deterministic=True)


def percentile(x: Column, p: float) -> Column:
    """The value at place floor(p/100 (n-1)) of the sorted ones: no interpolation. One group has to fit one task's memory;
    operators.stats.percentiles has no such limit."""
    s = F.sort_array(F.collect_list(x))
    return F.when(F.count(x) > 0, F.get(s, F.floor(F.lit(p / 100) * (F.count(x) - 1)).cast("int"))).otherwise(0.0)


def skewness(x: Column) -> Column:
    """Standardised by the sample deviation, averaged over n; fewer than 3 values or no spread: 0."""
    n = F.count(x)
    return F.when((n >= 3) & (F.stddev_samp(x) > 0), F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5))).otherwise(0.0)


def kurtosis(x: Column) -> Column:
    """Excess kurtosis, standardised by the sample deviation; fewer than 4 values or no spread: 0."""
    n = F.count(x)
    return F.when((n >= 4) & (F.stddev_samp(x) > 0), (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2)) - 3).otherwise(0.0)


def geometric_mean(x: Column) -> Column:
    """NaN if any value is not positive."""
    return F.when(F.min(x) <= 0, F.lit(float("nan"))).otherwise(_or_zero(F.exp(F.avg(F.ln(F.when(x > 0, x))))))


def harmonic_mean(x: Column) -> Column:
    """0 if any value is 0."""
    return F.when(F.count_if(x == 0) > 0, 0.0).otherwise(_or_zero(F.try_divide(F.count(x), F.sum(F.when(x != 0, 1 / x)))))


def rms(x: Column) -> Column:
    return _or_zero(F.sqrt(F.avg(x * x)))


def weighted_mean(x: Column, w: Column) -> Column:
    """A negative weight gives NaN, a sum of weights of 0 gives 0."""
    return F.when(F.min(w) < 0, F.lit(float("nan"))).otherwise(_or_zero(F.try_divide(F.sum(w * x), F.nullif(F.sum(w), F.lit(0.0)))))


def weighted_variance(x: Column, w: Column) -> Column:
    """With reliability weights."""
    s, ss = F.sum(w), F.sum(w * w)
    spread = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / s
    return F.when(s - ss / s > 0, spread / (s - ss / s)).otherwise(0.0)


def weighted_correlation(x: Column, y: Column, w: Column) -> Column:
    s = F.sum(w)
    sxy = F.sum(w * x * y) - F.sum(w * x) * F.sum(w * y) / s
    sxx, syy = F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / s, F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / s
    return F.when((sxx > 0) & (syy > 0), sxy / F.sqrt(sxx * syy)).otherwise(0.0)


def correlation(x: Column, y: Column) -> Column:
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def partial_correlation(x: Column, y: Column, z: Column) -> Column:
    xy, xz, yz = correlation(x, y), correlation(x, z), correlation(y, z)
    d = (1 - xz * xz) * (1 - yz * yz)
    return F.when(d > 0, (xy - xz * yz) / F.sqrt(d)).otherwise(0.0)


def entropy(p: Column, base: float = 2.0) -> Column:
    return _or_zero(-F.sum(F.when(p > 0, p * F.ln(p)))) / F.ln(F.lit(base))


def renyi(p: Column, alpha: float, base: float = 2.0) -> Column:
    if abs(alpha - 1) < 1e-12:
        return entropy(p, base)
    return F.ln(F.sum(F.when(p > 0, F.pow(p, F.lit(alpha))))) / (1 - alpha) / F.ln(F.lit(base))


def tsallis(p: Column, q: float) -> Column:
    if abs(q - 1) < 1e-12:
        return -F.sum(F.when(p > 0, p * F.ln(p)))
    return (1 - F.sum(F.when(p > 0, F.pow(p, F.lit(q))))) / (q - 1)
