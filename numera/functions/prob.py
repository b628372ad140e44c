"""Densities, distribution functions and quantiles in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import series as S

SQRT_2PI = 2.5066282746310002


def norm_pdf(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (x - mu) / sigma
    return F.exp(-z * z / 2) / (sigma * SQRT_2PI)


def lognorm_pdf(x: Column, mu: float, sigma: float) -> Column:
    return F.when(x > 0, norm_pdf(F.ln(F.when(x > 0, x)), mu, sigma) / F.when(x > 0, x)).otherwise(0.0)


def exp_pdf(x: Column, rate: float) -> Column:
    return F.when(x >= 0, rate * F.exp(-rate * x)).otherwise(0.0)


def exp_cdf(x: Column, rate: float) -> Column:
    return F.when(x >= 0, 1 - F.exp(-rate * x)).otherwise(0.0)


def exp_ppf(p: Column, rate: float) -> Column:
    """1e100 at 1."""
    return F.when(p >= 1, F.lit(1e100)).when(p <= 0, F.lit(0.0)).otherwise(-F.ln(F.when((p > 0) & (p < 1), 1 - p)) / rate)


def uniform_pdf(x: Column, a: float, b: float) -> Column:
    return F.when((x >= a) & (x <= b), F.lit(1 / (b - a))).otherwise(0.0)


def uniform_cdf(x: Column, a: float, b: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))


def logistic_cdf(x: Column, mu: float, s: float) -> Column:
    return 1 / (1 + F.exp(-(x - mu) / s))


def laplace_cdf(x: Column, mu: float, b: float) -> Column:
    return F.when(x < mu, F.exp((x - mu) / b) / 2).otherwise(1 - F.exp(-(x - mu) / b) / 2)


def cauchy_cdf(x: Column, x0: float, gamma: float) -> Column:
    return F.atan((x - x0) / gamma) / 3.141592653589793 + 0.5


def weibull_cdf(x: Column, k: float, scale: float) -> Column:
    return F.when(x > 0, 1 - F.exp(-F.pow(x / scale, F.lit(k)))).otherwise(0.0)


def pareto_cdf(x: Column, xm: float, alpha: float) -> Column:
    return F.when(x >= xm, 1 - F.pow(xm / x, F.lit(alpha))).otherwise(0.0)


def rayleigh_cdf(x: Column, sigma: float) -> Column:
    return F.when(x >= 0, 1 - F.exp(-x * x / (2 * sigma * sigma))).otherwise(0.0)


def gumbel_cdf(x: Column, mu: float, beta: float) -> Column:
    return F.exp(-F.exp(-(x - mu) / beta))


def geometric_pmf(k: Column, p: float) -> Column:
    return F.when(k >= 1, p * F.pow(F.lit(1 - p), k - 1)).otherwise(0.0)


def poisson_pmf(k: Column, rate: float) -> Column:
    """By a product, so that no factorial overflows."""
    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), k.cast("int"))), F.lit(1.0), lambda a, i: a * rate / i)
    return F.when(k < 0, 0.0).when(k == 0, F.lit(1.0)).otherwise(terms) * F.exp(F.lit(-rate))


def weibull_pdf(x: Column, k: float, scale: float) -> Column:
    return F.when(x >= 0, k / scale * F.pow(x / scale, F.lit(k - 1)) * F.exp(-F.pow(x / scale, F.lit(k)))).otherwise(0.0)


def weibull_ppf(p: Column, k: float, scale: float) -> Column:
    return scale * F.pow(-F.ln(1 - p), F.lit(1 / k))


def laplace_pdf(x: Column, mu: float, b: float) -> Column:
    return F.exp(-F.abs(x - mu) / b) / (2 * b)


def laplace_ppf(p: Column, mu: float, b: float) -> Column:
    return mu - b * F.signum(p - 0.5) * F.ln(1 - 2 * F.abs(p - 0.5))


def logistic_pdf(x: Column, mu: float, s: float) -> Column:
    e = F.exp(-(x - mu) / s)
    return e / (s * (1 + e) * (1 + e))


def logistic_ppf(p: Column, mu: float, s: float) -> Column:
    return mu + s * F.ln(p / (1 - p))


def gumbel_pdf(x: Column, mu: float, beta: float) -> Column:
    z = (x - mu) / beta
    return F.exp(-(z + F.exp(-z))) / beta


def gumbel_ppf(p: Column, mu: float, beta: float) -> Column:
    return mu - beta * F.ln(-F.ln(p))


def cauchy_pdf(x: Column, x0: float, gamma: float) -> Column:
    return gamma / (3.141592653589793 * (gamma * gamma + (x - x0) * (x - x0)))


def cauchy_ppf(p: Column, x0: float, gamma: float) -> Column:
    return x0 + gamma * F.tan(3.141592653589793 * (p - 0.5))


def pareto_pdf(x: Column, xm: float, alpha: float) -> Column:
    return F.when(x >= xm, alpha * xm**alpha / F.pow(x, F.lit(alpha + 1))).otherwise(0.0)


def pareto_ppf(p: Column, xm: float, alpha: float) -> Column:
    return xm / F.pow(1 - p, F.lit(1 / alpha))


def rayleigh_pdf(x: Column, sigma: float) -> Column:
    return F.when(x >= 0, x / (sigma * sigma) * F.exp(-x * x / (2 * sigma * sigma))).otherwise(0.0)


def rayleigh_ppf(p: Column, sigma: float) -> Column:
    return sigma * F.sqrt(-2 * F.ln(1 - p))


def binom_pmf(k: Column, n: Column, p: float) -> Column:
    """By a product, so that no factorial overflows."""
    ways = F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), F.lit(1.0), lambda a, i: a * (n - k + i) / i)
    return F.when((k < 0) | (k > n), 0.0).otherwise(F.when(k == 0, F.lit(1.0)).otherwise(ways) * F.pow(F.lit(p), k) * F.pow(F.lit(1 - p), n - k))


def binom_cdf(k: Column, n: Column, p: float) -> Column:
    return F.when(k < 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), F.lit(0.0), lambda s, i: s + binom_pmf(i, n, p)))


def poisson_cdf(k: Column, rate: float) -> Column:
    return F.when(k < 0, 0.0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(k.cast("int"), F.lit(0))), F.lit(0.0), lambda s, i: s + poisson_pmf(i, rate)))


def gamma_pdf(x: Column, shape: float, scale: float) -> Column:
    return F.when(x > 0, F.exp((shape - 1) * F.ln(F.when(x > 0, x)) - x / scale - S.log_gamma(F.lit(float(shape)))) / scale**shape).otherwise(0.0)


def gamma_cdf(x: Column, shape: float, scale: float) -> Column:
    return S.gamma_inc_reg(F.lit(float(shape)), x / scale)


def chi2_pdf(x: Column, df: float) -> Column:
    return gamma_pdf(x, df / 2, 2.0)


def chi2_cdf(x: Column, df: float) -> Column:
    return gamma_cdf(x, df / 2, 2.0)


def beta_pdf(x: Column, a: float, b: float) -> Column:
    return F.when((x >= 0) & (x <= 1), F.pow(x, F.lit(a - 1)) * F.pow(1 - x, F.lit(b - 1)) / S.beta_func(F.lit(float(a)), F.lit(float(b)))).otherwise(0.0)


def beta_cdf(x: Column, a: float, b: float) -> Column:
    return S.beta_inc_reg(F.lit(float(a)), F.lit(float(b)), x)


def t_pdf(x: Column, df: float) -> Column:
    return F.pow(1 + x * x / df, F.lit(-(df + 1) / 2)) / (df**0.5 * S.beta_func(F.lit(0.5), F.lit(df / 2)))


def t_cdf(x: Column, df: float) -> Column:
    tail = S.beta_inc_reg(F.lit(df / 2), F.lit(0.5), df / (df + x * x)) / 2
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def f_pdf(x: Column, d1: float, d2: float) -> Column:
    top = F.pow(d1 * x, F.lit(d1 / 2)) * d2 ** (d2 / 2) / F.pow(d1 * x + d2, F.lit((d1 + d2) / 2))
    return F.when(x > 0, top / (x * S.beta_func(F.lit(d1 / 2), F.lit(d2 / 2)))).otherwise(0.0)


def f_cdf(x: Column, d1: float, d2: float) -> Column:
    return F.when(x > 0, S.beta_inc_reg(F.lit(d1 / 2), F.lit(d2 / 2), d1 * x / (d1 * x + d2))).otherwise(0.0)
