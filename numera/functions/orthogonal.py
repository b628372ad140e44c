"""Orthogonal polynomials of a whole-number degree, by their three-term recurrences; nulls give null, negative degrees null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def _recur(n: Column, first: Column | float, second: Column | float, step: Callable[[Column, Column, Column], Column]) -> Column:
    """The n-th member of a row that starts with first and second, where step gives member k + 1 from k, members k - 1 and k."""
    n = n.cast("int")
    ks = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda a, b: F.struct(_double(a).alias("a"), _double(b).alias("b"))
    last = F.aggregate(ks, pair(first, second), lambda s, k: pair(s["b"], step(k, s["a"], s["b"])))
    return F.when(n == 0, last["a"]).when(n > 0, last["b"])


def chebyshev_t(n: Column, x: Column) -> Column:
    return _recur(n, 1.0, x, lambda k, a, b: 2 * x * b - a)


def chebyshev_u(n: Column, x: Column) -> Column:
    return _recur(n, 1.0, 2 * x, lambda k, a, b: 2 * x * b - a)


def chebyshev_v(n: Column, x: Column) -> Column:
    return _recur(n, 1.0, 2 * x - 1, lambda k, a, b: 2 * x * b - a)


def chebyshev_w(n: Column, x: Column) -> Column:
    return _recur(n, 1.0, 2 * x + 1, lambda k, a, b: 2 * x * b - a)


def legendre_p(n: Column, x: Column) -> Column:
    return _recur(n, 1.0, x, lambda k, a, b: ((2 * k + 1) * x * b - k * a) / (k + 1))


def hermite_h(n: Column, x: Column) -> Column:
    """The physicists' polynomials."""
    return _recur(n, 1.0, 2 * x, lambda k, a, b: 2 * x * b - 2 * k * a)


def hermite_he(n: Column, x: Column) -> Column:
    """The probabilists' polynomials."""
    return _recur(n, 1.0, x, lambda k, a, b: x * b - k * a)


def laguerre_l(n: Column, x: Column, alpha: float = 0.0) -> Column:
    return _recur(n, 1.0, 1 + alpha - x, lambda k, a, b: ((2 * k + 1 + alpha - x) * b - (k + alpha) * a) / (k + 1))


def gegenbauer_c(n: Column, lam: float, x: Column) -> Column:
    return _recur(n, 1.0, 2 * lam * x, lambda k, a, b: (2 * (k + lam) * x * b - (k + 2 * lam - 1) * a) / (k + 1))


def jacobi_p(n: Column, alpha: float, beta: float, x: Column) -> Column:
    both = alpha + beta

    def step(k: Column, a: Column, b: Column) -> Column:
        m = k + 1
        t = 2 * m + both
        return ((t - 1) * (t * (t - 2) * x + alpha * alpha - beta * beta) * b - 2 * (m + alpha - 1) * (m + beta - 1) * t * a) / (2 * m * (m + both) * (t - 2))

    return _recur(n, 1.0, alpha + 1 + (both + 2) * (x - 1) / 2, step)
