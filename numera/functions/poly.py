"""Polynomials as arrays of coefficients, lowest first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def evaluate(c: Column, x: Column) -> Column:
    """By Horner's rule; no coefficients: 0."""
    return F.aggregate(F.reverse(c), F.lit(0.0), lambda a, k: a * x + k)


def derivative(c: Column) -> Column:
    return F.when(F.size(c) <= 1, F.array(F.lit(0.0))).otherwise(F.transform(F.slice(c, 2, F.greatest(F.lit(1), F.size(c) - 1)), lambda k, i: k * (i + 1)))


def integral(c: Column, constant: float = 0.0) -> Column:
    return F.concat(F.array(F.lit(constant)), F.transform(c, lambda k, i: k / (i + 1)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))


def multiply(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b) - 1
    at = lambda i: F.aggregate(F.sequence(F.lit(0), F.size(a) - 1), F.lit(0.0), lambda s, k: s + F.coalesce(F.get(a, k) * F.get(b, i - k), F.lit(0.0)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - 1)), at)).otherwise(F.array().cast("array<double>"))


def bezier(points: Column, t: Column) -> Column:
    """A coordinate of a Bezier curve, from its control values, by repeated interpolation."""
    line = lambda a, _: F.when(F.size(a) > 1, F.transform(F.slice(a, 1, F.size(a) - 1), lambda x, i: x * (1 - t) + F.get(a, i + 1) * t)).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(points) - 1)), points, line)[0]


def scale(c: Column, k: Column) -> Column:
    return F.transform(c, lambda x: x * k)


def subtract(a: Column, b: Column) -> Column:
    return add(a, scale(b, F.lit(-1.0)))


def reverse(c: Column) -> Column:
    return F.reverse(c)


def monic(c: Column) -> Column:
    """Over its last coefficient; null where that is 0."""
    return F.transform(c, lambda x: F.try_divide(x, F.element_at(c, -1)))


def power(c: Column, n: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.array(F.lit(1.0)), lambda p, _: multiply(p, c)) if n else F.array(F.lit(1.0))


def compose(a: Column, b: Column) -> Column:
    """a(b(x)), by Horner's rule."""
    return F.aggregate(F.reverse(a), F.array().cast("array<double>"), lambda p, k: add(multiply(p, b), F.array(k)))


def shift(c: Column, h: Column) -> Column:
    """c(x + h)."""
    return compose(c, F.array(h, F.lit(1.0)))


def divide(a: Column, b: Column) -> Column:
    """A struct of quotient and remainder; the last coefficient of b must not be 0. The remainder is as long as a."""
    m = F.size(b) - 1
    down = F.when(F.size(a) > m, F.sequence(F.size(a) - 1 - m, F.lit(0))).otherwise(F.array().cast("array<int>"))
    state = lambda q, r: F.struct(q.alias("quotient"), r.alias("remainder"))

    def step(s: Column, k: Column) -> Column:
        top = F.get(s["remainder"], k + m) / F.element_at(b, -1)
        return state(F.concat(F.array(top), s["quotient"]), F.transform(s["remainder"], lambda x, i: F.when((i >= k) & (i <= k + m), x - top * F.get(b, i - k)).otherwise(x)))

    return F.aggregate(down, state(F.array().cast("array<double>"), a), step)
