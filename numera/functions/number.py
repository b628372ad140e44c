"""Number theory and combinatorics as columns."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's steps: 64-bit numbers take fewer than 92."""
    start = F.struct(F.abs(a).alias("a"), F.abs(b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["a"]


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0)).otherwise(F.expr("0") + F.abs(a) / gcd(a, b) * F.abs(b)).cast("long")


def is_prime(n: Column) -> Column:
    """By trial division up to the square root: for numbers up to about 10^10."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("long")
    odd = F.when(root >= 3, F.sequence(F.lit(3).cast("long"), F.greatest(F.lit(3).cast("long"), root), F.lit(2).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n < 2, False).when(n < 4, True).when(n % 2 == 0, False).otherwise(~F.exists(odd, lambda d: n % d == 0))


def totient(n: Column) -> Column:
    """How many of 1..n have no common divisor with n: by its prime divisors, found by trial division."""
    ds = F.sequence(F.lit(2).cast("long"), F.greatest(F.lit(2).cast("long"), F.floor(F.sqrt(n.cast("double"))).cast("long")))
    start = F.struct(n.cast("long").alias("m"), n.cast("long").alias("r"))

    def strip(m: Column, d: Column) -> Column:
        """m without its factors d."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(62)), m, lambda x, _: F.when(x % d == 0, F.floor(x / d)).otherwise(x))

    step = lambda s, d: F.when(s["m"] % d == 0, F.struct(strip(s["m"], d).alias("m"), (s["r"] - F.floor(s["r"] / d)).alias("r"))).otherwise(s)
    end = F.aggregate(ds, start, step)
    return F.when(n < 1, F.lit(0)).otherwise(F.when(end["m"] > 1, end["r"] - F.floor(end["r"] / end["m"])).otherwise(end["r"])).cast("long")


def binomial(n: int, k: Column) -> Column:
    """For a fixed n up to 60."""
    return F.get(F.lit([comb(n, i) for i in range(n + 1)]), k.cast("int"))


def collatz_steps(n: Column, most: int = 600) -> Column:
    start = F.struct(n.cast("long").alias("x"), F.lit(0).alias("s"))
    step = lambda s, _: F.when(s["x"] <= 1, s).otherwise(F.struct(F.when(s["x"] % 2 == 0, F.floor(s["x"] / 2)).otherwise(3 * s["x"] + 1).alias("x"), (s["s"] + 1).alias("s")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["s"]
