"""Arithmetic functions of whole numbers, by trial division and modular steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divisors(n: Column) -> Column:
    """In ascending order; n up to about 10^12."""
    low = F.filter(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.floor(F.sqrt(n.cast("double"))).cast("bigint"))), lambda d: n % d == 0)
    high = F.transform(low, lambda d: F.expr("0L") + (n / d).cast("bigint"))
    return F.when(n >= 1, F.array_sort(F.array_distinct(F.concat(low, high)))).otherwise(F.array().cast("array<bigint>"))


def num_divisors(n: Column) -> Column:
    return F.size(divisors(n))


def sum_divisors(n: Column) -> Column:
    return F.aggregate(divisors(n), F.lit(0).cast("bigint"), lambda a, d: a + d)


def prime_factors(n: Column) -> Column:
    """Prime divisors with their multiplicity: an array of structs p, e."""
    primes = F.filter(F.slice(divisors(n), 2, 100_000), lambda d: ~F.exists(F.filter(divisors(n), lambda c: (c > 1) & (c < d)), lambda c: d % c == 0))
    power = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(62)), F.struct(n.cast("bigint").alias("m"), F.lit(0).alias("e")), lambda s, _: F.when(s["m"] % p == 0, F.struct((s["m"] / p).cast("bigint").alias("m"), (s["e"] + 1).alias("e"))).otherwise(s))["e"]
    return F.transform(primes, lambda p: F.struct(p.alias("p"), power(p).alias("e")))


def mobius(n: Column) -> Column:
    f = prime_factors(n)
    return F.when(F.exists(f, lambda x: x["e"] > 1), 0).otherwise(F.when(F.size(f) % 2 == 0, 1).otherwise(-1))


def liouville(n: Column) -> Column:
    total = F.aggregate(prime_factors(n), F.lit(0), lambda a, x: a + x["e"])
    return F.when(total % 2 == 0, 1).otherwise(-1)


def mod_pow(base: Column, exponent: Column, modulus: Column) -> Column:
    """By squaring; the modulus below 2^31, so that products stay within 64 bits."""
    start = F.struct(F.lit(1).cast("bigint").alias("r"), F.pmod(base.cast("bigint"), modulus).alias("b"), exponent.cast("bigint").alias("e"))
    step = lambda s, _: F.when(s["e"] == 0, s).otherwise(F.struct(F.when(s["e"] % 2 == 1, s["r"] * s["b"] % modulus).otherwise(s["r"]).alias("r"), (s["b"] * s["b"] % modulus).alias("b"), F.shiftright(s["e"], 1).alias("e")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, step)["r"] % modulus


def legendre_symbol(a: Column, p: Column) -> Column:
    """For an odd prime p."""
    r = mod_pow(a, F.shiftright(p - 1, 1), p)
    return F.when(r == p - 1, F.lit(-1)).otherwise(r.cast("int"))
