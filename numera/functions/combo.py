"""Counts of combinatorics. Results that leave 64 bits are null, or the greatest unsigned number where said."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(values: list[int], n: Column) -> Column:
    return F.get(F.lit(values), n.cast("int"))


def factorial(n: Column) -> Column:
    """As a decimal; more than 20: 2^64 - 1."""
    return F.when(n > 20, F.lit(2**64 - 1).cast("decimal(20,0)")).otherwise(F.factorial(n.cast("int")).cast("decimal(20,0)"))


def choose(n: Column, k: Column) -> Column:
    """By a product that stays whole at each step; for results within 64 bits."""
    j = F.least(k, n - k).cast("int")
    steps = F.when(j >= 1, F.sequence(F.lit(1), F.greatest(F.lit(1), j))).otherwise(F.array().cast("array<int>"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(1).cast("bigint"), lambda a, i: F.expr("0L") + F.try_divide(a * (n - j + i), i).cast("bigint")))


def permutations(n: Column, k: Column) -> Column:
    steps = F.when(k >= 1, F.sequence(F.lit(0), F.greatest(F.lit(0), k.cast("int") - 1))).otherwise(F.array().cast("array<int>"))
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(F.aggregate(steps, F.lit(1).cast("bigint"), lambda a, i: a * (n - i)))


def catalan(n: Column) -> Column:
    """n up to 30."""
    return _table([comb(2 * i, i) // (i + 1) for i in range(31)], n)


def derangements(n: Column) -> Column:
    """n up to 20."""
    values = [1, 0]
    for i in range(2, 21):
        values.append((i - 1) * (values[-1] + values[-2]))
    return _table(values, n)


def bell(n: Column) -> Column:
    """n up to 24."""
    values, row = [1], [1]
    for _ in range(24):
        new = [row[-1]]
        for x in row:
            new.append(new[-1] + x)
        row = new
        values.append(row[0])
    return _table(values, n)


def fibonacci(n: Column) -> Column:
    """n up to 90."""
    values = [0, 1]
    while len(values) < 91:
        values.append(values[-1] + values[-2])
    return _table(values, n)


def partitions(n: Column) -> Column:
    """n up to 100."""
    values = [1] + [0] * 100
    for part in range(1, 101):
        for i in range(part, 101):
            values[i] += values[i - part]
    return _table(values, n)
