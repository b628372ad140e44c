"""Counts of arrangements, and whole-number functions, as columns. Results that leave 64 bits are not defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .combo import choose

LONG = "bigint"


def _long(c: Column | int) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast(LONG)


def _row(values: list[list[int]], n: Column, k: Column) -> Column:
    """values[n][k], 0 beyond the row's end."""
    return F.coalesce(F.get(F.get(F.lit(values), n.cast("int")), k.cast("int")), _long(0))


def double_factorial(n: Column) -> Column:
    """n up to 33."""
    return F.when(n <= 1, _long(1)).otherwise(F.aggregate(F.sequence(F.greatest(n.cast("int"), F.lit(1)), F.lit(1), F.lit(-2)), _long(1), lambda a, k: a * k))


def combinations_with_rep(n: Column, k: Column) -> Column:
    return choose(n + k - 1, k)


def multinomial(parts: Column) -> Column:
    """Of an array of counts: by binomials of the running total."""
    state = lambda n, w: F.struct(_long(n).alias("n"), _long(w).alias("w"))
    return F.aggregate(parts, state(0, 1), lambda s, k: state(s["n"] + k, s["w"] * choose(s["n"] + k, _long(k))))["w"]


def stirling1(n: Column, k: Column) -> Column:
    """Permutations of n with k cycles; n up to 20."""
    rows = [[1]]
    for m in range(20):
        old = [*rows[-1], 0]
        rows.append([(old[j - 1] if j else 0) + m * old[j] for j in range(m + 2)])
    return _row(rows, n, k)


def stirling2(n: Column, k: Column) -> Column:
    """Partitions of n things into k sets; n up to 24."""
    rows = [[1]]
    for m in range(24):
        old = [*rows[-1], 0]
        rows.append([(old[j - 1] if j else 0) + j * old[j] for j in range(m + 2)])
    return _row(rows, n, k)


def eulerian_number(n: Column, k: Column) -> Column:
    """Permutations of n with k ascents; n up to 20."""
    rows = [[1]]
    for m in range(1, 21):
        old = [*rows[-1], 0]
        rows.append([(j + 1) * old[j] + ((m - j) * old[j - 1] if j else 0) for j in range(m)])
    return _row(rows, n, k)


def motzkin_num(n: Column) -> Column:
    """n up to 40."""
    values = [1, 1]
    for m in range(2, 41):
        values.append(((2 * m + 1) * values[-1] + (3 * m - 3) * values[-2]) // (m + 2))
    return F.get(F.lit(values), n.cast("int"))


def involutions(n: Column) -> Column:
    """Permutations that are their own inverse; n up to 30."""
    values = [1, 1]
    for m in range(2, 31):
        values.append(values[-1] + (m - 1) * values[-2])
    return F.get(F.lit(values), n.cast("int"))


def restricted_partitions(n: Column, k: Column) -> Column:
    """Partitions of n into k parts; n up to 50."""
    rows = [[1]]
    for m in range(1, 51):
        at = lambda i, j: rows[i][j] if 0 <= j <= i else 0
        rows.append([at(m - 1, j - 1) + (at(m - j, j) if j and m - j >= 0 else 0) for j in range(m + 1)])
    return _row(rows, n, k)


def gcd(a: Column, b: Column) -> Column:
    state = lambda x, y: F.struct(_long(x).alias("x"), _long(y).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), state(F.abs(a), F.abs(b)), lambda s, _: state(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]), F.when(s["y"] == 0, _long(0)).otherwise(s["x"] % F.greatest(s["y"], _long(1)))))["x"]


def necklaces(n: Column, k: int) -> Column:
    """Necklaces of n beads of k colours: the mean over rotations of the colourings that each leaves as they are."""
    return (F.aggregate(F.sequence(_long(1), _long(n)), F.lit(0.0), lambda a, i: a + F.pow(F.lit(float(k)), gcd(i, _long(n)))) / n).cast(LONG)


def bracelets(n: Column, k: int) -> Column:
    """Necklaces that may be turned over as well."""
    half, base = F.floor(n / 2), F.lit(float(k))
    turned = F.when(n % 2 == 1, F.pow(base, half + 1)).otherwise((F.pow(base, half) + F.pow(base, half + 1)) / 2)
    return ((necklaces(n, k) + turned) / 2).cast(LONG)


def gray_code(n: Column) -> Column:
    return n.bitwiseXOR(F.shiftright(n, 1))


def mod_inv(a: Column, m: Column) -> Column:
    """The inverse of a modulo m, from 0; null where there is none."""
    state = lambda r, s, x, y: F.struct(*(_long(c).alias(n) for n, c in (("r", r), ("s", s), ("x", x), ("y", y))))

    def step(t: Column, _: Column) -> Column:
        over = t["s"] == 0
        q = F.expr("0L") + F.floor(t["r"] / F.when(over, 1).otherwise(t["s"]))
        new = state(t["s"], t["r"] - q * t["s"], t["y"], t["x"] - q * t["y"])
        return F.when(over, t).otherwise(new)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(60)), state(F.pmod(a, m), m, 1, 0), step)
    return F.when(last["r"] == 1, F.pmod(last["x"], m))


def jacobi_symbol(a: Column, n: Column) -> Column:
    """-1, 0 or 1, for odd n above 0; else null."""
    state = lambda x, m, s: F.struct(*(_long(c).alias(k) for k, c in (("x", x), ("m", m), ("s", s))))

    def step(t: Column, _: Column) -> Column:
        x, m, s = t["x"], t["m"], t["s"]
        halved = state(F.shiftright(x, 1), m, F.when((m % 8 == 3) | (m % 8 == 5), -s).otherwise(s))
        turned = state(m % F.greatest(x, _long(1)), x, F.when((x % 4 == 3) & (m % 4 == 3), -s).otherwise(s))
        return F.when(x == 0, t).when(x % 2 == 0, halved).otherwise(turned)

    last = F.aggregate(F.sequence(F.lit(1), F.lit(190)), state(F.pmod(a, F.greatest(n, _long(1))), n, 1), step)
    return F.when((n > 0) & (n % 2 == 1), F.when(last["m"] == 1, last["s"]).otherwise(_long(0)))


def lucas_sequence(n: Column, p: int, q: int) -> Column:
    """U_n(P, Q): 0, 1, then P times the last less Q times the one before."""
    pair = lambda a, b: F.struct(_long(a).alias("a"), _long(b).alias("b"))
    return F.when(n == 0, _long(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), pair(0, 1), lambda s, _: pair(s["b"], p * s["b"] - q * s["a"]))["a"])


def multiplicative_order(a: Column, m: Column) -> Column:
    """The least power of a that is 1 modulo m, tried one by one up to m; null where a and m have a common divisor."""
    state = lambda x, k: F.struct(_long(x).alias("x"), _long(k).alias("k"))

    def step(t: Column, k: Column) -> Column:
        return F.when(t["k"] > 0, t).otherwise(state(t["x"] * F.pmod(a, m) % m, F.when(t["x"] * F.pmod(a, m) % m == F.pmod(_long(1), m), k).otherwise(_long(0))))

    return F.when(gcd(a, m) == 1, F.aggregate(F.sequence(_long(1), _long(m)), state(F.pmod(_long(1), m), 0), step)["k"])
