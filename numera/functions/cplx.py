"""Complex numbers as structs of re and im."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def polar(r: Column, phi: Column) -> Column:
    return make(r * F.cos(phi), r * F.sin(phi))


def add(a: Column, b: Column) -> Column:
    return make(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return make(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return make(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def div(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    n = F.nullif(b["re"] * b["re"] + b["im"] * b["im"], F.lit(0.0))
    return make((a["re"] * b["re"] + a["im"] * b["im"]) / n, (a["im"] * b["re"] - a["re"] * b["im"]) / n)


def conj(a: Column) -> Column:
    return make(a["re"], -a["im"])


def modulus(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def arg(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def exp(a: Column) -> Column:
    return polar(F.exp(a["re"]), a["im"])


def log(a: Column) -> Column:
    return make(F.ln(modulus(a)), arg(a))


def sqrt(a: Column) -> Column:
    return polar(F.sqrt(modulus(a)), arg(a) / 2)


def power(a: Column, p: float) -> Column:
    return polar(F.pow(modulus(a), F.lit(p)), arg(a) * p)


def moebius(a: Column, b: Column, c: Column, d: Column, z: Column) -> Column:
    """(a z + b) / (c z + d), all complex."""
    return div(add(mul(a, z), b), add(mul(c, z), d))


def cross_ratio_of(z1: Column, z2: Column, z3: Column, z4: Column) -> Column:
    """(z1 - z3)(z2 - z4) / ((z1 - z4)(z2 - z3)), as a complex number."""
    return div(mul(sub(z1, z3), sub(z2, z4)), mul(sub(z1, z4), sub(z2, z3)))


def joukowski(z: Column, c: float = 1.0) -> Column:
    return add(z, div(make(F.lit(c * c), F.lit(0.0)), z))


def poisson_kernel(theta: Column, phi: Column, r: Column) -> Column:
    return (1 - r * r) / (1 - 2 * r * F.cos(theta - phi) + r * r)


def hyperbolic_distance(a: Column, b: Column) -> Column:
    """In the unit disk."""
    return 2 * F.atanh(modulus(sub(a, b)) / modulus(sub(make(F.lit(1.0), F.lit(0.0)), mul(a, conj(b)))))


def green_function_disk(z: Column, at: Column, radius: float = 1.0) -> Column:
    """0 outside of the disk, minus infinity at its pole."""
    w, w0 = make(z["re"] / radius, z["im"] / radius), make(at["re"] / radius, at["im"] / radius)
    apart = modulus(sub(w, w0))
    inside = F.ln(apart / modulus(sub(make(F.lit(1.0), F.lit(0.0)), mul(conj(w0), w)))) / (2 * 3.141592653589793)
    return F.when((modulus(w) >= 1) | (modulus(w0) >= 1), F.lit(0.0)).when(apart < 1e-15, F.lit(float("-inf"))).otherwise(inside)


def power_series(coefficients: Column, z: Column) -> Column:
    """Of an array of real coefficients, lowest first, by Horner's rule."""
    return F.aggregate(F.reverse(coefficients), make(F.lit(0.0), F.lit(0.0)), lambda s, c: make(s["re"] * z["re"] - s["im"] * z["im"] + c, s["re"] * z["im"] + s["im"] * z["re"]))
