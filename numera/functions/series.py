"""Special functions as columns, by series, recurrences, means and quadrature inside Spark's expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' coefficients for g = 7, and 2k-th Bernoulli numbers over 2k and over (2k)!.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
BERNOULLI_OVER_INDEX = (1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132)
BERNOULLI_OVER_FACTORIAL = (1 / 12, -1 / 720, 1 / 30240, -1 / 1209600)


def _sum(first: int, last: int | Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(first), last if isinstance(last, Column) else F.lit(last)), F.lit(0.0), lambda s, k: s + term(k))


def _simpson(f: Callable[[Column], Column], low: Column, high: Column, parts: int = 200) -> Column:
    h = (high - low) / parts
    inner = _sum(1, parts - 1, lambda k: F.when(k % 2 == 1, 4.0).otherwise(2.0) * f(low + h * k))
    return h / 3 * (f(low) + f(high) + inner)


def log_gamma(x: Column) -> Column:
    """For x above 0; else null."""
    y = x - 1
    s = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        s = s + c / (y + k)
    t = y + 7.5
    return F.when(x > 0, 0.5 * F.ln(F.lit(2 * pi)) + (y + 0.5) * F.ln(t) - t + F.ln(s))


def gamma_func(x: Column) -> Column:
    """By reflection below 1/2; null at the poles."""
    poles = (x <= 0) & (x == F.floor(x))
    return F.when(~poles, F.when(x >= 0.5, F.exp(log_gamma(x))).otherwise(pi / (F.sin(pi * x) * F.exp(log_gamma(1 - x)))))


def rgamma(x: Column) -> Column:
    """1 / gamma; 0 at its poles."""
    return F.when(x.isNotNull(), F.coalesce(1 / gamma_func(x), F.lit(0.0)))


def beta_func(a: Column, b: Column) -> Column:
    return F.exp(log_gamma(a) + log_gamma(b) - log_gamma(a + b))


def pochhammer(a: Column, n: Column) -> Column:
    """a (a + 1) ... (a + n - 1)."""
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1), F.lit(1.0), lambda s, k: s * (a + k)))


def falling_factorial(a: Column, n: Column) -> Column:
    """a (a - 1) ... (a - n + 1)."""
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1), F.lit(1.0), lambda s, k: s * (a - k)))


def digamma(x: Column) -> Column:
    """For x above 0: by the asymptotic series at x + 10."""
    y = x + 10
    tail = F.ln(y) - 1 / (2 * y)
    for k, c in enumerate(BERNOULLI_OVER_INDEX, 1):
        tail = tail - c / F.pow(y, F.lit(2 * k))
    return F.when(x > 0, tail - _sum(0, 9, lambda k: 1 / (x + k)))


def trigamma(x: Column) -> Column:
    """For x above 0: by the asymptotic series at x + 20."""
    y = x + 20
    tail = 1 / y + 1 / (2 * y * y)
    for k, c in enumerate(BERNOULLI_OVER_INDEX, 1):
        tail = tail + 2 * k * c / F.pow(y, F.lit(2 * k + 1))
    return F.when(x > 0, tail + _sum(0, 19, lambda k: 1 / ((x + k) * (x + k))))


def erf(x: Column) -> Column:
    """By a series of positive terms within 5, beyond it a sign."""
    pair = lambda t, s: F.struct(t.cast("double").alias("t"), s.cast("double").alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), pair(x, x), lambda s, k: pair(s["t"] * 2 * x * x / (2 * k + 1), s["s"] + s["t"] * 2 * x * x / (2 * k + 1)))["s"]
    return F.when(F.abs(x) > 5.9, F.signum(x)).otherwise(2 / sqrt(pi) * F.exp(-x * x) * total)


def erfc(x: Column) -> Column:
    """By a continued fraction above 2, where 1 - erf would lose digits."""
    deep = F.aggregate(F.sequence(F.lit(120), F.lit(1)), x.cast("double"), lambda f, k: x + k / 2 / f)
    return F.when(x > 2, F.exp(-x * x) / (sqrt(pi) * deep)).otherwise(1 - erf(x))


def gamma_inc_reg(a: Column, x: Column) -> Column:
    """P(a, x), by its series; for x up to about 100."""
    pair = lambda t, s: F.struct(t.cast("double").alias("t"), s.cast("double").alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(300)), pair(1 / a, 1 / a), lambda s, k: pair(s["t"] * x / (a + k), s["s"] + s["t"] * x / (a + k)))["s"]
    return F.when(x <= 0, F.lit(0.0)).otherwise(F.exp(a * F.ln(x) - x - log_gamma(a)) * total)


def gamma_inc_reg_upper(a: Column, x: Column) -> Column:
    return 1 - gamma_inc_reg(a, x)


def gamma_inc(a: Column, x: Column) -> Column:
    return gamma_inc_reg(a, x) * gamma_func(a)


def beta_inc_reg(a: Column, b: Column, x: Column) -> Column:
    """I_x(a, b), by the continued fraction from its far end; the side with the faster one is taken."""

    def fraction(a: Column, b: Column, x: Column) -> Column:
        def down(f: Column, m: Column) -> Column:
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            return 1 + F.when(m > 0, even).otherwise(F.lit(1.0)) / (1 + odd / f)

        # 1 / (1 + d1 / (1 + d2 / ...)): from the last pair of terms up; the first has 1 for its even term
        return F.aggregate(F.sequence(F.lit(80), F.lit(0)), F.lit(1.0), down) - 1

    front = F.exp(a * F.ln(x) + b * F.ln(1 - x) - F.ln(beta_func(a, b)))
    left = front * fraction(a, b, x) / a
    right = 1 - front * fraction(b, a, 1 - x) / b
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(x < (a + 1) / (a + b + 2), left).otherwise(right)


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    return beta_inc_reg(a, b, x) * beta_func(a, b)


def zeta_hurwitz(s: Column, a: Column, terms: int = 20) -> Column:
    """For s above 1 and a above 0, by Euler and Maclaurin."""
    n = a + terms
    tail = F.pow(n, 1 - s) / (s - 1) + F.pow(n, -s) / 2
    rising = s
    for k, c in enumerate(BERNOULLI_OVER_FACTORIAL, 1):
        tail = tail + c * rising * F.pow(n, -s - (2 * k - 1))
        rising = rising * (s + 2 * k - 1) * (s + 2 * k)
    return F.when(s > 1, _sum(0, terms - 1, lambda k: F.pow(a + k, -s)) + tail)


def zeta(s: Column) -> Column:
    return zeta_hurwitz(s, F.lit(1.0))


def eta_dirichlet(s: Column) -> Column:
    return (1 - F.pow(F.lit(2.0), 1 - s)) * zeta(s)


def beta_dirichlet(s: Column) -> Column:
    return F.pow(F.lit(4.0), -s) * (zeta_hurwitz(s, F.lit(0.25)) - zeta_hurwitz(s, F.lit(0.75)))


def polylog(n: Column, z: Column, terms: int = 400) -> Column:
    """For z within 0.9, by its series."""
    return _sum(1, terms, lambda k: F.pow(z, k) / F.pow(k.cast("double"), n))


def debye(n: int, x: Column) -> Column:
    """n / x^n times the integral of t^n / (e^t - 1) up to x; 1 at 0."""
    f = lambda t: F.when(t == 0, F.lit(1.0 if n == 1 else 0.0)).otherwise(F.pow(t, F.lit(n)) / F.expm1(t))
    return F.when(x == 0, F.lit(1.0)).otherwise(n / F.pow(x, F.lit(n)) * _simpson(f, F.lit(0.0), x, 400))


def lambert_w(z: Column) -> Column:
    """The main branch for z of 0 at least, by Halley's steps."""

    def step(w: Column, k: Column) -> Column:
        e = F.exp(w)
        d = w * e - z
        return w - d / (e * (w + 1) - (w + 2) * d / (2 * w + 2))

    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.log1p(z.cast("double")), step)


def _means(k: Column) -> Column:
    """Arithmetic-geometric mean of 1 and sqrt(1 - k^2), and the sum of 2^(n-1) c_n^2."""
    state = lambda a, b, p, s: F.struct(*(c.cast("double").alias(n) for n, c in (("a", a), ("b", b), ("p", p), ("s", s))))

    def step(s: Column, _: Column) -> Column:
        c = (s["a"] - s["b"]) / 2
        return state((s["a"] + s["b"]) / 2, F.sqrt(s["a"] * s["b"]), 2 * s["p"], s["s"] + s["p"] * c * c)

    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), state(F.lit(1.0), F.sqrt(1 - k * k), F.lit(1.0), k * k / 2), step)


def ellip_k(k: Column) -> Column:
    """Of the modulus; null from 1 on."""
    return F.when(F.abs(k) < 1, pi / 2 / _means(k)["a"])


def ellip_e(k: Column) -> Column:
    m = _means(k)
    return F.when(F.abs(k) < 1, pi / 2 / m["a"] * (1 - m["s"]))


def ellip_d(k: Column) -> Column:
    """(K - E) / k^2, and its limit at 0."""
    return F.when(k == 0, F.lit(pi / 4)).otherwise((ellip_k(k) - ellip_e(k)) / (k * k))


def ellip_f(phi: Column, k: Column) -> Column:
    return _simpson(lambda t: 1 / F.sqrt(1 - k * k * F.sin(t) * F.sin(t)), F.lit(0.0), phi)


def ellip_e_inc(phi: Column, k: Column) -> Column:
    return _simpson(lambda t: F.sqrt(1 - k * k * F.sin(t) * F.sin(t)), F.lit(0.0), phi)


def ellip_pi(n: Column, k: Column) -> Column:
    return _simpson(lambda t: 1 / ((1 - n * F.sin(t) * F.sin(t)) * F.sqrt(1 - k * k * F.sin(t) * F.sin(t))), F.lit(0.0), F.lit(pi / 2))


def _turn(f: Callable[[Column], Column], points: int = 96) -> Column:
    """Mean of f over a half turn by the trapezoid rule, which is exact to rounding for periodic functions."""
    h = pi / points
    return (_sum(1, points - 1, lambda k: f(k * h)) + (f(F.lit(0.0)) + f(F.lit(pi))) / 2) / points


def bessel_j(n: Column, x: Column) -> Column:
    """Of a whole order, for x within 60."""
    return _turn(lambda t: F.cos(n * t - x * F.sin(t)))


def bessel_i(n: Column, x: Column) -> Column:
    return _turn(lambda t: F.exp(x * F.cos(t)) * F.cos(n * t))


def bessel_j0(x: Column) -> Column:
    return bessel_j(F.lit(0), x)


def bessel_j1(x: Column) -> Column:
    return bessel_j(F.lit(1), x)


def spherical_yn(n: Column, x: Column) -> Column:
    """By the upward recurrence, which is stable."""
    from .orthogonal import _recur

    return _recur(n, -F.cos(x) / x, -F.cos(x) / (x * x) - F.sin(x) / x, lambda k, a, b: (2 * k + 1) / x * b - a)
