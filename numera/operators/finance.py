"""Finance: returns, risk, and closed-form prices as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import _ranked


def returns(s: DataFrame) -> DataFrame:
    """g, idx, r: relative changes; no change from 0."""
    before = F.lag("v").over(W.partitionBy("g").orderBy("idx"))
    return s.select("g", "idx", F.try_divide(F.col("v") - before, F.nullif(before, F.lit(0.0))).alias("r")).where("r IS NOT NULL")


def sharpe(r: DataFrame, rate: float = 0.0) -> DataFrame:
    """Mean over sample deviation; no spread: 0."""
    return r.groupBy("g").agg(F.when(F.stddev_samp("r") > 0, (F.avg("r") - rate) / F.stddev_samp("r")).otherwise(0.0).alias("sharpe"))


def sortino(r: DataFrame, target: float = 0.0) -> DataFrame:
    """The downside is averaged over the periods below the target; none: 1e9."""
    d = F.when(F.col("r") < target, F.pow(F.col("r") - target, F.lit(2)))
    return r.groupBy("g").agg(F.coalesce((F.avg("r") - target) / F.sqrt(F.avg(d)), F.lit(1e9)).alias("sortino"))


def historical_var(r: DataFrame, x: str, by: list[str], level: float) -> DataFrame:
    """by, var: minus the value at place int((1-level) n), counted from 0."""
    at = F.least(F.floor(F.round(F.lit(1 - level) * F.col("_n"), 9)), F.col("_n") - 1) + 1
    return _ranked(r, x, by).where((F.col("_hi") >= at) & (F.col("_hi") - F.col("_c") < at)).select(*by, (-F.col(x)).alias("var"))


def npv(flows: DataFrame, rate: float, by: list[str]) -> DataFrame:
    """flows: t (periods from now), cash."""
    return flows.groupBy(*by).agg(F.sum(F.col("cash") / F.pow(F.lit(1 + rate), F.col("t"))).alias("npv"))


def compound(principal: Column, rate: Column, periods: Column) -> Column:
    return principal * F.pow(1 + rate, periods)


def annuity_payment(principal: Column, rate: Column, periods: Column) -> Column:
    """A rate of 0 spreads the principal evenly."""
    return F.when(rate == 0, principal / periods).otherwise(principal * rate / (1 - F.pow(1 + rate, -periods)))


def bond_price(face: Column, coupon: Column, rate: Column, periods: Column) -> Column:
    factor = F.pow(1 + rate, -periods)
    return F.when(rate == 0, face * (1 + coupon * periods)).otherwise(face * coupon * (1 - factor) / rate + face * factor)


def norm_cdf(x: Column) -> Column:
    """Of the standard normal distribution, within 7.5e-8. The coefficients of Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def black_scholes(s: Column, k: Column, t: Column, r: Column, sigma: Column, call: bool = True) -> Column:
    d1 = (F.ln(s / k) + (r + sigma * sigma / 2) * t) / (sigma * F.sqrt(t))
    d2 = d1 - sigma * F.sqrt(t)
    c = s * norm_cdf(d1) - k * F.exp(-r * t) * norm_cdf(d2)
    return c if call else c - s + k * F.exp(-r * t)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / 2.5066282746310002


def black_scholes_greeks(s: Column, k: Column, t: Column, r: Column, sigma: Column) -> dict[str, Column]:
    """Of a call: delta, gamma, vega, theta (a year), rho."""
    root = F.sqrt(t)
    d1 = (F.ln(s / k) + (r + sigma * sigma / 2) * t) / (sigma * root)
    d2 = d1 - sigma * root
    paid = k * F.exp(-r * t)
    return {"delta": norm_cdf(d1), "gamma": norm_pdf(d1) / (s * sigma * root), "vega": s * norm_pdf(d1) * root, "theta": -s * norm_pdf(d1) * sigma / (2 * root) - r * paid * norm_cdf(d2), "rho": paid * t * norm_cdf(d2)}


def black76(f: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    """A call on a forward."""
    d1 = (F.ln(f / k) + sigma * sigma / 2 * t) / (sigma * F.sqrt(t))
    return F.exp(-r * t) * (f * norm_cdf(d1) - k * norm_cdf(d1 - sigma * F.sqrt(t)))


def bachelier_call(f: Column, k: Column, t: Column, sigma: Column) -> Column:
    sd = sigma * F.sqrt(t)
    return (f - k) * norm_cdf((f - k) / sd) + sd * norm_pdf((f - k) / sd)


def digital_option(s: Column, k: Column, t: Column, r: Column, sigma: Column) -> Column:
    """Pays 1 if the price ends above k."""
    return F.exp(-r * t) * norm_cdf((F.ln(s / k) + (r - sigma * sigma / 2) * t) / (sigma * F.sqrt(t)))


def bond_duration(coupon: Column, rate: Column, periods: Column) -> Column:
    """Macaulay duration in periods, of a bond of face 1."""
    ts = F.sequence(F.lit(1), periods.cast("int"))
    weighted = F.aggregate(ts, F.lit(0.0), lambda a, t: a + t * coupon / F.pow(1 + rate, t)) + periods / F.pow(1 + rate, periods)
    return weighted / bond_price(F.lit(1.0), coupon, rate, periods)


def forward_rate(r1: Column, t1: Column, r2: Column, t2: Column) -> Column:
    """Continuously compounded, between the two times."""
    return (r2 * t2 - r1 * t1) / (t2 - t1)


def vasicek_bond_price(r: Column, a: float, b: float, sigma: float, t: Column) -> Column:
    bt = (1 - F.exp(-a * t)) / a
    at = F.exp((b - sigma * sigma / (2 * a * a)) * (bt - t) - sigma * sigma * bt * bt / (4 * a))
    return at * F.exp(-bt * r)


def kelly_fraction(p: Column, odds: Column) -> Column:
    return p - (1 - p) / odds


def historical_cvar(r: DataFrame, x: str, by: list[str], level: float) -> DataFrame:
    """Minus the mean of the int((1-level) n) smallest values, of one at least."""
    n = F.greatest(F.lit(1), F.floor(F.round(F.lit(1 - level) * F.col("_n"), 9)))
    kept = F.greatest(F.lit(0), F.least(F.col("_hi"), n) - (F.col("_hi") - F.col("_c")))
    return _ranked(r, x, by).withColumn("_k", kept).groupBy(*by).agg((-F.sum(F.col("_k") * F.col(x)) / F.sum("_k")).alias("cvar"))


def portfolio_variance(weights: DataFrame, covariance: DataFrame) -> DataFrame:
    """weights: i, w; covariance: i, j, v."""
    one = covariance.join(weights, "i").select("j", (F.col("v") * F.col("w")).alias("x"))
    return one.join(weights.withColumnRenamed("i", "j"), "j").agg(F.sum(F.col("x") * F.col("w")).alias("variance"))


def bachelier_put(f: Column, k: Column, t: Column, sigma: Column) -> Column:
    sd = sigma * F.sqrt(t)
    return (k - f) * norm_cdf((k - f) / sd) + sd * norm_pdf((f - k) / sd)


def bond_modified_duration(coupon: Column, rate: Column, periods: Column) -> Column:
    return bond_duration(coupon, rate, periods) / (1 + rate)


def bond_convexity(coupon: Column, rate: Column, periods: Column) -> Column:
    """In periods squared, of a bond of face 1."""
    paid = F.aggregate(F.sequence(F.lit(1), periods.cast("int")), F.lit(0.0), lambda a, t: a + t * (t + 1) * coupon / F.pow(1 + rate, t + 2))
    return (paid + periods * (periods + 1) / F.pow(1 + rate, periods + 2)) / bond_price(F.lit(1.0), coupon, rate, periods)


def _halved(steps: int, low: float, high: float, above) -> Column:
    """By bisection: above(mid) tells whether the root lies higher."""
    span = lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))

    def step(s: Column, _: Column) -> Column:
        # arrays of one, so that the middle and its side are computed once
        tried = F.transform(F.array((s["a"] + s["b"]) / 2), lambda mid: F.struct(mid.alias("mid"), above(mid).alias("up")))
        return F.get(F.transform(tried, lambda t: span(F.when(t["up"], t["mid"]).otherwise(s["a"]), F.when(t["up"], s["b"]).otherwise(t["mid"]))), F.lit(0))

    last = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span(F.lit(low), F.lit(high)), step)
    return (last["a"] + last["b"]) / 2


def bond_ytm(price: Column, face: Column, coupon: Column, periods: Column) -> Column:
    """The yield from 0 to 1 at which the bond has its price."""
    return _halved(60, 0.0, 1.0, lambda y: bond_price(face, coupon, y, periods) > price)


def implied_volatility(price: Column, s: Column, k: Column, t: Column, r: Column, call: bool = True) -> Column:
    """From 0 to 5, by bisection, as the price rises with it."""
    return _halved(48, 1e-6, 5.0, lambda v: black_scholes(s, k, t, r, v, call) < price)


def irr(flows: Column, guess: float = 0.1, rounds: int = 100) -> Column:
    """Of an array of cash flows from now on, by Newton's steps from guess."""
    ts = F.sequence(F.lit(0), F.size(flows) - 1)

    def step(rate: Column, _: Column) -> Column:
        paid = F.zip_with(flows, ts, lambda c, t: c / F.pow(1 + rate, t))
        value = F.aggregate(paid, F.lit(0.0), lambda a, x: a + x)
        slope = F.aggregate(F.zip_with(paid, ts, lambda x, t: -t * x / (1 + rate)), F.lit(0.0), lambda a, x: a + x)
        return F.when(F.abs(value) < 1e-10, rate).otherwise(rate - value / slope)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(guess), step)


def present_value(rate: Column, periods: Column, payment: Column, future: Column) -> Column:
    """With the sign of what is paid for it: minus the value of what comes in."""
    d = F.pow(1 + rate, periods)
    return F.when(F.abs(rate) < 1e-12, -payment * periods - future).otherwise(-(payment * (1 - 1 / d) / rate + future / d))


def future_value(rate: Column, periods: Column, payment: Column, present: Column) -> Column:
    d = F.pow(1 + rate, periods)
    return F.when(F.abs(rate) < 1e-12, -present - payment * periods).otherwise(-(present * d + payment * (d - 1) / rate))


def continuous_compound(principal: Column, rate: Column, t: Column) -> Column:
    return principal * F.exp(rate * t)


def capm(rate: Column, beta: Column, market: Column) -> Column:
    return rate + beta * (market - rate)


def treynor_ratio(r: DataFrame, rate: float, beta: float) -> DataFrame:
    return r.groupBy("g").agg(((F.avg("r") - rate) / beta).alias("treynor"))


def information_ratio(r: DataFrame) -> DataFrame:
    """r: g, r, b (the benchmark's return of the same period)."""
    excess = F.col("r") - F.col("b")
    return r.groupBy("g").agg(F.try_divide(F.avg(excess), F.stddev_samp(excess)).alias("information"))


def max_drawdown(s: DataFrame) -> DataFrame:
    """g, drawdown: the greatest fall from an earlier peak, as a share of it; s: g, idx, v."""
    peak = F.max("v").over(W.partitionBy("g").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    return s.select("g", F.try_divide(peak - F.col("v"), peak).alias("d")).groupBy("g").agg(F.greatest(F.lit(0.0), F.max("d")).alias("drawdown"))


def portfolio_return(weights: DataFrame, returns_: DataFrame) -> DataFrame:
    """weights: i, w; returns_: i, r."""
    return weights.join(returns_, "i").agg(F.sum(F.col("w") * F.col("r")).alias("portfolio_return"))


def cir_bond_price(r: Column, a: float, b: float, sigma: float, t: Column) -> Column:
    h = (a * a + 2 * sigma * sigma) ** 0.5
    e = F.expm1(h * t)
    below = (h + a) * e + 2 * h
    log_a = 2 * a * b / (sigma * sigma) * F.ln(2 * h * F.exp((a + h) * t / 2) / below)
    return F.when(t <= 0, F.lit(1.0)).otherwise(F.exp(log_a - 2 * e / below * r))


def geometric_asian(s: Column, k: Column, t: Column, r: Column, sigma: Column, fixings: int, call: bool = True) -> Column:
    """On the geometric mean of equally spaced fixings: Black's formula with its own volatility and drift."""
    n = float(max(fixings, 1))
    own = sigma * ((n + 1) * (2 * n + 1) / (6 * n * n)) ** 0.5
    forward = s * F.exp((own * own / 2 + (n + 1) / (2 * n) * (r - sigma * sigma / 2)) * t)
    value = black76(forward, k, t, r, own)
    return value if call else value - F.exp(-r * t) * (forward - k)


def binomial_option(s: Column, k: Column, t: Column, r: Column, sigma: Column, steps: int, call: bool = True, american: bool = False) -> Column:
    """A tree of equal steps, folded back from its last level; an American option may be exercised on each level."""
    dt = t / steps
    up = F.exp(sigma * F.sqrt(dt))
    p = (F.exp(r * dt) - 1 / up) / (up - 1 / up)
    worth = lambda x: F.greatest(x - k if call else k - x, F.lit(0.0))
    spot = lambda level, i: s * F.pow(up, 2 * i - level)
    last = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: worth(spot(F.lit(steps), i)))

    def back(prices: Column, level: Column) -> Column:
        def one(i: Column) -> Column:
            held = F.exp(-r * dt) * (p * F.get(prices, i + 1) + (1 - p) * F.get(prices, i))
            return F.greatest(held, worth(spot(level, i))) if american else held

        return F.transform(F.sequence(F.lit(0), level), one)

    return F.get(F.aggregate(F.sequence(F.lit(steps - 1), F.lit(0)), last, back), F.lit(0))
