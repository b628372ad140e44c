"""Roots and minima of a function of one variable, for each row: f takes and gives columns and may use others of the row.

Each search takes a fixed number of steps inside one expression; a row that has converged stays where it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Function = Callable[[Column], Column]


def _let(value: Column, f: Function) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _state(**fields: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for n, c in fields.items()))


def _steps(n: int, start: Column, step: Function) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda s, _: step(s))


def bisection(f: Function, a: Column, b: Column, steps: int = 60) -> Column:
    """The middle of an interval in which f changes its sign; null where it has the same sign at a and b."""

    def step(s: Column) -> Column:
        mid = (s["a"] + s["b"]) / 2
        return _let(F.struct(mid.alias("m"), (F.signum(f(mid)) == F.signum(f(s["a"]))).alias("same")), lambda t: _state(a=F.when(t["same"], t["m"]).otherwise(s["a"]), b=F.when(t["same"], s["b"]).otherwise(t["m"])))

    last = _steps(steps, _state(a=a, b=b), step)
    return F.when(f(a) == 0, a).when(f(b) == 0, b).when(f(a) * f(b) < 0, (last["a"] + last["b"]) / 2)


def illinois(f: Function, a: Column, b: Column, steps: int = 40) -> Column:
    """False position, where a side that stays twice counts half; null where f has the same sign at a and b."""

    def step(s: Column) -> Column:
        x = F.when(s["g"] == s["f"], s["b"]).otherwise(s["b"] - s["g"] * (s["b"] - s["a"]) / (s["g"] - s["f"]))

        def moved(t: Column) -> Column:
            over = F.signum(t["y"]) * F.signum(s["g"]) < 0
            return _state(a=F.when(over, s["b"]).otherwise(s["a"]), f=F.when(over, s["g"]).otherwise(s["f"] / 2), b=t["x"], g=t["y"])

        return F.when(s["g"] == 0, s).otherwise(_let(_let(x, lambda v: _state(x=v, y=f(v))), moved))

    return F.when(f(a) * f(b) <= 0, _steps(steps, _state(a=a, f=f(a), b=b, g=f(b)), step)["b"])


def secant(f: Function, a: Column, b: Column, steps: int = 40) -> Column:
    def step(s: Column) -> Column:
        x = F.when(s["g"] == s["f"], s["b"]).otherwise(s["b"] - s["g"] * (s["b"] - s["a"]) / (s["g"] - s["f"]))
        return _let(x, lambda v: _state(a=s["b"], f=s["g"], b=v, g=f(v)))

    return _steps(steps, _state(a=a, f=f(a), b=b, g=f(b)), step)["b"]


def newton(f: Function, x0: Column, steps: int = 60, h: float = 1e-6) -> Column:
    """With the slope by central differences."""
    return _steps(steps, x0.cast("double"), lambda x: x - F.coalesce(F.try_divide(2 * h * f(x), f(x + h) - f(x - h)), F.lit(0.0)))


def halley(f: Function, df: Function, d2f: Function, x0: Column, steps: int = 50) -> Column:
    def step(x: Column) -> Column:
        return _let(_state(y=f(x), d=df(x), e=d2f(x)), lambda t: x - F.coalesce(F.try_divide(2 * t["y"] * t["d"], 2 * t["d"] * t["d"] - t["y"] * t["e"]), F.lit(0.0)))

    return _steps(steps, x0.cast("double"), step)


def fixed_point(g: Function, x0: Column, steps: int = 200) -> Column:
    return _steps(steps, x0.cast("double"), g)


def golden_section(f: Function, a: Column, b: Column, steps: int = 60) -> Column:
    """The place of the minimum of a function with one valley between a and b."""
    share = (5**0.5 - 1) / 2

    def step(s: Column) -> Column:
        low, high = s["b"] - share * (s["b"] - s["a"]), s["a"] + share * (s["b"] - s["a"])
        return _let((f(low) < f(high)), lambda left: _state(a=F.when(left, s["a"]).otherwise(low), b=F.when(left, high).otherwise(s["b"])))

    last = _steps(steps, _state(a=a, b=b), step)
    return (last["a"] + last["b"]) / 2
