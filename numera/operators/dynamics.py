"""Initial value problems, one a row, and filters with a state, one a series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def euler(f: Callable[[Column, Column], Column], t0: float, y0: Column, end: float, steps: int) -> Column:
    """y at end of y' = f(t, y), as one expression for each row."""
    h = (end - t0) / steps
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), y0.cast("double"), lambda y, i: y + h * f(t0 + h * i, y))


def rk4(f: Callable[[Column, Column], Column], t0: float, y0: Column, end: float, steps: int) -> Column:
    h = (end - t0) / steps
    let = lambda v, g: F.transform(F.array(v), g)[0]  # noqa: E731  each stage is computed once

    def step(y: Column, i: Column) -> Column:
        t = t0 + h * i
        return let(f(t, y), lambda a: let(f(t + h / 2, y + h / 2 * a), lambda b: let(f(t + h / 2, y + h / 2 * b), lambda c: y + h / 6 * (a + 2 * b + 2 * c + f(t + h, y + h * c)))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), y0.cast("double"), step)


def kalman(s: DataFrame, q: float, r: float, x0: float = 0.0, p0: float = 1.0) -> DataFrame:
    """g, idx, v: the scalar random-walk filter's estimate after each value. Series are streamed; two numbers are held."""

    def run(it):
        import pandas as pd

        g, x, p = object(), x0, p0
        for part in it:
            out = []
            for k, z in zip(part["g"], part["v"]):
                if k != g:
                    g, x, p = k, x0, p0
                p += q
                gain = p / (p + r)
                x, p = x + gain * (z - x), (1 - gain) * p
                out.append(x)
            yield pd.DataFrame({"g": part["g"], "idx": part["idx"], "v": out})

    return s.select("g", "idx", "v").repartition("g").sortWithinPartitions("g", "idx").mapInPandas(run, "g long, idx long, v double")


def ema(s: DataFrame, alpha: float) -> DataFrame:
    """Exponential moving average: a filter that starts at the first value."""

    def run(it):
        import pandas as pd

        g, y = object(), 0.0
        for part in it:
            out = []
            for k, v in zip(part["g"], part["v"]):
                y = v if k != g else alpha * v + (1 - alpha) * y
                g = k
                out.append(y)
            yield pd.DataFrame({"g": part["g"], "idx": part["idx"], "v": out})

    return s.select("g", "idx", "v").repartition("g").sortWithinPartitions("g", "idx").mapInPandas(run, "g long, idx long, v double")
