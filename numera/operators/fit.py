"""Distance from a distribution, partial autocorrelation, inflation of variances, signed ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums
from .stats import acf, average_ranks, gram


def ks_test(df: DataFrame, x: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """d: the largest distance of the sample's distribution from cdf, a function of a column. Equal values are counted
    before they are ordered; nulls are left out; an empty sample gives null."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    steps = running_sums(counts, [], [F.col("_x")], {"_upto": "_c"})
    total = counts.agg(F.sum("_c").alias("_n"))  # one row
    f, n = cdf(F.col("_x")), F.col("_n")
    gap = F.greatest(F.col("_upto") / n - f, f - (F.col("_upto") - F.col("_c")) / n)
    return steps.join(F.broadcast(total)).agg(F.max(gap).alias("d"))


def pacf(series: DataFrame, max_lag: int, g: str = "g", idx: str = "idx", v: str = "v") -> DataFrame:
    """g, lag, pacf by the Durbin-Levinson recursion over the autocorrelations; lag 0 is 1, no spread gives 0."""
    r = acf(series, max_lag, g, idx, v).groupBy(g).agg(F.map_from_entries(F.collect_list(F.struct("lag", "acf"))).alias("r"))
    at = lambda a, k: F.element_at(a, F.lit(k))
    # of each round: the coefficients so far, and the last ones of all rounds
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))

    def step(s: Column, k: Column) -> Column:
        phi, r_ = s["phi"], F.col("r")
        back = F.zip_with(phi, F.reverse(phi), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        num = F.aggregate(F.transform(phi, lambda p, j: p * F.element_at(r_, (k - j - 1).cast("int"))), F.element_at(r_, k), lambda t, p: t - p)
        den = F.aggregate(F.transform(phi, lambda p, j: p * F.element_at(r_, (j + 1).cast("int"))), F.lit(1.0), lambda t, p: t - p)
        new = F.when(F.abs(den) > 1e-14, num / den).otherwise(0.0)
        bound = F.transform(F.array(new), lambda n: F.struct(F.concat(F.transform(back, lambda q: q["a"] - n * q["b"]), F.array(n)).alias("phi"), F.concat(s["out"], F.array(n)).alias("out")))
        return bound[0]

    out = F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, step)["out"]
    return r.select(g, F.posexplode(out).alias("lag", "pacf"))


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, vif of each of the columns: 1 / (1 - R squared) of its regression on the others, without an intercept, about its
    own mean. One aggregate over the rows without a null; the sums are as many as the pairs of columns. No spread gives 1,
    a column that the others make up gives infinity."""
    import numpy as np

    g = gram(df.withColumn("_one", F.lit(1.0)), [*columns, "_one"])
    rows = []
    for j, name in enumerate(columns):
        other = [k for k in range(len(columns)) if k != j]
        beta = np.linalg.lstsq(g[np.ix_(other, other)], g[other, j], rcond=None)[0]
        left = g[j, j] - beta @ g[other, j]
        spread = g[j, j] - g[j, -1] ** 2 / g[-1, -1] if g[-1, -1] else 0.0
        kept = left / spread if spread > 0 else 1.0
        rows.append((name, float("inf") if kept <= 1e-14 else float(1 / kept)))
    return df.sparkSession.createDataFrame(rows, "name string, vif double")


def wilcoxon_signed_rank(df: DataFrame, x: str, y: str) -> DataFrame:
    """w_plus, w_minus, n: sums of the average ranks of the absolute differences by sign; equal pairs and nulls are left out."""
    d = df.select((F.col(x) - F.col(y)).alias("_d")).where("_d <> 0").withColumn("_abs", F.abs("_d"))
    side = lambda up: F.coalesce(F.sum(F.when((F.col("_d") > 0) == up, F.col("_rank"))), F.lit(0.0))
    return average_ranks(d, "_abs").agg(side(F.lit(True)).alias("w_plus"), side(F.lit(False)).alias("w_minus"), F.count("*").alias("n"))
