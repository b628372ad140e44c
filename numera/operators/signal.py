"""Operators over series g, idx, v: each looks at a bounded number of neighbours, or keeps running sums."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _o(g: str = "g"):
    return W.partitionBy(g).orderBy("idx")


def moving_average(s: DataFrame, w: int) -> DataFrame:
    """Trailing mean over w values, over fewer at the start."""
    return s.select("g", "idx", F.avg("v").over(_o().rowsBetween(-(w - 1), 0)).alias("v"))


def median_filter(s: DataFrame, w: int) -> DataFrame:
    """Median over the w values around each, w odd; the ends keep their values."""
    h, o = w // 2, _o()
    inside = F.lag("idx", h).over(o).isNotNull() & F.lead("idx", h).over(o).isNotNull()
    near = F.sort_array(F.array(*(F.lead("v", k).over(o) if k > 0 else F.lag("v", -k).over(o) for k in range(-h, h + 1))))
    return s.select("g", "idx", F.when(inside, near[h]).otherwise(F.col("v")).alias("v"))


def savgol_weights(w: int, order: int) -> list[float]:
    """Weights of the value at the middle of a least-squares polynomial over w points."""
    import numpy as np

    h = w // 2
    a = np.vander(np.arange(-h, h + 1), order + 1, increasing=True).astype(float)
    return [float(x) for x in np.linalg.pinv(a)[0]]


def savgol(s: DataFrame, w: int, order: int) -> DataFrame:
    """Smoothing by polynomials, w odd; the ends keep their values."""
    h, o, c = w // 2, _o(), savgol_weights(w, order)
    inside = F.lag("idx", h).over(o).isNotNull() & F.lead("idx", h).over(o).isNotNull()
    total = sum((F.lit(c[k + h]) * (F.lead("v", k).over(o) if k > 0 else F.lag("v", -k).over(o)) for k in range(-h, h + 1)), F.lit(0.0))
    return s.select("g", "idx", F.when(inside, total).otherwise(F.col("v")).alias("v"))


def unwrap(s: DataFrame, discont: float = 3.141592653589793) -> DataFrame:
    """Phases without jumps of more than discont: a running sum of turns."""
    pi = 3.141592653589793
    d = F.col("v") - F.lag("v").over(_o())
    turn = F.when(F.abs(d) > discont, -2 * pi * F.round(d / (2 * pi))).otherwise(0.0)
    jumps = s.select("g", "idx", "v", F.coalesce(turn, F.lit(0.0)).alias("t"))
    return jumps.select("g", "idx", (F.col("v") + F.sum("t").over(_o().rowsBetween(W.unboundedPreceding, 0))).alias("v"))


def delta_encode(s: DataFrame) -> DataFrame:
    """The first value, then differences."""
    return s.select("g", "idx", (F.col("v") - F.coalesce(F.lag("v").over(_o()), F.lit(0.0))).alias("v"))


def delta_decode(s: DataFrame) -> DataFrame:
    return s.select("g", "idx", F.sum("v").over(_o().rowsBetween(W.unboundedPreceding, 0)).alias("v"))


def run_lengths(s: DataFrame) -> DataFrame:
    """g, first_idx, v, n: runs of equal neighbours."""
    new = F.coalesce((F.col("v") != F.lag("v").over(_o())).cast("int"), F.lit(1))
    runs = s.select("g", "idx", "v", new.alias("new")).select("g", "idx", "v", F.sum("new").over(_o().rowsBetween(W.unboundedPreceding, 0)).alias("r"))
    return runs.groupBy("g", "r").agg(F.min("idx").alias("first_idx"), F.min("v").alias("v"), F.count("*").alias("n")).drop("r")


def downsample(s: DataFrame, n: int) -> DataFrame:
    return s.where(F.col("idx") % n == 0).select("g", F.expr(f"idx div {n}").alias("idx"), "v")


def upsample(s: DataFrame, n: int) -> DataFrame:
    """n-1 zeros after each value."""
    return s.select("g", "idx", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("g", (F.col("idx") * n + F.col("k")).alias("idx"), F.when(F.col("k") == 0, F.col("v")).otherwise(0.0).alias("v"))


def xcorr(a: DataFrame, b: DataFrame, max_lag: int) -> DataFrame:
    """g, lag, v: sum of a[i] b[i+lag], lags from -max_lag to max_lag; not normalised."""
    shifted = a.select("g", F.col("v").alias("x"), "idx", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")).withColumn("j", F.col("idx") + F.col("lag"))
    return shifted.join(b.select("g", F.col("idx").alias("j"), F.col("v").alias("y")), ["g", "j"]).groupBy("g", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def convolve(s: DataFrame, kernel: list[float]) -> DataFrame:
    """Full convolution with a short kernel."""
    taps = F.posexplode(F.array(*(F.lit(float(k)) for k in kernel))).alias("j", "k")
    return s.select("g", "idx", "v", taps).groupBy("g", (F.col("idx") + F.col("j")).alias("idx")).agg(F.sum(F.col("v") * F.col("k")).alias("v"))


def binomial_kernel(n: int) -> list[float]:
    return [comb(n, k) / 2**n for k in range(n + 1)]


def max_drawdown(s: DataFrame) -> DataFrame:
    """g, drawdown: the largest fall from a running peak, as a share of it; values that are not positive are left out."""
    p = s.where("v > 0").select("g", "v", F.max("v").over(_o().rowsBetween(W.unboundedPreceding, 0)).alias("peak"))
    return p.groupBy("g").agg(F.max((F.col("peak") - F.col("v")) / F.col("peak")).alias("drawdown"))


def window_function(spark, name: str, n: int) -> DataFrame:
    """idx, w of a symmetric window of n points: hamming, hanning or blackman."""
    x = 2 * 3.141592653589793 * F.col("id") / max(n - 1, 1)
    w = {"hamming": 0.54 - 0.46 * F.cos(x), "hanning": 0.5 - 0.5 * F.cos(x), "blackman": 0.42 - 0.5 * F.cos(x) + 0.08 * F.cos(2 * x)}[name]
    return spark.range(n).select(F.col("id").alias("idx"), w.alias("w"))


def periodogram(s: DataFrame) -> DataFrame:
    """g, k, power: of each series, zero-padded to a power of two. A series is one numpy array: it has to fit a task."""

    def one(p):
        import numpy as np
        import pandas as pd

        x = p.sort_values("idx")["v"].to_numpy()
        n = 1 << max(0, (len(x) - 1).bit_length())
        y = np.abs(np.fft.rfft(x, n)) ** 2 / max(len(x), 1)
        return pd.DataFrame({"g": p["g"].iloc[0], "k": np.arange(len(y)), "power": y})

    return s.groupBy("g").applyInPandas(one, "g long, k long, power double")


def iir_filter(s: DataFrame, b: list[float], a: list[float]) -> DataFrame:
    """y[i] = sum b[k] x[i-k] - sum a[k] y[i-k], a[0] = 1. Series are streamed in order: only the delay line is held."""

    def run(it):
        import pandas as pd

        g, xs, ys = object(), [], []
        for p in it:
            out = []
            for k, v in zip(p["g"], p["v"]):
                if k != g:
                    g, xs, ys = k, [0.0] * len(b), [0.0] * (len(a) - 1)
                xs = [v, *xs[: len(b) - 1]]
                y = sum(c * x for c, x in zip(b, xs)) - sum(c * x for c, x in zip(a[1:], ys))
                ys = [y, *ys[: len(a) - 2]] if len(a) > 1 else []
                out.append(y)
            yield pd.DataFrame({"g": p["g"], "idx": p["idx"], "v": out})

    return s.select("g", "idx", "v").repartition("g").sortWithinPartitions("g", "idx").mapInPandas(run, "g long, idx long, v double")
