"""Bootstrap by Poisson weights: every resample is drawn in one pass, and no row is copied or moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of weights: with 1,000 resamples, 16 MB.
BLOCK = 2_048
#: Rows that are drawn at a time, and the binary digits of a draw that are looked up.
ROWS, FIRST_BITS = 32, 12
FIRST = 1 << FIRST_BITS


def weights(hashes, resamples: int, seed: int):
    """A matrix of Poisson weights with mean 1, one row a hash and one column a resample, the same wherever it is drawn."""
    import numpy as np

    p, total, limits = np.exp(-1.0), 0.0, []
    for k in range(1, 19):
        total, p = total + p, p / k
        limits.append(total)
    steps = (np.arange(1, resamples + 1, dtype=np.uint64) + np.uint64(resamples * seed)) * np.uint64(0x9E3779B97F4A7C15)
    limits = np.array(limits)
    # the first digits of a draw tell its weight, but for those that a limit cuts in two
    first = np.arange(FIRST + 1) / FIRST
    low, high = np.searchsorted(limits, first[:-1], side="right"), np.searchsorted(limits, np.nextafter(first[1:], 0), side="right")
    table, cut = low.astype(np.uint8), low != high
    out = np.empty((len(hashes), resamples))
    hashes = hashes.astype(np.uint64)
    for at in range(0, len(hashes), ROWS):  # few enough for a processor's cache
        z = hashes[at : at + ROWS, None] ^ steps[None, :]
        t = np.empty_like(z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values of a public mixing function
            np.right_shift(z, np.uint64(shift), out=t)
            z ^= t
            z *= np.uint64(factor)
        np.right_shift(z, np.uint64(31), out=t)
        z ^= t
        np.right_shift(z, np.uint64(64 - FIRST_BITS), out=t)
        k = t.view(np.int64)
        w = table[k]
        some = np.nonzero(cut[k])
        w[some] = np.searchsorted(limits, (z[some] >> np.uint64(11)) / 2.0**53, side="right")
        out[at : at + ROWS] = w
    return out


def bootstrap_ci(df: DataFrame, x: str, id_: str, by: list[str] | None = None, level: float = 0.95, resamples: int = 1000, seed: int = 42, statistic: str = "mean") -> DataFrame:
    """by, estimate, lower, upper, std_error of a group's mean, sum, variance or std (both with n - 1).

    In a resample a row occurs as often as a Poisson draw from a hash of its id, the resample and the seed says, so results
    do not depend on partitions, but for the last digits of sums; rows of equal ids are drawn together. Bounds are the
    values at places int(a R) and int((1 - a) R) of the R sorted resamples. Each task sends one row a group and resample.
    Null and NaN values are left out; a null in by is a group; an empty table gives an empty result, or without groups none.
    """
    by = by or []
    import numpy as np

    if statistic not in ("mean", "sum", "variance", "std"):
        raise ValueError(statistic)
    value = F.col(x).cast("double")
    name = F.to_json(F.struct(F.lit(0).alias("_"), *by), {"ignoreNullFields": "false"})
    rows = df.select(F.struct(F.lit(0).alias("_"), *by).alias("g"), name.alias("name"), value.alias("x"), F.xxhash64(id_).alias("h")).where("x IS NOT NULL AND NOT isnan(x)")
    # sums are taken of the distance from the group's mean, as squares of large values lose their digits
    centre = rows.groupBy("name").agg(F.any_value("g").alias("g"), F.avg("x").alias("m"))
    centred = rows.drop("g").join(centre.drop("g"), "name").select("name", (F.col("x") - F.col("m")).alias("x"), "h")

    def sums(it):
        import pandas as pd

        found = {}
        for b in it:
            for name, part in b.groupby("name"):
                v = part["x"].to_numpy()
                h = part["h"].to_numpy().view(np.uint64)
                total = found.setdefault(name, np.zeros((3, resamples + 1)))
                total[:, 0] += [len(v), v.sum(), (v * v).sum()]
                for k in range(0, len(v), BLOCK):
                    total[:, 1:] += np.stack([np.ones(len(v)), v, v * v])[:, k : k + BLOCK] @ weights(h[k : k + BLOCK], resamples, seed)
        for name, t in found.items():
            yield pd.DataFrame({"name": name, "r": range(resamples + 1), "n": t[0], "s": t[1], "q": t[2]})

    added = centred.mapInPandas(sums, "name string, r int, n double, s double, q double").groupBy("name", "r").agg(*(F.sum(c).alias(c) for c in "nsq"))
    n, s, q, m = (F.col(c) for c in "nsqm")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), q - s * s / n) / (n - 1))
    values = {"mean": F.when(n > 0, m + s / n), "sum": s + m * n, "variance": variance, "std": F.sqrt(variance)}
    got = added.join(centre, "name").select("g", "r", values[statistic].alias("v"))
    drawn = F.array_sort(F.collect_list(F.when(F.col("r") > 0, F.col("v"))))  # one value a resample
    a = (1 - level) / 2
    at = lambda k: F.get("drawn", F.least(F.lit(int(k * resamples)), F.size("drawn") - 1))
    out = got.groupBy("g").agg(F.max(F.when(F.col("r") == 0, F.col("v"))).alias("estimate"), drawn.alias("drawn"), F.stddev_samp(F.when(F.col("r") > 0, F.col("v"))).alias("std_error"))
    return out.select(*(F.col(f"g.{c}").alias(c) for c in by), "estimate", at(a).alias("lower"), at(1 - a).alias("upper"), "std_error")
