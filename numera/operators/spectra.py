"""Power spectra of series by windowed, overlapping segments: a series of any length is split by segment, never held whole."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transforms import _each, rfftfreq


def _sizes(length: int, overlap: float) -> tuple[int, int, float]:
    """The step between segments, their padded length, and the window's energy."""
    from math import cos

    energy = sum((0.5 - 0.5 * cos(2 * pi * t / max(length - 1, 1))) ** 2 for t in range(length)) if length > 1 else 1.0
    return max(1, int(length * (1 - overlap))), 1 << (length - 1).bit_length(), energy


def _segments(s: DataFrame, length: int, overlap: float, keys: list[str], v: str = "v") -> DataFrame:
    """keys, segment, k, re, im: half of the transform of each whole segment under a Hann window, zero-padded to a power of
    two. Null values are 0; rows with a null key or index are left out; series shorter than a segment have none."""
    step, n, _ = _sizes(length, overlap)
    s = s.dropna(subset=[*keys, "idx"]).select(*keys, F.col("idx").cast("long").alias("idx"), F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias("v"))
    total = s.groupBy(*keys).agg((F.max("idx") + 1).alias("_n"))
    last = F.least(F.floor(F.col("idx") / step), F.floor((F.col("_n") - length) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - length + 1) / step))
    held = s.join(total, keys).where(F.col("_n") >= length).where(first <= last).select(*keys, "idx", "v", F.explode(F.sequence(first, last)).alias("segment"))
    at = F.col("idx") - F.col("segment") * step
    window = 0.5 - 0.5 * F.cos(2 * pi * at / max(length - 1, 1)) if length > 1 else F.lit(1.0)
    points = held.select(*keys, "segment", at.alias("_at"), (F.col("v") * window).alias("re"), F.lit(0.0).alias("im"), F.lit(n).cast("long").alias("_points"))
    return _each(points, [*keys, "segment"], "_points", "_at").where(F.col("freq") <= n // 2).withColumnRenamed("freq", "k")


def _one_sided(k: Column, n: int) -> Column:
    return F.when((k > 0) & (k < n // 2), 2.0).otherwise(1.0)


def welch_psd(s: DataFrame, rate: float, length: int, overlap: float = 0.5) -> DataFrame:
    """g, k, frequency, psd: the mean power density of a series' segments, one-sided, without detrending."""
    _, n, energy = _sizes(length, overlap)
    power = F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (rate * energy)
    return _segments(s, length, overlap, ["g"]).groupBy("g", "k").agg(power.alias("p")).select("g", "k", rfftfreq(F.col("k"), F.lit(n), 1 / rate).alias("frequency"), (F.col("p") * _one_sided(F.col("k"), n)).alias("psd"))


def spectrogram(s: DataFrame, rate: float, length: int, overlap: float = 0.5) -> DataFrame:
    """g, segment, time (of a segment's middle), k, frequency, magnitude."""
    step, n, _ = _sizes(length, overlap)
    return _segments(s, length, overlap, ["g"]).select("g", "segment", ((F.col("segment") * step + length / 2) / rate).alias("time"), "k", rfftfreq(F.col("k"), F.lit(n), 1 / rate).alias("frequency"), F.hypot("re", "im").alias("magnitude"))


def coherence(s: DataFrame, x: str, y: str, rate: float, length: int, overlap: float = 0.5) -> DataFrame:
    """g, k, frequency, coherence (0 to 1) of the columns x and y of one table of series; without power on a side: 0."""
    _, n, _ = _sizes(length, overlap)
    both = s.select("g", "idx", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(v).cast("double").alias("v")) for c, v in ((0, x), (1, y))))).alias("z")).select("g", "idx", "z.*")
    f = _segments(both, length, overlap, ["g", "side"])
    pick = lambda c, side: F.sum(F.when(F.col("side") == side, F.col(c)))
    f = f.groupBy("g", "segment", "k").agg(pick("re", 0).alias("a"), pick("im", 0).alias("b"), pick("re", 1).alias("c"), pick("im", 1).alias("d"))
    a, b, c, d = (F.col(n_) for n_ in "abcd")
    sums = f.groupBy("g", "k").agg(F.sum(a * a + b * b).alias("xx"), F.sum(c * c + d * d).alias("yy"), F.sum(a * c + b * d).alias("re"), F.sum(b * c - a * d).alias("im"))
    value = F.least(F.lit(1.0), (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("xx") * F.col("yy")))
    return sums.select("g", "k", rfftfreq(F.col("k"), F.lit(n), 1 / rate).alias("frequency"), F.when(F.col("xx") * F.col("yy") > 0, value).otherwise(0.0).alias("coherence"))
