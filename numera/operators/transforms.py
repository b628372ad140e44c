"""Fourier, cosine and sine transforms of series (g, idx, v) and matrices (i, j, v), as grouped jobs.

A series of n points is cut twice into about sqrt(n) pieces of about sqrt(n) points: those that are a stride apart are
transformed, turned, and those with the same frequency are transformed again. So no task holds a whole series, however
long it is, and each transform costs two shuffles of its points.
"""

from __future__ import annotations

from math import cos, pi, sin, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points that a Python worker gives back at a time.
POINTS = 1_000_000


def _transformed(it):
    """Rows of keys, size, at, re, im (arrays) to rows of keys, freq, re, im."""
    import numpy as np
    import pyarrow as pa

    for b in it:
        keys, names = b.columns[:-4], [*b.schema.names[:-4], "freq", "re", "im"]
        size = b.column(len(keys)).to_numpy()
        start = b.column(len(keys) + 1).offsets.to_numpy()
        at, re, im = (b.column(len(keys) + k).values.to_numpy(zero_copy_only=False) for k in (1, 2, 3))
        first = 0
        while first < len(size):
            last = first + max(1, int(np.searchsorted(np.cumsum(size[first:]), POINTS, "right")))
            found = []
            for r in range(first, last):
                own = slice(start[r], start[r + 1])
                x = np.zeros(size[r], complex)
                x[at[own]] = re[own] + 1j * im[own]
                found.append(np.fft.fft(x))
            rows, flat = np.repeat(np.arange(first, last), size[first:last]), np.concatenate(found)
            freq = np.concatenate([np.arange(n) for n in size[first:last]])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in keys), pa.array(freq), pa.array(flat.real.copy()), pa.array(flat.imag.copy())], names)
            first = last


def _each(points: DataFrame, keys: list[str], size: str, at: str) -> DataFrame:
    """keys, freq, re, im: the transforms of the points (at, re, im) with equal keys, absent ones being 0."""
    r = points.groupBy(*keys, F.col(size).alias("_size")).agg(F.collect_list(F.struct(F.col(at).alias("at"), "re", "im")).alias("r"))
    r = r.select(*keys, "_size", "r.at", "r.re", "r.im")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in r.schema.fields[: len(keys)])
    return r.mapInArrow(_transformed, f"{schema}, freq long, re double, im double")


def _padded(n: Column) -> Column:
    """The number of bits of the next power of two."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def fft(s: DataFrame, by: list[str] | None = None, idx: str = "idx", re: str = "v", im: str | None = None, inverse: bool = False) -> DataFrame:
    """by, k, re, im: of each series, zero-padded to a power of two n, the sums of v exp(-2 pi i k idx / n); inverse: with
    the other sign, divided by n.

    Indices count from 0, each once; absent ones and null values are 0. Rows with a null index or key are left out. An
    empty table gives an empty result.
    """
    by = by or ["g"]
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sign = -1.0 if inverse else 1.0
    x = s.dropna(subset=[*by, idx]).select(*by, F.col(idx).cast("long").alias("_t"), zero(re).alias("re"), (sign * zero(im) if im else F.lit(0.0)).alias("im"))
    half = lambda up: F.pow(F.lit(2.0), F.floor((F.col("_bits") + up) / 2)).cast("long")
    sizes = x.groupBy(*by).agg(_padded(F.max("_t") + 1).alias("_bits")).select(*by, half(0).alias("_n1"), half(1).alias("_n2"))
    x = x.join(sizes, by).withColumns({"_b": F.col("_t") % F.col("_n1"), "_a": F.floor(F.col("_t") / F.col("_n1"))})
    y = _each(x, [*by, "_n1", "_n2", "_b"], "_n2", "_a").withColumnRenamed("freq", "_d")
    n = F.col("_n1") * F.col("_n2")
    turn = -2 * pi * ((F.col("_b") * F.col("_d")) % n) / n
    c, sn = F.cos(turn), F.sin(turn)
    y = y.select(*by, "_n1", "_n2", "_b", "_d", (F.col("re") * c - F.col("im") * sn).alias("re"), (F.col("re") * sn + F.col("im") * c).alias("im"))
    z = _each(y, [*by, "_n1", "_n2", "_d"], "_n1", "_b")
    scale = 1 / n if inverse else F.lit(1.0)
    return z.select(*by, (F.col("_n2") * F.col("freq") + F.col("_d")).alias("k"), (F.col("re") * scale).alias("re"), (F.col("im") * sign * scale).alias("im"))


def ifft(spectrum: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, idx, re, im of a spectrum by, k, re, im, as fft gives it."""
    return fft(spectrum, by, "k", "re", "im", inverse=True).withColumnRenamed("k", "idx")


def rfft(s: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The half of fft that a series of real numbers needs: k from 0 to n / 2."""
    by = by or ["g"]
    n = s.dropna(subset=[*by, "idx"]).groupBy(*by).agg(F.pow(F.lit(2.0), _padded(F.max("idx").cast("long") + 1)).cast("long").alias("_n"))
    return fft(s, by).join(n, by).where(F.col("k") <= F.col("_n") / 2).drop("_n")


def irfft(half: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, idx, v of the half of a spectrum that rfft gives; the other half is its mirror."""
    by = by or ["g"]
    top = half.groupBy(*by).agg(F.max("k").alias("_top"))
    rest = half.join(top, by).where((F.col("k") > 0) & (F.col("k") < F.col("_top"))).select(*by, (2 * F.col("_top") - F.col("k")).alias("k"), "re", (-F.col("im")).alias("im"))
    return ifft(half.select(*by, "k", "re", "im").unionByName(rest), by).select(*by, "idx", F.col("re").alias("v"))


def fft2(a: DataFrame, inverse: bool = False) -> DataFrame:
    """i, j, re, im: along the rows, then along the columns of a matrix i, j, v (inverse: i, j, re, im)."""
    re, im = ("re", "im") if inverse else ("v", None)
    rows = fft(a, ["i"], "j", re, im, inverse).withColumnRenamed("k", "j")
    return fft(rows, ["j"], "i", "re", "im", inverse).select(F.col("k").alias("i"), "j", "re", "im")


def fftfreq(k: Column, n: Column, step: float = 1.0) -> Column:
    """The frequency of each k of n points that are a step apart; the upper half is negative."""
    return F.when(k <= (n - 1) / 2, k).otherwise(k - n) / (n * step)


def rfftfreq(k: Column, n: Column, step: float = 1.0) -> Column:
    return k / (n * step)


def fftshift(k: Column, n: Column) -> Column:
    """Where a k goes when frequency 0 is moved to the middle."""
    return (k + F.floor(n / 2)) % n


def ifftshift(k: Column, n: Column) -> Column:
    return (k + F.floor((n + 1) / 2)) % n


def goertzel(s: DataFrame, frequency: float, rate: float, by: list[str] | None = None) -> DataFrame:
    """by, re, im: the term of each series' transform, not padded, that is nearest to a frequency: a plain aggregate.
    Frequencies outside 0 to rate / 2 give 0."""
    by = by or ["g"]
    if rate <= 0 or not 0 <= frequency <= rate / 2:
        return s.groupBy(*by).agg(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    n = s.groupBy(*by).agg(F.count("*").alias("_n"))
    k = F.floor(F.lit(frequency / rate) * F.col("_n") + 0.5)
    turn = -2 * pi * ((k * F.col("idx")) % F.col("_n")) / F.col("_n")
    return s.join(n, by).groupBy(*by).agg(F.sum(F.col("v") * F.cos(turn)).alias("re"), F.sum(F.col("v") * F.sin(turn)).alias("im"))


def _basis(rows: list[list[float]], x: Column) -> Column:
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{v!r}D" for v in r) + ")" for r in rows) + ")")
    # x is bound first, else it would be worked out again for each row of the basis
    return F.transform(F.array(x), lambda y: F.transform(table, lambda r: F.aggregate(F.zip_with(r, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))[0]


def dct2(x: Column, n: int) -> Column:
    """The orthonormal cosine transform of an array of n doubles; n is small, as each term is a sum over the array."""
    return _basis([[sqrt((2 if k else 1) / n) * cos(pi * (2 * t + 1) * k / (2 * n)) for t in range(n)] for k in range(n)], x)


def idct2(x: Column, n: int) -> Column:
    """Gives back what dct2 was given."""
    return _basis([[sqrt((2 if k else 1) / n) * cos(pi * (2 * t + 1) * k / (2 * n)) for k in range(n)] for t in range(n)], x)


def dst2(x: Column, n: int) -> Column:
    """The orthonormal sine transform of the first kind, which is its own inverse."""
    return _basis([[sqrt(2 / (n + 1)) * sin(pi * (t + 1) * (k + 1) / (n + 1)) for t in range(n)] for k in range(n)], x)


idst2 = dst2
