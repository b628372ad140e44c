"""Transforms of long, uneven, null and empty series against numpy."""

import numpy as np
from pyspark.sql import functions as F

from numera.operators import transforms


def test_long_and_uneven_series(spark):
    rng = np.random.default_rng(3)
    sizes = {1: 1, 2: 2, 3: 5, 4: 1000, 5: 40_000}
    data = {g: rng.normal(size=n) for g, n in sizes.items()}
    s = spark.createDataFrame([(g, t, float(v)) for g, x in data.items() for t, v in enumerate(x)], "g long, idx long, v double")
    got = transforms.fft(s).toPandas().sort_values(["g", "k"])
    for g, x in data.items():
        own = got[got.g == g]
        n = 1 << (len(x) - 1).bit_length()
        assert own.k.tolist() == list(range(n))
        assert np.allclose(own.re + 1j * own.im, np.fft.fft(x, n), atol=1e-6)


def test_nulls_and_empty(spark):
    s = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, None, 5.0), (None, 0, 2.0), (1, 3, 2.0)], "g long, idx long, v double")
    got = transforms.fft(s).orderBy("k").toPandas()
    assert np.allclose(got.re + 1j * got.im, np.fft.fft([1, 0, 0, 2]))
    for f in (transforms.fft, transforms.rfft):
        assert f(s.where("g = 7")).count() == 0
    assert transforms.irfft(transforms.rfft(s)).orderBy("idx").toPandas().v.round(9).tolist() == [1, 0, 0, 2]


def test_matrix_there_and_back(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(8, 4))
    a = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(8) for j in range(4)], "i long, j long, v double")
    f = transforms.fft2(a)
    p = f.toPandas()
    want = np.fft.fft2(m)
    assert np.allclose(p.re + 1j * p.im, [want[i, j] for i, j in zip(p.i, p.j)])
    back = transforms.fft2(f, inverse=True).toPandas()
    assert np.allclose(back.re, [m[i, j] for i, j in zip(back.i, back.j)]) and np.allclose(back.im, 0)


def test_frequencies(spark):
    n = 9
    k = spark.range(n).select("id", transforms.fftfreq(F.col("id"), F.lit(n), 0.5).alias("f"), transforms.fftshift(F.col("id"), F.lit(n)).alias("s")).orderBy("id").toPandas()
    assert np.allclose(k.f, np.fft.fftfreq(n, 0.5))
    moved = np.empty(n)
    moved[k.s.to_numpy()] = np.arange(n)
    assert moved.tolist() == np.fft.fftshift(np.arange(n)).tolist()
