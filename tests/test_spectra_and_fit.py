"""Spectra, tests of fit and decompositions: against numpy, with nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.operators import decompose, fit, spectra


def _series(spark, x):
    return spark.createDataFrame([(1, t, None if v is None else float(v)) for t, v in enumerate(x)], "g long, idx long, v double")


def test_pacf_solves_yule_walker(spark):
    x = np.cumsum(np.random.default_rng(1).normal(size=80)) * 0.3
    d = x - x.mean()
    r = np.array([(d[k:] * d[: len(d) - k]).sum() for k in range(7)]) / (d * d).sum()
    got = fit.pacf(_series(spark, x), 6).orderBy("lag").toPandas().pacf
    assert got[0] == 1
    for k in range(1, 7):
        assert np.isclose(got[k], np.linalg.solve([[r[abs(i - j)] for j in range(k)] for i in range(k)], r[1 : k + 1])[-1])


def test_welch_of_one_long_series(spark):
    x = np.random.default_rng(2).normal(size=3000)
    s = _series(spark, x)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 63)
    p = np.mean([np.abs(np.fft.rfft(x[a : a + 64] * w)) ** 2 for a in range(0, 3000 - 63, 32)], axis=0) / (10 * (w * w).sum())
    p[1:-1] *= 2
    got = spectra.welch_psd(s, 10.0, 64).orderBy("k").toPandas()
    assert np.allclose(got.psd, p) and np.allclose(got.frequency, np.fft.rfftfreq(64, 0.1))
    assert spectra.welch_psd(s.where("idx < 60"), 10.0, 64).count() == 0
    assert spectra.spectrogram(s.where("g = 2"), 1.0, 8).count() == 0
    same = spectra.coherence(s.withColumn("u", -2 * F.col("v")), "v", "u", 1.0, 64)
    assert np.allclose(same.toPandas().coherence, 1)


def test_fit_with_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(0.1, 0.1), (0.5, 0.2), (0.5, 0.9), (None, 0.3), (0.9, None)], "x double, y double")
    # steps at 0.1, 0.5 (twice) and 0.9 of four values against the uniform distribution
    assert fit.ks_test(df, "x", lambda x: x).first().d == pytest.approx(0.25)
    assert fit.ks_test(df.where("x > 5"), "x", lambda x: x).first().d is None
    w = fit.wilcoxon_signed_rank(df, "x", "y").first()
    assert (w.w_plus, w.w_minus, w.n) == (1, 2, 2)
    empty = fit.wilcoxon_signed_rank(df.where("x > 5"), "x", "y").first()
    assert (empty.w_plus, empty.w_minus, empty.n) == (0, 0, 0)
    v = {r.name: r.vif for r in spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 1.0)], "a double, b double").transform(lambda t: fit.vif(t, ["a", "b"])).collect()}
    assert v["a"] == float("inf")
    assert {r.vif for r in fit.vif(df.where("x > 5"), ["x", "y"]).collect()} == {1.0}


def test_decompositions(spark):
    m = np.random.default_rng(3).normal(size=(30, 4))
    rows = [(i, j, float(m[i, j])) for i in range(30) for j in range(4)]
    a = spark.createDataFrame([*rows, (3, None, 1.0)], "i long, j long, v double")
    s = decompose.svd(a, 4)[1].orderBy("k").toPandas().s
    assert np.allclose(s, np.linalg.svd(m, compute_uv=False))
    q, r = decompose.qr(a, 4)
    p = q.toPandas().pivot(index="i", columns="j", values="v").to_numpy()
    assert np.allclose(p.T @ p, np.eye(4))
    row = decompose.rank_and_condition(a, 4).first()
    assert row["rank"] == 4 and np.isclose(row["condition"], np.linalg.cond(m)) and np.isclose(row["nuclear"], s.sum())
    low = a.where("j < 2").unionByName(a.where("j < 2").withColumn("j", F.col("j") + 2))
    assert decompose.rank_and_condition(low, 4).first()["rank"] == 2
    with pytest.raises(ValueError):
        decompose.qr(a.where("j < 3"), 4)
    assert decompose.svd(a.where("i > 99"), 4)[1].count() == 0
    assert decompose.lsq(a.where("i > 99"), a.select("i", "v"), 4).toPandas().x.tolist() == [0] * 4
