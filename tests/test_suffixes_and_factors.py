"""Suffix order and its transform against a plain sort, factors against numpy from the same start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.operators import factorize, suffixes

TEXTS = {1: "banana", 2: "", 3: "a" * 300, 4: "abcabcabc" * 12, 5: "grün \x00ü", 6: "x"}


def _plain(text):
    b = text.encode()
    order = sorted(range(len(b) + 1), key=lambda p: b[p:])
    return [(r, b[p - 1] if p else 0, p == 0) for r, p in enumerate(order)]


def _texts(spark):
    rows = [*TEXTS.items(), (None, "no id"), (7, None), (1, "apple")]
    return spark.createDataFrame(rows, "id int, text string")


def test_transform_and_back(spark):
    b = suffixes.bwt(suffixes.symbols(_texts(spark), "id", "text")).cache()
    got = {}
    for r in b.orderBy("g", "row").collect():
        got.setdefault(r["g"], []).append((r["row"], r["c"], r["end"]))
    assert got == {g: _plain(t) for g, t in TEXTS.items() if t}
    back = {}
    for r in suffixes.ibwt(b).orderBy("g", "pos").collect():
        back.setdefault(r["g"], []).append(r["c"])
    assert {g: bytes(c).decode() for g, c in back.items()} == {g: t for g, t in TEXTS.items() if t}


def test_blocks_and_dealt_ties(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 8)
    monkeypatch.setattr(suffixes, "TIE", 5)
    df = spark.createDataFrame([(0, "ab" * 40 + "a" * 60)], "id int, text string")
    got = suffixes.bwt(suffixes.symbols(df, "id", "text")).orderBy("row").collect()
    assert [(r["row"], r["c"], r["end"]) for r in got] == _plain("ab" * 40 + "a" * 60)


def test_a_column_as_one_text(spark):
    df = spark.createDataFrame([(k, w) for k, w in enumerate("red green red blau grün red".split())] + [(9, None)], "id int, w string")
    s = suffixes.column_symbols(df, "id", "w")
    assert [r["text"] for r in suffixes.lines(suffixes.ibwt(suffixes.bwt(s))).orderBy("line").collect()] == "red green red blau grün red".split()


def test_no_texts(spark):
    s = suffixes.symbols(_texts(spark).where("id > 99"), "id", "text")
    assert suffixes.bwt(s).isEmpty() and suffixes.ibwt(suffixes.bwt(s)).isEmpty()


def _tensor(spark, shape=(7, 5, 4), hot=True):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, shape).astype(float)
    rows = [(*map(int, p), float(x[p])) for p in np.ndindex(*shape) if x[p]]
    if hot:  # a cell of many rows
        rows += [(0, 0, 0, 1.0)] * 200
        x[0, 0, 0] += 200
    rows += [(None, 1, 1, 5.0), (1, 1, 1, None)]
    return x, spark.createDataFrame(rows, "i long, j long, k long, v double")


def _start(spark, t, modes, rank):
    made = factorize._Tensor(t, modes, "v", rank, 0)
    return [np.array([list(r)[1:] for r in f.orderBy(k).collect()]) for f, k in zip(made.factors, made.keys)]


@pytest.mark.parametrize("bound", [0, 2_000_000])
def test_cp_equals_numpy(spark, monkeypatch, bound):
    monkeypatch.setattr(factorize, "BROADCAST_VALUES", bound)
    x, t = _tensor(spark)
    modes, rounds = ["i", "j", "k"], 4
    f = _start(spark, t, modes, 2)
    errors = []
    for _ in range(rounds):
        f[0] = np.einsum("ijk,jr,kr->ir", x, f[1], f[2]) @ np.linalg.pinv((f[1].T @ f[1]) * (f[2].T @ f[2]))
        f[1] = np.einsum("ijk,ir,kr->jr", x, f[0], f[2]) @ np.linalg.pinv((f[0].T @ f[0]) * (f[2].T @ f[2]))
        f[2] = np.einsum("ijk,ir,jr->kr", x, f[0], f[1]) @ np.linalg.pinv((f[0].T @ f[0]) * (f[1].T @ f[1]))
        errors.append(np.linalg.norm(x - np.einsum("ir,jr,kr->ijk", *f)))
    made, weights, got = factorize.cp(t, modes, 2, rounds=rounds, tolerance=0)
    assert np.allclose(got, errors, rtol=1e-6) and all(b <= a + 1e-9 for a, b in zip(got, got[1:]))
    cells = {(r["i"], r["j"], r["k"]): r["v"] for r in factorize.reconstruct(made, modes, weights).collect()}
    want = np.einsum("ir,jr,kr->ijk", *f)
    assert len(cells) == x.size and all(abs(want[p] - v) < 1e-5 for p, v in cells.items())
    for m in made:
        assert all(abs(r[0] - 1) < 1e-9 for r in m.groupBy("component").agg(F.sum(F.col("x") ** 2)).select("sum(POWER(x, 2))").collect())


def test_nmf_equals_numpy(spark):
    x, t = _tensor(spark, (8, 6, 1))
    a, rounds = x[:, :, 0], 5
    w, h = _start(spark, t, ["i", "j"], 3)
    h, errors = h.T, []
    for _ in range(rounds):
        h = h * (w.T @ a) / (w.T @ w @ h + 1e-12)
        w = w * (a @ h.T) / (w @ h @ h.T + 1e-12)
        errors.append(np.linalg.norm(a - w @ h))
    gw, gh, got = factorize.nmf(t, 3, rounds=rounds, tolerance=0)
    assert np.allclose(got, errors, rtol=1e-6) and all(b <= a + 1e-9 for a, b in zip(got, got[1:]))
    cells = {(r["i"], r["j"]): r["v"] for r in factorize.reconstruct([gw, gh], ["i", "j"]).collect()}
    assert all(abs((w @ h)[p] - v) < 1e-6 for p, v in cells.items()) and gw.where("x < 0").isEmpty()


def test_negative_and_empty(spark):
    t = spark.createDataFrame([(0, 0, -1.0)], "i long, j long, v double")
    with pytest.raises(ValueError):
        factorize.nmf(t, 1)
    made, weights, errors = factorize.cp(t.where("v > 0"), ["i", "j"], 1)
    assert weights == [0.0] and errors == [] and all(f.isEmpty() for f in made)
