"""Components, orders, forests, centralities, iterative solvers and Kendall's tau against brute force."""

import random

import numpy as np
import pytest

from numera.operators import digraph, krylov, rank_correlation

EDGES = "src long, dst long, w double"


def test_strong_components(spark):
    rng = random.Random(1)
    # nested cycles, a chain, a hub with a third of all arcs, loops, repeats, nulls
    arcs = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3), (4, 5), (5, 6), (6, 7), (9, 9), (0, 1)] + [(rng.randrange(10, 40), rng.randrange(10, 40)) for _ in range(40)] + [(50, 100 + k) for k in range(25)] + [(100, 50)]
    reach = {v: {v} for a in arcs for v in a}
    for _ in reach:
        for a, b in arcs:
            reach[a] |= reach[b]
    want = {v: min(u for u in reach[v] if v in reach[u]) for v in reach}
    e = spark.createDataFrame([(*a, 1.0) for a in arcs] + [(None, 3, 1.0), (3, None, 1.0)], EDGES)
    assert {r["id"]: r["component"] for r in digraph.strongly_connected_components(e).collect()} == want
    assert digraph.strongly_connected_components(e.limit(0)).count() == 0


def test_topological_sort(spark):
    arcs = [(5, 1), (1, 2), (5, 2), (2, 9), (7, 9), (5, 1)]
    e = spark.createDataFrame([(*a, 1.0) for a in arcs], EDGES)
    got = [(r["id"], r["level"]) for r in digraph.topological_sort(e).orderBy("position").collect()]
    assert got == [(5, 0), (7, 0), (1, 1), (2, 2), (9, 3)]
    assert digraph.topological_sort(e.limit(0)).count() == 0
    with pytest.raises(digraph.CycleError):
        digraph.topological_sort(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (0, 1, 1.0)], EDGES))


def test_spanning_forest_with_ties(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randrange(4))) for _ in range(90)] + [(40, 41, 2.0), (41, 40, 1.0), (7, 7, 0.0)]
    parent = {v: v for e in edges for v in e[:2]}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = set()
    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if top(a) != top(b):
            parent[top(a)] = top(b)
            want.add((a, b, w))
    got = [tuple(r) for r in digraph.minimum_spanning_forest(spark.createDataFrame([*edges, (1, 2, None), (None, 2, 0.0)], EDGES)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert digraph.minimum_spanning_forest(spark.createDataFrame([], EDGES)).count() == 0


def test_betweenness_and_closeness_do_not_depend_on_batches(spark):
    path = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (0, 1, 5.0)], EDGES)
    for batches in (1, 2):
        assert {r["id"]: r["betweenness"] for r in digraph.betweenness_centrality(path, batches).collect()} == {0: 0.0, 1: 0.5, 2: 0.0}
        assert {r["id"]: r["closeness"] for r in digraph.closeness_centrality(path, batches).collect()} == {0: 2 / 7, 1: 1 / 3, 2: 0.0}


def entries(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double")


def vector(spark, b):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")


def test_solvers_on_the_small_system(spark):
    a = np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 4]])
    want = np.linalg.solve(a, [1, 2, 3])
    for solve in (krylov.cg, krylov.gmres, krylov.lsqr):
        got = solve(entries(spark, a), vector(spark, [1, 2, 3]))
        assert got.residual < 1e-9
        assert np.allclose([r["x"] for r in got.x.orderBy("j").collect()], want)
    zero = krylov.cg(entries(spark, a), vector(spark, [0, 0, 0]))
    assert zero.rounds == 0 and {r["x"] for r in zero.x.collect()} == {0.0}


def test_gmres_restarts_and_lsqr_of_a_tall_matrix(spark):
    rng = np.random.default_rng(3)
    a = np.eye(12) * 6 + rng.normal(size=(12, 12))
    b = rng.normal(size=12)
    got = krylov.gmres(entries(spark, a), vector(spark, b), restart=5, tol=1e-8)
    assert got.residual < 1e-8 and np.allclose([r["x"] for r in got.x.orderBy("j").collect()], np.linalg.solve(a, b), atol=1e-6)
    tall, c = rng.normal(size=(15, 4)), rng.normal(size=15)
    fit = krylov.lsqr(entries(spark, tall), vector(spark, c))
    assert np.allclose([r["x"] for r in fit.x.orderBy("j").collect()], np.linalg.lstsq(tall, c, rcond=None)[0], atol=1e-7)


def test_kendall(spark, monkeypatch):
    monkeypatch.setattr(rank_correlation, "BLOCK", 16)
    rng = random.Random(4)
    # an x with a third of all rows, ties in both, nulls
    rows = [(float(rng.randrange(60)), float(rng.randrange(40))) for _ in range(200)] + [(30.0, float(k)) for k in range(100)]
    score = sum(((a > c) - (a < c)) * ((b > d) - (b < d)) for k, (a, b) in enumerate(rows) for c, d in rows[:k])
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "x double, y double")
    assert abs(rank_correlation.kendall(df, "x", "y").first()["tau"] - score / (300 * 299 / 2)) < 1e-12
    assert rank_correlation.kendall(df.limit(0), "x", "y").first()["tau"] == 0.0
