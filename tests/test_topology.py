"""Complexes and their components against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np

from numera.operators import topology


def _points(spark, n=150, copies=40):
    rng = np.random.default_rng(5)
    at = [tuple(map(float, p)) for p in rng.random((n, 2))] + [(0.5, 0.5)] * copies
    rows = [(k, *p) for k, p in enumerate(at)]
    return rows, spark.createDataFrame([*rows, (None, 0.1, 0.1), (9999, None, 0.2)], "id long, x double, y double")


def _edges(rows, radius):
    pairs = ((a, b, float(np.hypot(p - r, q - s))) for (a, p, q), (b, r, s) in combinations(rows, 2))
    return {(a, b): d for a, b, d in pairs if d <= radius}


def test_complex(spark):
    rows, df = _points(spark, 120, 6)
    want = _edges(rows, 0.15)
    edges = topology.rips_edges(df, 0.15)
    assert {(r["a"], r["b"]) for r in edges.collect()} == set(want)
    triangles = {(r["a"], r["b"], r["c"]): r["at"] for r in topology.rips_triangles(edges).collect()}
    ids = [r[0] for r in rows]
    brute = {t: max(want[p] for p in combinations(t, 2)) for t in combinations(ids, 3) if all(p in want for p in combinations(t, 2))}
    assert triangles.keys() == brute.keys() and all(abs(triangles[t] - brute[t]) < 1e-12 for t in brute)
    assert {r["dim"]: r["n"] for r in topology.rips_counts(df, 0.15).collect()} == {0: len(rows), 1: len(want), 2: len(brute)}


def test_persistence(spark):
    rows, df = _points(spark)
    root = {r[0]: r[0] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    deaths = Counter()
    for (a, b), d in sorted(_edges(rows, 0.07).items(), key=lambda e: e[1]):
        if (p := find(a)) != (q := find(b)):
            root[p] = q
            deaths[round(d, 9)] += 1
    deaths[None] = len(rows) - sum(deaths.values())
    got = Counter()
    for r in topology.persistence_of_components(df, 0.07).collect():
        got[None if r["death"] is None else round(r["death"], 9)] += r["n"]
    assert got == deaths and got[0.0] >= 39


def test_no_points(spark):
    df = _points(spark)[1].where("id < 0")
    assert topology.persistence_of_components(df, 1.0).isEmpty()
    assert {r["n"] for r in topology.rips_counts(df, 1.0).collect()} == {0}


def test_counts_move_points_not_edges(spark):
    """A crowd in which all are neighbours, with copies: counts are those of brute force, and no edge is a row of a join."""
    rng = np.random.default_rng(6)
    rows = [(k, *map(float, p)) for k, p in enumerate(np.vstack([rng.normal(0, 0.01, (700, 2)), rng.normal(0.03, 0.02, (300, 2))]).round(3))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    xy = np.array([r[1:] for r in rows])
    near = (np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) <= 0.02) & ~np.eye(len(xy), dtype=bool)
    a = near.astype(np.int64)
    got = topology.rips_counts(df, 0.02)
    assert {r["dim"]: r["n"] for r in got.collect()} == {0: 1000, 1: a.sum() // 2, 2: (a @ a * a).sum() // 6}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and plan.count("Join") <= 4
    for owners, marked in ((50, 64), (4096, 100)):
        old = topology.OWNERS, topology.MARKED
        topology.OWNERS, topology.MARKED = owners, marked
        try:
            assert topology.rips_counts(df, 0.02).collect() == got.collect()
        finally:
            topology.OWNERS, topology.MARKED = old


def test_few_edges_join_the_same(spark):
    """Crowded and lone points, and a regular grid full of ties: deaths are those of all edges; edges are a few a point."""
    rng = np.random.default_rng(7)
    grid = [(0.4 + 0.01 * i, 0.01 * j) for i in range(15) for j in range(15)]
    at = [*map(tuple, np.vstack([rng.normal(0, 0.005, (900, 2)), rng.uniform(-0.3, 0.3, (150, 2))]).tolist()), *grid]
    rows = [(k, *p) for k, p in enumerate(at)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    few = topology.joining_edges(df, 0.05)
    assert few.count() < 5 * len(rows) < topology.rips_edges(df, 0.05).count() / 10
    forest = topology.minimum_spanning_forest(topology.rips_edges(df, 0.05).select("a", "b", "at").toDF("src", "dst", "w"))
    want = Counter(round(r["w"], 9) for r in forest.collect())
    got = Counter()
    for r in topology.persistence_of_components(df, 0.05).collect():
        got[r["death"] and round(r["death"], 9)] += r["n"]
    assert got.pop(None) == len(rows) - forest.count() and got == want
