"""Density clusters against the definition, all pairs compared."""

import random

import pytest

from numera.operators import clustering


def brute(points, eps, least):
    n = len(points)
    near = [[j for j in range(n) if j != i and sum((a - b) ** 2 for a, b in zip(points[i], points[j])) ** 0.5 <= eps] for i in range(n)]
    core = [len(k) >= least for k in near]
    label, cluster = [-1] * n, -1
    for i in range(n):
        if core[i] and label[i] < 0:
            cluster += 1
            label[i], stack = cluster, [i]
            while stack:
                for j in near[stack.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = cluster
                        stack.append(j)
    return [v if core[i] else min((label[j] for j in near[i] if core[j]), default=-1) for i, v in enumerate(label)]


def labels(spark, points, eps, least, d=2):
    names = "xyzt"[:d]
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "id long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {r["id"]: r["label"] for r in clustering.dbscan(df, eps, least, by=tuple(names)).collect()}
    return [got[k] for k in range(len(points))]


def test_blobs_borders_and_noise(spark):
    rng = random.Random(3)
    for eps, least in ((0.5, 4), (1.0, 1)):
        points = [(rng.gauss(c, 0.4), rng.gauss(-c, 0.4)) for c in (0, 2, 5) for _ in range(40)] + [(rng.uniform(-4, 8), rng.uniform(-8, 4)) for _ in range(40)]
        points += [(k / 2, 20.0) for k in range(9)]  # exactly eps apart
        rng.shuffle(points)
        assert labels(spark, points, eps, least) == brute(points, eps, least)


def test_crowded_cells_are_cut_into_boxes(spark, monkeypatch):
    monkeypatch.setattr(clustering, "SMALL", 4)
    monkeypatch.setattr(clustering, "SPLIT", 7)
    rng = random.Random(4)
    # a third at one place, crowds that nearly touch, and crowds that touch in one pair of points
    points = [(0.0, 0.0)] * 60 + [(rng.uniform(0.9, 1.1), rng.uniform(0, 0.3)) for _ in range(40)]
    points += [(rng.uniform(5, 5.3), rng.uniform(0, 0.3)) for _ in range(30)] + [(rng.uniform(6.31, 6.6), rng.uniform(0, 0.3)) for _ in range(30)]
    points += [(9.0 + rng.uniform(-0.3, 0), rng.uniform(0, 0.3)) for _ in range(20)] + [(10.0 + rng.uniform(0.001, 0.3), rng.uniform(0, 0.3)) for _ in range(20)] + [(9.0, 0.1), (10.0, 0.1)]
    rng.shuffle(points)
    assert labels(spark, points, 1.0, 5) == brute(points, 1.0, 5)


def test_one_and_three_dimensions(spark):
    rng = random.Random(5)
    for d in (1, 3):
        points = [tuple(rng.randrange(12) / 2 for _ in range(d)) for _ in range(90)]
        assert labels(spark, points, 0.5, 3, d) == brute(points, 0.5, 3)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, float("nan"), 0.0), (3, 1.0, 1.0), (None, 1.0, 1.0)], "id long, x double, y double")
    assert sorted((r["id"] or 0, r["label"]) for r in clustering.dbscan(df, 1.0, 1).collect()) == [(0, 0), (3, 0)]
    assert clustering.dbscan(df.limit(0), 1.0, 1).count() == 0
    with pytest.raises(ValueError):
        clustering.dbscan(df, 0.0, 1)
