"""Trees, forests and boosting against an exact search for cuts."""

import random

import numpy as np
import pytest

from numera.operators import resampling, trees


def grown(x, y, w, depth, classes):
    """The same tree by trying every cut: a function from a row to a value."""

    def spread(k):
        n = w[k].sum()
        if classes:
            return n - sum(w[k][y[k] == c].sum() ** 2 for c in set(y)) / n
        return (w[k] * y[k] ** 2).sum() - (w[k] * y[k]).sum() ** 2 / n

    def value(k):
        if classes:
            return max(sorted(set(y)), key=lambda c: w[k][y[k] == c].sum())
        return (w[k] * y[k]).sum() / w[k].sum()

    def node(k, left):
        if not left or len(k) < 2 or len(set(y[k])) < 2:
            return lambda r, v=value(k): v
        cuts = []
        for f in range(x.shape[1]):
            v = np.unique(x[k, f])
            for t in (v[1:] + v[:-1]) / 2:
                a, b = k[x[k, f] <= t], k[x[k, f] > t]
                cuts.append((round((spread(a) + spread(b)) / spread(k), 10), f, t))
        if not cuts:
            return lambda r, v=value(k): v
        _, f, t = min(cuts)
        a, b = node(k[x[k, f] <= t], left - 1), node(k[x[k, f] > t], left - 1)
        return lambda r: a(r) if r[f] <= t else b(r)

    return node(np.flatnonzero(w > 0), depth)


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(9)), rng.randrange(40) / 8, 1.0 if rng.random() < 0.33 else float(rng.randrange(30))) for k in range(160)]
    rows = [(*r, float((r[1] > 4) + (r[2] > 2.5) + (rng.random() < 0.1)), r[1] * 2 - r[3] + rng.random()) for r in rows]
    bad = [(900, None, 1.0, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0, 1.0), (902, 1.0, 1.0, 1.0, None, None)]
    df = spark.createDataFrame([*rows, *rows[:30], *bad], "id long, a double, b double, c double, k double, v double").repartition(5)
    return df, rows + rows[:30]


def predicted(df, model):
    return {r["id"]: r["prediction"] for r in trees.predict(df, model).collect()}


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_tree_of_classes_and_of_numbers(data, depth):
    df, rows = data
    x, w = np.array([r[1:4] for r in rows]), np.ones(len(rows))
    for target, col, criterion in (("k", 4, "gini"), ("v", 5, "mse")):
        want = grown(x, np.array([r[col] for r in rows]), w, depth, criterion == "gini")
        got = predicted(df, trees.decision_tree(df, ["a", "b", "c"], target, depth, criterion))
        assert np.allclose([got[r[0]] for r in rows], [want(r[1:4]) for r in rows], rtol=1e-9)
        assert got[900] is None and got[901] is None and got[902] is not None


def test_many_values_are_binned(spark):
    rng = random.Random(6)
    rows = [(k, rng.random()) for k in range(3000)]
    df = spark.createDataFrame([(k, a, 10.0 * (a > 0.5)) for k, a in rows], "id long, a double, y double")
    model = trees.decision_tree(df, ["a"], "y", 2, "mse", bins=32)
    assert model.trees[0]["feature"][1] == 0 and abs(model.trees[0]["cut"][1] - 0.5) < 1 / 32
    assert len(trees.bin_edges(df.selectExpr("array(a) AS x"), 1, 32)[0]) <= 32


def test_forest_votes_and_does_not_depend_on_partitions(spark, data):
    df, rows = data
    one, two = (trees.random_forest(d, ["a", "b", "c"], "k", "id", 7, 3, seed=3) for d in (df, df.repartition(1)))
    assert one.trees == two.trees and len({str(t) for t in one.trees}) == 7
    hashes = {r["id"]: r["h"] for r in df.selectExpr("id", "xxhash64(id) AS h").collect()}
    draws = resampling.weights(np.array([hashes[r[0]] for r in rows]), 7, 3)
    assert 0.8 < draws.mean() < 1.2 and draws.max() > 2
    some = random.Random(3)
    chosen = [sorted(some.sample(range(3), 2)) for _ in range(7)]
    y = np.array([r[4] for r in rows])
    x = np.array([r[1:4] for r in rows])
    parts = [grown(x[:, c], y, draws[:, t], 3, True) for t, c in enumerate(chosen)]
    got = predicted(df, one)
    for r in rows:
        said = [f([r[1 + k] for k in c]) for f, c in zip(parts, chosen)]
        assert got[r[0]] == max(sorted(set(said)), key=said.count)


def test_boosting_follows_the_residuals(spark, data, monkeypatch):
    df, rows = data
    monkeypatch.setattr(trees, "WRITE_EVERY", 2)
    x, y = np.array([r[1:4] for r in rows]), np.array([r[5] for r in rows])
    want = np.full(len(y), y.mean())
    for _ in range(5):
        t = grown(x, y - want, np.ones(len(y)), 2, False)
        want += 0.3 * np.array([t(r) for r in x])
    got = predicted(df, trees.gradient_boosting(df, ["a", "b", "c"], "v", 5, 2, 0.3))
    assert np.allclose([got[r[0]] for r in rows], want, rtol=1e-8)


def test_empty_table(data):
    df, _ = data
    none = df.limit(0)
    assert set(predicted(df.where("id < 3"), trees.decision_tree(none, ["a", "b"], "k", 2)).values()) == {0.0}
    with pytest.raises(ValueError):
        trees.decision_tree(df, ["a"], "k", 40)


def test_rows_of_equal_features_are_one(spark):
    """A fit to numbers takes as many rows as there are combinations of features, and the trees are those of the rows."""
    import numpy as np

    from numera.operators import trees

    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(a * b + e)) for a, b, e in zip(rng.integers(0, 6, 3000), rng.integers(0, 5, 3000), rng.normal(0, 1, 3000))]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    assert trees._numbers(df, ["a", "b"], "y", 256).count() == 30
    model = trees.gradient_boosting(df, ["a", "b"], "y", n_trees=3, depth=2, rate=0.5)
    x, rest = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    rest = rest - rest.mean()
    for tree in model.trees.trees:
        leaf = trees._walk(tree, x)
        for k in np.unique(leaf):
            assert abs(tree["value"][k] - rest[leaf == k].mean()) < 1e-9
        rest = rest - 0.5 * np.array(tree["value"])[leaf]
