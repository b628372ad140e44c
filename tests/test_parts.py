"""Parts of graphs: solved in tasks where they are small, by rounds where they are large, with the same results."""

import random

import numpy as np
import pytest

from numera.operators import digraph, krylov, parts


def _strong(arcs):
    reach = {v: {v} for a in arcs for v in a}
    for _ in reach:
        for a, b in arcs:
            reach[a] |= reach[b]
    return {v: min(u for u in reach[v] if v in reach[u]) for v in reach}


def _arcs(rng):
    # chains with steps back, a crowd, a hub, loops and repeats; dealt at random, so that parts lie in many tasks
    arcs = [(100 * c + k, 100 * c + k + 1) for c in range(1, 9) for k in range(9)] + [(100 * c + k, 100 * c + k - 2) for c in range(1, 9) for k in range(2, 10, c)]
    arcs += [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(1000, 1001 + k) for k in range(20)] + [(1007, 1000), (2000, 2000), (101, 102), (-5, -7), (-7, -5)]
    return rng.sample(arcs, len(arcs))


@pytest.mark.parametrize("whole", [0, 30, 1 << 17])
def test_strong_components_of_small_and_large_parts(spark, monkeypatch, whole):
    monkeypatch.setattr(parts, "WHOLE", whole)
    arcs = _arcs(random.Random(5))
    e = spark.createDataFrame(arcs, "src long, dst long").repartition(4)
    rows = [tuple(r) for r in digraph.strongly_connected_components(e).collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == _strong(arcs)


def test_parts_are_found_across_tasks(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(300) if k % 50 != 49], "src long, dst long").repartition(7)
    assert {(r["src"], r["_part"]) for r in parts.parted(e).collect()} == {(k, k - k % 50) for k in range(300) if k % 50 != 49}


def test_small_parts_take_no_rounds(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("rounds for small parts")

    monkeypatch.setattr(digraph, "_coloured", fail)
    e = spark.createDataFrame([(10 * c + k, 10 * c + (k + 1) % 5) for c in range(50) for k in range(5)], "src long, dst long")
    got = {r["id"]: r["component"] for r in digraph.strongly_connected_components(e).collect()}
    assert got == {10 * c + k: 10 * c for c in range(50) for k in range(5)}


def test_strong_components_of_names(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert {tuple(r) for r in digraph.strongly_connected_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_a_long_cycle_in_a_task():
    n = 20_000
    ids, found = digraph._strong(np.arange(n), (np.arange(n) + 1) % n)
    assert (found == 0).all() and len(ids) == n


def _springs(n_chains, length):
    m = np.eye(n_chains * length)
    for c in range(n_chains):
        for k in range(c * length, (c + 1) * length - 1):
            m[np.ix_([k, k + 1], [k, k + 1])] += np.array([[1, -1], [-1, 1]]) * (1 + k % 5)
    return m


@pytest.mark.parametrize("whole", [0, 30, 1 << 17])
def test_cg_of_small_and_large_parts(spark, monkeypatch, whole):
    monkeypatch.setattr(parts, "WHOLE", whole)
    # chains of 6, and one of 16 that has more than 30 entries
    m = np.zeros((46, 46))
    m[:30, :30], m[30:, 30:] = _springs(5, 6), _springs(1, 16)
    b = np.arange(46.0) - 7
    b[3] = 0
    # an entry that is the sum of two, nulls, and an unknown without a right-hand side
    a = [(i, j, float(v) / 2) for (i, j), v in np.ndenumerate(m) if v for _ in range(2)] + [(None, 1, 1.0), (1, None, 1.0), (1, 2, None)]
    rhs = [(i, float(x)) for i, x in enumerate(b) if i != 3] + [(None, 1.0), (2, None)]
    got = krylov.cg(spark.createDataFrame(a, "i long, j long, v double").repartition(5), spark.createDataFrame(rhs, "i long, v double"))
    x = {r["j"]: r["x"] for r in got.x.collect()}
    assert got.x.count() == len(x) == 46 and got.residual < 1e-10
    assert np.allclose([x[k] for k in range(46)], np.linalg.solve(m, b))


def test_cg_of_small_parts_takes_no_rounds(spark, monkeypatch):
    def fail(*_):
        raise AssertionError("rounds for small parts")

    monkeypatch.setattr(krylov, "cg_by_rounds", fail)
    m = _springs(6, 5)
    a = spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double")
    got = krylov.cg(a, spark.createDataFrame([(i, 1.0) for i in range(30)], "i long, v double"))
    assert np.allclose([r["x"] for r in got.x.orderBy("j").collect()], np.linalg.solve(m, np.ones(30)))


@pytest.mark.parametrize("whole", [40, 1 << 17])
def test_gmres_of_small_and_large_parts(spark, monkeypatch, whole):
    monkeypatch.setattr(parts, "WHOLE", whole)
    rng = np.random.default_rng(7)
    m = np.diag(rng.uniform(2, 3, 60))
    for k in range(59):  # chains of 10, one way, and a crowd
        m[k, k + 1] = rng.uniform(-1, 1) if k % 10 != 9 and k < 50 else 0
    m[50:, 50:] += rng.normal(size=(10, 10)) / 4
    b = np.where(np.arange(60) % 7, rng.normal(size=60), 0)
    a = [(i, j, float(v) / 2) for (i, j), v in np.ndenumerate(m) if v for _ in range(2)] + [(None, 1, 5.0), (1, None, 5.0), (1, 2, None)]
    rhs = [(i, float(v)) for i, v in enumerate(b) if v] + [(None, 1.0), (3, None)]
    got = krylov.gmres_by_parts(spark.createDataFrame(a, "i long, j long, v double").repartition(5), spark.createDataFrame(rhs, "i long, v double"), restart=6)
    x = {r["j"]: r["x"] for r in got.x.collect()}
    assert got.x.count() == len(x) == 60 and got.residual < 1e-10
    assert np.allclose([x[k] for k in range(60)], np.linalg.solve(m, b))


def test_linalg_gmres_takes_no_rounds(spark, monkeypatch, tmp_path):
    def fail(*_):
        raise AssertionError("rounds for small parts")

    from numera.plans import queries

    monkeypatch.setattr(krylov, "gmres", fail)
    orders = spark.range(60).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "date_add(DATE'1995-01-01', int(id)) AS o_orderdate", "concat(1 + id % 5, '-X') AS o_orderpriority", "1000.25D * id AS o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["i"]: r["b"] for r in queries.queries()["linalg_gmres"](spark, str(tmp_path)).collect()}
    assert got.keys() == set(range(60)) and all(abs(got[k] - 1.00025 * k) < 1e-8 for k in got)


def test_gmres_in_a_task_ends_where_the_residual_does_not_fall():
    m = np.array([[0.0, 0.0], [0.0, 2.0]])
    x, square, rounds = krylov._gmres(5, 1000, 1e-12)(lambda p: m @ p, np.array([3.0, 4.0]))
    assert abs(square - 9) < 1e-9 and rounds < 10 and np.allclose(m @ x, [0, 4])
    assert krylov._gmres(5, 1000, 1e-12)(lambda p: m @ p, np.zeros(2))[1:] == (0.0, 0)
