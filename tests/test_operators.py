"""Fixtures with known answers, and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from numera.functions import descriptive as D
from numera.functions import number
from numera.functions.formula import FormulaError, formula
from numera.operators import geo, graph, linalg, ml, signal, stats


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_descriptive_values(spark):
    row = column(spark, [3, 1, 4, 1.5, 9, 2.6]).agg(F.min("x"), F.max("x"), D.mean(F.col("x")), D.percentile(F.col("x"), 50)).first()
    assert row[0] == 1.0 and row[1] == 9.0 and math.isclose(row[2], 21.1 / 6) and row[3] == 2.6
    assert column(spark, [1, 2, 3, 4, 5]).agg(D.percentile(F.col("x"), 50)).first()[0] == 3


def test_empty_and_constant(spark):
    x = F.col("x")
    measures = [D.mean(x), D.var(x), D.median(x), D.skewness(x), D.kurtosis(x), D.harmonic_mean(x), D.rms(x)]
    assert column(spark, []).agg(*measures).first()[:] == (0.0,) * 7
    row = column(spark, [2, 2, 2, 2]).agg(D.skewness(x), D.kurtosis(x), D.stddev(x)).first()
    assert row[:] == (0.0, 0.0, 0.0)
    assert math.isnan(column(spark, [1, -1]).agg(D.geometric_mean(x)).first()[0])


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0)], "k int, x double")
    assert [r["_rank"] for r in stats.average_ranks(df, "x").orderBy("k").collect()] == [1.5, 1.5, 3.0]
    one = df.withColumn("g", F.lit(1))
    assert stats.percentiles(one, "x", ["g"], [50]).first()["p50"] == 5.0
    assert stats.trimmed_mean(one, "x", ["g"], 0.5).first()["trimmed_mean"] == 5.0


def test_signal(spark):
    s = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([100, 110, 105, 120, 90, 95])], "g long, idx long, v double")
    assert signal.max_drawdown(s).first()["drawdown"] == 0.25
    got = signal.iir_filter(s, [0.5], [1.0, -0.5]).orderBy("idx").collect()
    y = 0.0
    for r, v in zip(got, [100, 110, 105, 120, 90, 95]):
        y = 0.5 * v + 0.5 * y
        assert math.isclose(r["v"], y)
    power = {r["k"]: r["power"] for r in signal.periodogram(s).collect()}
    assert math.isclose(power[0], 620.0**2 / 6)


def test_matrices(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)], "i long, j long, v double")
    got = {(r["i"], r["j"]): r["v"] for r in linalg.matmul(a, a).collect()}
    assert got == {(0, 0): 7, (0, 1): 10, (1, 0): 15, (1, 1): 22}
    v = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, v double")
    w = spark.createDataFrame([(0, 4.0), (1, 5.0), (2, 6.0)], "i long, v double")
    assert linalg.einsum("i,i->", v, w).first()["v"] == 32
    assert math.isclose(linalg.power_iteration(spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "i long, j long, v double"), 2), (5 + 5**0.5) / 2, rel_tol=1e-9)


def test_graph(spark):
    barbell = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (7, 8)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in barbell], "src long, dst long, w double")
    assert {r["id"]: r["component"] for r in graph.connected_components(e).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 7: 7, 8: 7}
    assert {r["id"]: r["triangles"] for r in graph.triangles(e).collect()} == {k: 1 for k in range(6)}
    assert {r["src"] for r in graph.k_core(e, 2).collect()} == set(range(6))
    ring = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, w double")
    assert math.isclose(sum(r["rank"] for r in graph.pagerank(ring).collect()), 1.0)


def test_geometry(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 0.0), (1, 1.0, 1.0), (1, 0.0, 1.0), (1, 0.5, 0.5)], "g long, x double, y double")
    assert geo.convex_hull(p).count() == 4
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    assert p.where(geo.in_polygon(F.col("x"), F.col("y"), square) & (F.col("x") == 0.5)).count() == 1


def test_scores(spark):
    df = spark.createDataFrame([(0.9, 1.0), (0.8, 1.0), (0.2, 0.0), (0.1, 0.0)], "p double, y double")
    assert ml.roc_auc(df, "p", "y").first()["auc"] == 1.0
    two = [(i, [float(i)]) for i in range(10)] + [(10 + i, [100.0 + i]) for i in range(10)]
    c = {r["id"]: r["cluster"] for r in ml.kmeans(spark.createDataFrame(two, "id long, vec array<double>"), 2).collect()}
    assert len({c[i] for i in range(10)}) == 1 and c[0] != c[19]


def test_numbers(spark):
    n = spark.range(1, 60)
    for r in n.select("id", number.is_prime(F.col("id")).alias("p"), number.totient(F.col("id")).alias("t"), number.collatz_steps(F.col("id")).alias("c")).collect():
        k = r["id"]
        assert r["p"] == (k > 1 and all(k % d for d in range(2, k))) and r["t"] == sum(math.gcd(k, j) == 1 for j in range(1, k + 1))


def test_formula(spark):
    row = spark.createDataFrame([(4.0,)], "x double").select(formula("x^2 + 3*x", ["x"]), formula("1/0"), formula("-sin(pi*0)", [])).first()
    assert row[0] == 28 and row[1] is None and row[2] == 0
    for bad in ("nosuch(1)", "= 3", "x.y", "__import__('os')", "y"):
        with pytest.raises(FormulaError):
            formula(bad, ["x"])


def test_incomplete_rows_are_left_out(spark):
    from numera.operators import ml, models, stats

    kind = "id long, vec array<double>"
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, None), (4, [None, 1.0])], kind)
    assert {(r["i"], r["j"]): r["v"] for r in models.covariance(rows).collect()} == {(0, 0): 2.0, (0, 1): 3.0, (1, 0): 3.0, (1, 1): 4.5}
    assert {r["id"]: r["cluster"] for r in ml.kmeans(rows, 2).collect()} == {1: 0, 2: 1}
    assert ml.kmeans(rows.limit(0), 2).count() == 0 and models.covariance(rows.limit(0)).count() == 0
    flat = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 100.0), (9.0, None)], "x double, y double")
    fit = {r["name"]: round(r["coefficient"], 9) for r in models.ridge(flat, ["x"], "y", 0.0).collect()}
    assert fit == {"intercept": 1.0, "x": 2.0}
    assert {r["coefficient"] for r in models.ridge(flat.limit(0), ["x"], "y", 1.0).collect()} == {0.0}
    assert stats.gram(flat, ["x", "y"])[1, 1] == 83.0


def test_running_sums_over_ranges(spark):
    import random

    from numera.operators import ml, stats
    from numera.operators.running import running_sums
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(g, x, rng.randrange(5)) for g in ("a", "b", None) for x in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, x int, n long")
    got = {(r["g"], r["x"]): r["t"] for r in running_sums(df, ["g"], [F.col("x")], {"t": "n"}).collect()}
    assert got == {(g, x): sum(m for h, y, m in rows if h == g and y <= x) for g, x, _ in rows}
    assert running_sums(df.limit(0), [], [F.col("x")], {"t": "n"}).count() == 0
    # ties, nulls, and one value on a third of the rows
    scores = spark.createDataFrame([(0.5, 1.0)] * 20 + [(0.5, 0.0)] * 10 + [(i / 60, float(i % 2)) for i in range(60)] + [(None, 1.0), (0.1, None)], "p double, y double")
    pairs = [(a, b) for a, y in [(r["p"], r["y"]) for r in scores.dropna().collect()] if y == 1 for b, z in [(r["p"], r["y"]) for r in scores.dropna().collect()] if z == 0]
    want = sum(1 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs)
    assert abs(ml.roc_auc(scores, "p", "y").first()[0] - want) < 1e-12
    ranks = {r["p"]: r["_rank"] for r in stats.average_ranks(scores, "p").collect()}
    values = sorted(r["p"] for r in scores.collect() if r["p"] is not None)
    assert all(ranks[v] == sum(u < v for u in values) + (values.count(v) + 1) / 2 for v in ranks) and None not in ranks
