"""Whole jobs whose cost was found to grow too fast: results against brute force, and what the plans no longer hold."""

import numpy as np
from pyspark.sql import functions as F

from numera.operators import compress, graph, ml, resampling, running, stats


def test_medians_hold_no_group(spark):
    """Deviations and spreads from counts of values: no aggregate that keeps a group's values."""
    rng = np.random.default_rng(1)
    rows = [(str(k % 3), float(v)) for k, v in enumerate(rng.integers(0, 400, 2001) / 4)] + [("0", None), (None, 1.0), ("3", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    of = {g: np.array([x for h, x in rows if h == g and x is not None]) for g in "012"}
    got = stats.mad(df, "x", ["g"])
    assert "percentile" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    found = {r["g"]: r["mad"] for r in got.collect()}
    assert found.pop("3") is None
    assert found.keys() == of.keys() and all(abs(found[g] - 1.4826 * np.median(np.abs(x - np.median(x)))) < 1e-12 for g, x in of.items())
    away = stats.levene_test(df.where("g < '3'"), "x", "g")
    assert "percentile" not in away._jdf.queryExecution().optimizedPlan().toString().lower()
    d = {g: np.abs(x - np.median(x)) for g, x in of.items()}
    every = np.concatenate([*d.values()])
    between = sum(len(v) * (v.mean() - every.mean()) ** 2 for v in d.values()) / 2
    within = sum(((v - v.mean()) ** 2).sum() for v in d.values()) / (len(every) - 3)
    assert abs(away.first()["w"] - between / within) < 1e-9


def test_ranges_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(running, "RANGE", 100)
    seen, plain = [], running.checkpointed
    monkeypatch.setattr(running, "checkpointed", lambda d: seen.append(plain(d)) or seen[-1])
    df = spark.range(3000).selectExpr("id % 7 AS g", "id", "1 AS one")
    rows = running.running_sums(df, ["g"], [F.col("id")], {"upto": "one"}).collect()
    assert len(rows) == 3000 and all(r["upto"] == r["id"] // 7 + 1 for r in rows)
    assert max(r["count"] for r in seen[0].groupBy("_range").count().collect()) < 500


def test_neighbours_are_not_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (400, 8)).round(1)
    v[50:60] = v[3]
    rows = [(1000 - k, [float(t) for t in x]) for k, x in enumerate(v)] + [(5000, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    got = ml.knn(df.where("id % 9 = 0").withColumnRenamed("id", "q"), df, 5)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["q"], r["rank"]): (r["distance"], r["id"]) for r in got.collect()}
    for i, x in rows[:-1]:
        if i % 9 == 0:
            want = sorted((float(np.sqrt(np.cumsum([(a - b) ** 2 for a, b in zip(x, y)])[-1])), j) for j, y in rows[:-1])[:5]
            assert [found.pop((i, k + 1)) for k in range(5)] == want
    assert not found


def test_codes_of_many_texts(spark):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(0, 5, n).astype("u1")) + b"z" * int(z) for n, z in zip(rng.integers(0, 300, 90), rng.choice([0, 254, 255, 256, 600], 90))] + [b"", bytes(range(256)) * 2]

    def to_front(b):
        order, out = list(range(256)), []
        for x in b:
            out.append(order.index(x))
            order.insert(0, order.pop(out[-1]))
        return bytes(out)

    steps = []
    made = compress._together([*texts, None], compress._move_to_front, lambda c, upto: steps.append(upto) or compress._step_by_step(c, upto, False))
    assert made == [*map(to_front, texts), None] and max(steps) > 100  # most symbols are coded together
    assert compress._together(made, compress._from_front, lambda c, upto: compress._step_by_step(c, upto, True)) == [*texts, None]
    assert all(compress._unrle(compress._rle(b)) == b and compress._undelta(compress._delta(b)) == b for b in texts)


def test_weights_are_the_draws(spark):
    """Looked-up weights are those that the limits give, also where a limit cuts a looked-up range."""
    h = np.random.default_rng(4).integers(0, 2**63, 300).astype(np.uint64)
    w = resampling.weights(h, 64, 42)
    steps = (np.arange(1, 65, dtype=np.uint64) + np.uint64(64 * 42)) * np.uint64(0x9E3779B97F4A7C15)
    z = h[:, None] ^ steps
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    limits, p = [], np.exp(-1.0)
    for k in range(1, 19):
        limits.append(sum(limits[-1:]) + p)
        p /= k
    assert (w == np.searchsorted(limits, (z >> np.uint64(11)) / 2.0**53, side="right")).all() and resampling.FIRST_BITS < 53


def test_ranks_in_few_rounds(spark):
    """A bipartite graph, whose ranks swing: converged in a fraction of the rounds that plain iteration takes."""
    rng = np.random.default_rng(5)
    pairs = {(int(a), -1 - int(b)) for a, b in zip(rng.integers(0, 60, 600), rng.integers(0, 12, 600))}
    both = [*pairs, *((b, a) for a, b in pairs)]
    df = spark.createDataFrame(both, "src long, dst long")
    ids = sorted({a for a, _ in both})
    m = np.zeros((len(ids), len(ids)))
    for a, b in both:
        m[ids.index(b), ids.index(a)] += 1
    want = np.linalg.solve(np.eye(len(ids)) - 0.85 * m / m.sum(0), np.full(len(ids), 0.15 / len(ids)))
    got = {r["id"]: r["rank"] for r in graph.pagerank(df, rounds=25).collect()}
    assert sum(abs(got[i] - w) for i, w in zip(ids, want)) < 1e-9


def test_rows_of_a_tall_matrix_are_made_whole(spark):
    """A product by a small matrix adds nothing up by row and column, and repeated entries add up."""
    from numera.operators import linalg

    rng = np.random.default_rng(6)
    m, n = rng.normal(0, 1, (70, 5)), rng.normal(0, 1, (5, 5))
    entries = [(i, j, float(m[i, j])) for i in range(70) for j in range(5)]
    a = spark.createDataFrame([*entries, (3, 2, 1.0)], "i long, j long, v double")
    m[3, 2] += 1
    got = linalg.tall_matmul(a, spark.createDataFrame([(i, j, float(n[i, j])) for i in range(5) for j in range(5)], "i long, j long, v double"), 5)
    assert "sum(" not in got._jdf.queryExecution().optimizedPlan().toString()
    out = np.zeros((70, 5))
    for r in got.collect():
        out[r["i"], r["j"]] = r["v"]
    assert np.allclose(out, m @ n)
    g = {(r["i"], r["j"]): r["v"] for r in linalg.gram_of(a, 5).collect()}
    assert np.allclose([[g[i, j] for j in range(5)] for i in range(5)], m.T @ m)
