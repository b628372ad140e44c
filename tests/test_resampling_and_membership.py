"""Bootstrap intervals against numpy on the same weights, and Bloom filters by their promises."""

import numpy as np
import pytest

from numera.operators import membership, resampling

ROWS = "id long, g string, x double"


def test_bootstrap_is_that_of_its_weights(spark):
    rng = np.random.default_rng(1)
    data = [(k, "ab"[k % 3 == 0], 1e6 + float(rng.normal())) for k in range(300)] + [(900 + k, None, 5.0) for k in range(4)]
    df = spark.createDataFrame([*data, (999, "a", None), (998, "a", float("nan"))], ROWS)
    hashes = {r["id"]: r["h"] for r in df.selectExpr("id", "xxhash64(id) AS h").collect()}
    for statistic, f in (("mean", np.mean), ("std", lambda v: np.std(v, ddof=1))):
        one, two = ({r["g"]: r for r in resampling.bootstrap_ci(d, "x", "id", ["g"], 0.9, 200, 7, statistic).collect()} for d in (df.repartition(1), df.repartition(7)))
        for g in "ab":
            x = np.array([r[2] for r in data if r[1] == g])
            w = resampling.weights(np.array([hashes[r[0]] for r in data if r[1] == g]), 200, 7)
            drawn = np.sort([f(np.repeat(x, w[:, k].astype(int))) for k in range(200)])
            assert np.allclose([one[g][c] for c in ("estimate", "lower", "upper", "std_error")], [f(x), drawn[int((1 - 0.9) / 2 * 200)], drawn[int((1 - (1 - 0.9) / 2) * 200)], drawn.std(ddof=1)], rtol=1e-7)
            assert np.allclose(one[g][1:], two[g][1:], rtol=1e-10)
        assert one[None]["estimate"] == (5.0 if statistic == "mean" else 0.0)


def test_weights_are_poisson_and_intervals_cover(spark):
    w = resampling.weights(np.random.default_rng(2).integers(0, 2**63, 4000), 200, 1)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06
    df = spark.createDataFrame([(k, "a", float(v)) for k, v in enumerate(np.random.default_rng(3).normal(size=2000))], ROWS)
    r = resampling.bootstrap_ci(df, "x", "id").first()
    assert abs(r["std_error"] - 1 / 2000**0.5) < 0.003 and r["lower"] < r["estimate"] < r["upper"]
    assert resampling.bootstrap_ci(df.limit(0), "x", "id").count() == 0
    with pytest.raises(ValueError):
        resampling.bootstrap_ci(df, "x", "id", statistic="mode")


@pytest.mark.parametrize("n, rate", [(50, 0.01), (20_000, 0.01), (20_000, 0.2)])
def test_no_false_negatives_and_the_stated_rate(spark, n, rate):
    members = spark.range(0, 2 * n, 2).repartition(3)
    halves = [membership.bloom_filter(d, "id", n, rate) for d in (members.where("id < 999"), members.where("id >= 999").unionByName(members.limit(9)))]
    bloom = halves[0].merge(halves[1])
    assert membership.might_contain(members, "id", bloom).where("NOT member").count() == 0
    others = spark.range(1, 40_001, 2)
    assert membership.might_contain(others, "id", bloom).where("member").count() <= 1.5 * rate * 20_000
    whole = membership.bloom_filter(members, "id", n, rate)
    assert {r["word"]: bytes(r["bits"]) for r in whole.words.collect()} == {r["word"]: bytes(r["bits"]) for r in bloom.words.collect()}


def test_filtered_join_is_the_join(spark, monkeypatch):
    big = spark.createDataFrame([(k % 50, f"r{k}", 1) for k in range(300)] + [(None, "n", 1)] + [(7, "hot", 1)] * 150, "k long, v string, _member int")
    small = spark.createDataFrame([(k, k * k) for k in range(0, 100, 7)] + [(None, 0), (7, 1)], "k long, w long")
    want = sorted(map(str, big.join(small, "k").collect()))
    assert sorted(map(str, membership.filtered_join(big, small, "k").collect())) == want
    assert membership.filtered_join(big, small.limit(0), "k").count() == 0 and membership.filtered_join(big.limit(0), small, "k").count() == 0
    assert [r["member"] for r in membership.might_contain(big.where("k IS NULL"), "k", membership.bloom_filter(small, "k", 20)).collect()] == [None]
    monkeypatch.setattr(membership, "BROADCAST_WORDS", 0)
    assert sorted(map(str, membership.filtered_join(big, small, "k").collect())) == want
    with pytest.raises(ValueError):
        membership.might_contain(big, "k", membership.bloom_filter(small, "k", 20))
