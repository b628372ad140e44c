"""The pipeline's near-duplicates against brute force, by the method and by similarity alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.llm import simhash


def _set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def _fingerprint(text):
    return simhash._majority(simhash._shingle_hashes(sorted(set((text or "").encode().lower().split())), 1))


def _first_ids(rows, linked):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        root[find(i)] = find(j)
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((d is None, d or 0))
    return sorted(str(None if n else d) for n, d in (min(g) for g in groups.values()))


@pytest.mark.parametrize("bucket, shared", [(64, 4), (2, 1)])
def test_first_of_each_group(spark, monkeypatch, bucket, shared):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SHARED", shared)
    rng = random.Random(6)
    make = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)]
    line, rows = make(12), []
    for g in range(12):
        base = make(rng.choice([6, 20, 60, 200])) + line * (g % 2)
        for _ in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                t[rng.randrange(len(t))] = "changed" + str(rng.randrange(99))
            rows.append((len(rows), " ".join(t)))
    chain = make(300)  # neighbours are similar, ends are not
    for i in range(12):
        rows.append((len(rows), " ".join(chain[6 * i : 6 * i + 120])))
    rows += [(900, None), (901, " "), (902, "Two words"), (903, "two  WORDS"), (None, "only here"), (None, None), (7, rows[7][1])]
    sets, fp = [_set(t) for _, t in rows], [_fingerprint(t) for _, t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if _alike(sets[i], sets[j])]
    found = [(i, j) for i, j in alike if ((fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() <= simhash.WORD_DISTANCE]
    far = [(i, j) for i, j in alike if sets[i] != sets[j]]
    assert len(far) > 100 and len(set(far) & set(found)) >= 0.85 * len(far)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({n: F.lit("x") for n in ("node", "fp", "key", "name1", "_id", "_r", "root", "first", "n")}).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = simhash.first_of_each_group(df)
    assert got.columns == df.columns and sorted(str(r["doc_id"]) for r in got.collect()) == _first_ids(rows, found)
    assert simhash.first_of_each_group(df.limit(0)).count() == 0


def test_equal_rows_are_one(spark):
    df = spark.createDataFrame([(1, "a b c d e f", None), (1, "a b c d e f", None), (1, None, "a b c d e f"), (2, "a b c d e f", None)], "doc_id long, text string, lang string")
    assert sorted(map(str, simhash.first_of_each_group(df).collect())) == sorted(map(str, df.where("doc_id = 1").distinct().collect()))


def test_sketches_leave_out_no_similar_sets(spark):
    rng = np.random.default_rng(5)
    rows, similar = [], []
    for k in range(400):
        n = int(rng.integers(0, 900))
        x = rng.integers(-(2**62), 2**62, n)
        y = np.unique(np.where(rng.random(n) < rng.random() * 0.2, rng.integers(-(2**62), 2**62, n), x))[: n - int(rng.integers(0, n // 8 + 1))]
        x = np.unique(x)
        longs = lambda h: np.frombuffer(simhash.sketch(h), "<i8").tolist()
        rows.append((k, len(x), longs(x), len(y), longs(y)))
        both = len(np.intersect1d(x, y))
        similar.append(9 * both >= 4 * (len(x) + len(y)))
    df = spark.createDataFrame(rows, "k long, x_n long, x_sketch array<long>, y_n long, y_sketch array<long>")
    kept = {r[0] for r in df.where(simhash.may_be_similar("x", "y")).select("k").collect()}
    assert 20 < sum(similar) < 380 and all(k in kept for k, s in enumerate(similar) if s)
    assert len(kept) < 1.3 * sum(similar)


def test_columns_with_the_names_of_helpers_keep_their_values(spark):
    text = " ".join(f"word{k}" for k in range(40))
    names = ["_r1", "_r2", "_doc", "_id", "_text", "_kept", "fp", "name1", "n", "a.b"]
    rows = [(1, text), (2, text), (2, text), (3, "another text of its own, much shorter")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"<{c}>") for c in names})
    got = simhash.first_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, t, *(f"<{c}>" for c in names)) for i, t in (rows[0], rows[3])]


def test_probes_of_a_row_do_not_depend_on_how_many_rows_there_are(spark, monkeypatch):
    seen, chosen = [], simhash.choose_partitions
    monkeypatch.setattr(simhash, "choose_partitions", lambda sample, total, distance: seen.append(total) or chosen(sample, total, distance))
    for n in (50, 3000):
        assert simhash.near_links(spark.range(n).selectExpr("id AS node", "xxhash64(id) AS fp")).count() == 0
    assert len(set(seen)) == 1


@pytest.mark.parametrize("whole", [0, 1 << 26])
def test_a_crowd_of_unlike_texts_is_told_apart_by_sketches(spark, monkeypatch, whole):
    """Fingerprints that are all near each other, of sets that differ in most members: few pairs are left to verify."""
    for name, value in (("BUCKET", 4), ("PLAIN", 0), ("WHOLE", whole)):
        monkeypatch.setattr(simhash, name, value)
    rng = np.random.default_rng(8)
    sets = {k: rng.integers(-(2**62), 2**62, 300) for k in range(40)}
    sets[39] = np.where(np.arange(300) < 5, sets[7], sets[38])  # 38 and 39 are alike
    nodes = spark.createDataFrame([(k, 1 << k) for k in sets], "node long, fp long")
    rows = [(k, len(np.unique(h)), np.frombuffer(simhash.sketch(h), "<i8").tolist()) for k, h in sets.items()]
    sketches = spark.createDataFrame(rows, "node long, n long, sketch array<long>")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where("u = 38 AND v = 39")

    got = simhash.near_links(nodes, verify=verify, sketches=lambda some: sketches.join(some, "node"))
    assert [tuple(r) for r in got.distinct().collect()] == [(38, 39)]
    assert sum(asked) < 5 * len(sets)


def test_sketches_count_under_small_hot_keys_too(spark, monkeypatch):
    """As a crowd of unlike texts, but no larger than what was once compared without sketches."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    rng = np.random.default_rng(8)
    sets = {k: rng.integers(-(2**62), 2**62, 300) for k in range(40)}
    nodes = spark.createDataFrame([(k, 1 << k) for k in sets], "node long, fp long")
    rows = [(k, len(np.unique(h)), np.frombuffer(simhash.sketch(h), "<i8").tolist()) for k, h in sets.items()]
    sketches = spark.createDataFrame(rows, "node long, n long, sketch array<long>")
    asked = []
    got = simhash.near_links(nodes, verify=lambda pairs: asked.append(pairs.count()) or pairs.limit(0), sketches=lambda some: sketches.join(some, "node"))
    assert got.count() == 0 and sum(asked) < 5 * len(sets)


def test_a_crowd_of_like_texts_is_not_linked_pair_by_pair(spark, monkeypatch):
    """A third of all pairs are alike, so one text to compare with leaves most apart; a pair meets under many keys."""
    monkeypatch.setattr(simhash, "BUCKET", 4)
    bits = np.frombuffer(simhash.sketch(np.arange(300)), "<i8").tolist()
    n = 150
    rows = [(k, 0) for k in range(n)]
    alike = lambda u, v: (u * v * (u + v) + 7 * u * v + u + v) % 101 % 3 == 0
    near = [(u, v) for v, y in rows for u, x in rows if u < v and ((x ^ y) & (2**64 - 1)).bit_count() <= simhash.WORD_DISTANCE and alike(u, v)]
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where("(u * v * (u + v) + 7 * u * v + u + v) % 101 % 3 = 0")

    nodes = spark.createDataFrame(rows, "node long, fp long").localCheckpoint()
    got = {tuple(r) for r in simhash.near_links(nodes, simhash.WORD_DISTANCE, verify, lambda some: some.select("node", F.lit(300).cast("long").alias("n"), F.array(*map(F.lit, bits)).alias("sketch"))).collect()}
    kept = lambda pairs: _first_ids([(k, None) for k in range(n)], pairs)
    assert got <= set(near) and kept(got) == kept(near)
    assert len(got) < 0.5 * len(near) and sum(asked) < 0.5 * n * (n - 1) / 2


def test_pairs_meet_half_way(spark):
    """Every pair within a partition's threshold meets there, under one key or two, not under all that both probe."""
    parts = [(list(range(0, 22)), 2), (list(range(22, 44)), 3), (list(range(44, 64)), 1)]
    rng = random.Random(4)
    base = rng.getrandbits(63)
    rows = [(k, base ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(7)))) for k in range(60)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    keyed = nodes.select("node", "fp", F.explode(simhash._probes(parts)).alias("x")).select("node", "fp", "x.*")
    a, b = (keyed.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "fp", "flips", "part"))) for s in "ab")
    both = a.join(b, "key").where("a_node < b_node")
    made = {(r[0], r[1]): r[2] for r in both.where(simhash._half_way(parts)).where(simhash._first_part(parts)).groupBy("a_node", "b_node").count().collect()}
    masks = [(sum(1 << i for i in bits), t) for bits, t in parts]
    assert set(made) == {(u, v) for u, x in rows for v, y in rows if u < v and any(((x ^ y) & m).bit_count() <= t for m, t in masks)}
    assert max(made.values()) <= 3 and sum(made.values()) < 0.2 * both.count()


def test_probes_are_not_broadcast(spark, monkeypatch):
    """A small table of nodes makes many probes, which Spark sizes as if there were one a node."""
    plans, write = {}, simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and write(df, label))
    nodes = write(spark.range(300).selectExpr("id AS node", "xxhash64(id) AS fp"), "nodes")
    simhash.near_links(nodes)
    assert "SortMergeJoin" in plans["pairs"] and "BroadcastExchange" not in plans["pairs"]


def test_written_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    """Under hot keys, in components and where sets meet pairs: a table's files are small against its rows in memory."""
    from numera.llm import common

    nodes = simhash.materialize(spark.range(40).selectExpr("id AS node", "shiftleft(1L, int(id)) AS fp"), "nodes")
    sketches = spark.range(40).selectExpr("id AS node", "300L AS n", f"array_repeat(0L, {simhash.SKETCH // 64}) AS sketch")
    plans, write = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: plans.append((label, df._jdf.queryExecution().executedPlan().toString())) or write(df, label))
    monkeypatch.setattr(simhash, "BUCKET", 4)
    monkeypatch.setattr(common, "GUESSED_ROWS", 0)
    got = simhash.near_links(nodes, verify=lambda pairs: pairs.where("v % 10 = u % 10"), sketches=lambda some: sketches.join(some, "node"))
    assert [plan.count("SortMergeJoin") for label, plan in plans if label == "met"] == [0, 1, 0]
    assert [plan.count("SortMergeJoin") for label, plan in plans if label == "pairs"][-1] == 2
    assert _first_ids([(k, None) for k in range(40)], [tuple(r) for r in got.collect()]) == [str(k) for k in range(10)]
