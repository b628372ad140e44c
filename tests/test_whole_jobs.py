"""Queries and operators that take whole tables and run to the end, by brute force."""

import base64
import math

import pytest

from numera.operators import graph
from numera.plans import queries as own


def test_bfs_reaches_the_end_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(53)], "src long, dst long").coalesce(1)
    assert {r["id"]: r["depth"] for r in graph.bfs(path, 0).collect()} == {i: i for i in range(54)}


def test_pagerank_converges(spark):
    edges = [(0, 1), (1, 0), (1, 2), (2, 3), (3, 1), (4, 1), (2, 0), (0, 5)]
    ids = sorted({v for e in edges for v in e})
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(100):
        new = {v: 0.15 / len(ids) + 0.85 * sum(rank[a] / sum(x == a for x, _ in edges) for a, b in edges if b == v) for v in ids}
        done = sum(abs(new[v] - rank[v]) for v in ids) < 1e-10
        rank = new
        if done:
            break
    got = {r["id"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src long, dst long").coalesce(1)).collect()}
    assert got.keys() == rank.keys() and all(math.isclose(got[v], rank[v], rel_tol=1e-12) for v in ids)


@pytest.fixture
def small(spark, tmp_path):
    spark.createDataFrame([(i, [float(i * 10 + j) for j in range(7)]) for i in range(3)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "é" * 500 + " end"), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_kron_takes_all_columns(spark, small):
    got = {(r["i"], r["j"]): r["v"] for r in own.queries()["linalg_kron_whole"](spark, small).collect()}
    b = {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 3.0, (1, 1): 4.0}
    assert got == {(2 * i + x, 2 * j + y): (i * 10 + j) * v for i in range(3) for j in range(7) for (x, y), v in b.items()}


def test_base64_takes_the_whole_text(spark, small):
    got = {r["doc_id"]: r["b64"] for r in own.queries()["crypto_base64"](spark, small).collect()}
    assert got == {1: base64.b64encode(("é" * 500 + " end").encode()).decode(), 2: "", 3: None}
