"""Graphs given by classes against the same graphs given by edges, and what queries need against the size of their input."""

import pytest
from pyspark.sql import functions as F

from numera.operators import graph

MEMBERS = [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (4, "a"), (5, "b"), (6, "b"), (7, "c"), (8, None), (None, "a"), (9, "d"), (10, "d"), (11, "d")]


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def both(spark):
    members = spark.createDataFrame(MEMBERS, "id long, class string")
    x, y = members.alias("x"), members.alias("y")
    edges = x.join(y, F.expr("x.class = y.class AND x.id < y.id")).select(F.col("x.id").alias("src"), F.col("y.id").alias("dst"), F.lit(1.0).alias("w"))
    return members, edges


@pytest.mark.parametrize("name", ["degree_centrality", "connected_components", "triangles", "laplacian"])
def test_classes_as_their_edges(both, name):
    members, edges = both
    assert _rows(getattr(graph, f"{name}_of_classes")(members)) == _rows(getattr(graph, name)(edges))


def test_modularity_of_classes(spark, both):
    members, edges = both
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None), (5, 3), (6, 3), (9, 2), (10, 1), (12, 7)], "id long, g int")
    assert _rows(graph.modularity_of_classes(members, groups)) == _rows(graph.modularity(edges, groups))


def test_an_id_has_one_class(spark):
    with pytest.raises(ValueError):
        graph.triangles_of_classes(spark.createDataFrame([(1, "a"), (1, "b")], "id long, class string"))


def test_a_written_table_is_not_broadcast_by_the_size_of_its_files(spark, monkeypatch):
    from numera.operators import running

    small = spark.range(100).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in running.written(small).join(running.written(small), "k")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(running, "BROADCAST_FILES", 0)
    a, b = running.written(small), running.written(small)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(a.join(b, "k"))
    assert "BroadcastHashJoin" in plan(a.join(F.broadcast(b), "k"))  # where asked for
    assert a.join(b.groupBy("k").count(), "k").count() == 100


def test_functions_are_computed_once_a_value(spark):
    from numera.operators.by_value import by_value

    rows = [(k, k % 3 if k % 4 else None, k % 2) for k in range(40)] + [(1, 1, 1)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    runs = spark.sparkContext.accumulator(0)

    def counted(a, b):
        runs.add(1)
        return None if a is None else 10 * a + b

    got = by_value(df, ["a", "b"], ["id"], F.udf(counted, "long")("a", "b").alias("f")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, None if a is None else 10 * a + b)) for i, a, b in rows)
    assert runs.value == len({r[1:] for r in rows})


def test_gmres_leaves_no_table_of_an_earlier_round(spark, monkeypatch):
    import os

    from numera.operators import krylov, running

    made, write = [], running.written
    monkeypatch.setattr(krylov, "written", lambda df: made.append(write(df)) or made[-1])
    n = 12
    a = spark.range(n).selectExpr("id AS i", "explode(array(id, (id + 1) % 12)) AS j").selectExpr("i", "j", "CASE WHEN i = j THEN 2.0D ELSE -0.25D * (1 + i % 3) END AS v")
    b = spark.range(n).selectExpr("id AS i", "CAST(id AS double) AS v")
    found = krylov.gmres(a, b, restart=2, max_iter=4, tol=1e-12)
    assert found.rounds == 4 and found.x.count() == n
    left = [t for t in made if os.path.exists(t._written_at.toUri().getPath())]
    assert len(made) > 8 and left == made[-1:]


def test_running_sums_carry_one_row_a_range(spark, monkeypatch):
    from numera.operators import running

    monkeypatch.setattr(running, "RANGE", 100)
    monkeypatch.setattr(running, "BROADCAST_ROWS", 100)
    # groups of one row, one that fills ranges, null and the same group at the end of ranges
    rows = [(g, x) for g, n in [(None, 130), *((k, 1 + k % 3) for k in range(200)), (200, 700), (201, 5)] for x in range(n)]
    df = spark.createDataFrame(rows, "g long, x long").selectExpr("g", "x", "x + 1 AS n")
    got = running.running_sums(df, ["g"], [F.col("x")], {"t": "n"})
    assert all(r["t"] == (r["x"] + 1) * (r["x"] + 2) // 2 for r in got.collect()) and got.count() == len(rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "rightHint=(strategy=broadcast)" in plan
    joined = df.join(got.withColumnRenamed("n", "m"), ["g", "x"])
    assert "BroadcastHashJoin [g" not in joined._jdf.queryExecution().executedPlan().toString()
