"""Queries over decompositions: what they multiply back to, or a solution that is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decompose
from ..operators.linalg import tall_matmul, transpose
from ..sources.tables import MATRIX_SQL, matrix, table
from .registry import query


@query("i j", "v", f"SELECT i, j, v + 0 AS v FROM ({MATRIX_SQL})", 4)
def linalg_svd(spark, d):
    u, s, v = decompose.svd(matrix(spark, d), 64)
    scaled = u.join(s.withColumnRenamed("k", "j"), "j").select("i", "j", (F.col("v") * F.col("s")).alias("v"))
    return tall_matmul(scaled, transpose(v), 64)


@query("i j", "v", f"SELECT i, j, v FROM ({MATRIX_SQL})", 4)
def linalg_qr(spark, d):
    q, r = decompose.qr(matrix(spark, d), 64)
    return tall_matmul(q, r, 64)


@query("j", "x", "SELECT unnest(range(64)) AS j, unnest(range(1, 65)) * n / 97000 AS x FROM (SELECT count(*) AS n FROM embeddings)", 5)
def linalg_lsq(spark, d):
    a = matrix(spark, d)
    rows = table(spark, d, "embeddings").agg(F.count("*").alias("n"))  # one row
    b = a.join(F.broadcast(rows)).groupBy("i").agg(F.sum(F.col("v") * (F.col("j") + 1) * F.col("n") / 97000).alias("v"))
    return decompose.lsq(a, b, 64)


@query("rank", "squares", f"SELECT 64::BIGINT AS rank, (SELECT sum(v * v) FROM ({MATRIX_SQL})) AS squares", 4)
def linalg_rank(spark, d):
    a = matrix(spark, d)
    s = decompose.svd(a, 64)[1]
    return decompose.rank_and_condition(a, 64).select("rank").join(s.agg(F.sum(F.col("s") * F.col("s")).alias("squares")))
