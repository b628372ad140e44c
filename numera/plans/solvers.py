"""Queries of iterative solvers and of rank correlation. A solution is shown by what the matrix makes of it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import krylov, linalg, rank_correlation
from ..sources.tables import MATRIX_SQL, matrix, table
from .registry import query


def _orders(spark, d):
    """Springs between each order and its customer's next one, as strong as the order is urgent; b: prices in thousands."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", F.lead("o_orderkey").over(w).alias("next"), F.substring("o_orderpriority", 1, 1).cast("double").alias("s"), "o_totalprice")
    link = o.where("next IS NOT NULL")
    i, j = F.col("o_orderkey").alias("i"), F.col("next").alias("j")
    b = o.select(F.col("o_orderkey").alias("i"), (F.col("o_totalprice") / 1000).cast("double").alias("v"))
    return link, i, j, b, o


def _entries(o, *entries):
    """Entries i, j, v of each order's row of o; all of them are made where it lies, so that those of a customer stay together."""
    made = F.explode(F.array(*(F.struct(x.alias("i"), y.alias("j"), v.alias("v")) for x, y, v in entries)))
    return o.select(made.alias("a")).select("a.*").where("v IS NOT NULL")


def _spd(spark, d):
    link, i, j, b, o = _orders(spark, d)
    own, next_, s = F.col("o_orderkey"), F.col("next"), F.col("s")
    return _entries(o, (own, own, F.lit(1.0)), *((x, y, F.when(next_.isNotNull(), sign * s)) for x, y, sign in ((own, next_, -1), (next_, own, -1), (own, own, 1), (next_, next_, 1)))), b


@query("i", "b", "SELECT o_orderkey AS i, o_totalprice / 1000 AS b FROM orders", 5)
def linalg_cg(spark, d):
    """The right-hand side as A x gives it, so that the solution has to be right."""
    a, b = _spd(spark, d)
    return linalg.matvec(a, krylov.cg(a, b, tol=1e-8).x).select("i", F.col("v").alias("b"))


@query("i", "b", "SELECT o_orderkey AS i, o_totalprice / 1000 AS b FROM orders", 5)
def linalg_gmres(spark, d):
    """As linalg_cg, for a matrix that is not symmetric: an order feels the next one only."""
    link, i, j, b, o = _orders(spark, d)
    own, next_ = F.col("o_orderkey"), F.col("next")
    a = _entries(o, (own, own, F.lit(2.0)), (own, next_, F.when(next_.isNotNull(), F.col("s") / -4)))
    return linalg.matvec(a, krylov.gmres_by_parts(a, b, tol=1e-8).x).select("i", F.col("v").alias("b"))


@query("j", "g", f"WITH a AS ({MATRIX_SQL}) SELECT j, sum(v * label) AS g FROM a JOIN embeddings ON vec_id = i GROUP BY j", 4)
def linalg_lsqr(spark, d):
    """A'A x of the least-squares fit of labels to vectors, which is A'b."""
    a = matrix(spark, d)
    b = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("v"))
    x = krylov.lsqr(a, b, tol=1e-10).x
    fitted = linalg.matvec(a, x).select(F.col("i").alias("j"), F.col("v").alias("x"))
    return linalg.matvec(linalg.transpose(a), fitted).select(F.col("i").alias("j"), F.col("v").alias("g"))


@query("", "tau", "WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM c) SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 / (SELECT n * (n - 1) / 2 FROM t) AS tau FROM c a, c b", 9)
def stats_kendall_ties(spark, d):
    return rank_correlation.kendall(table(spark, d, "lineitem"), "l_quantity", "l_discount")


@query("", "tau", "WITH c AS (SELECT row_number() OVER () AS k, o_totalprice AS x, o_custkey AS y FROM orders) SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / count(*) AS tau FROM c a JOIN c b ON a.k < b.k", 9)
def stats_kendall(spark, d):
    return rank_correlation.kendall(table(spark, d, "orders"), "o_totalprice", "o_custkey")
