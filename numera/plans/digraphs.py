"""Queries over components, orders, forests and centralities of graphs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import digraph
from ..sources.tables import table
from .registry import query


def _chains(spark, d, steps=(1,), back=None):
    """Each customer's orders in time: arcs to the next ones, and back from urgent orders to the order two before."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderpriority") < "3").alias("urgent"), *(F.lead("o_orderkey", k).over(w).alias(f"next{k}") for k in steps), *(F.lead("o_totalprice", k).over(w).alias(f"price{k}") for k in steps), F.lag("o_orderkey", 2).over(w).alias("before"))
    # all arcs of a row are made where it lies, so that those of a customer stay together
    arcs = [F.struct(F.col(f"next{k}").alias("dst"), F.abs(F.col(f"price{k}") - F.col("o_totalprice")).cast("double").alias("w")) for k in steps]
    if back:
        arcs.append(F.struct(F.when(F.col("urgent"), F.col("before")).alias("dst"), F.lit(1.0).alias("w")))
    out = o.select(F.col("o_orderkey").alias("src"), F.explode(F.array(*arcs)).alias("a")).select("src", "a.dst", "a.w")
    return out.where("dst IS NOT NULL")


_STEP = "SELECT o_orderkey AS src, lead(o_orderkey, {k}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst, abs(lead(o_totalprice, {k}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - o_totalprice) AS w FROM orders"
_BACK = "SELECT src, dst, 1.0 AS w FROM (SELECT o_orderkey AS src, o_orderpriority, lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders) WHERE o_orderpriority < '3'"


def _sql(steps=(1,), back=False):
    return "SELECT * FROM (" + " UNION ALL ".join([*(_STEP.format(k=k) for k in steps), *([_BACK] if back else [])]) + ") WHERE dst IS NOT NULL"


@query("id component", "", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_sql((1,), True)})), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT id, least(id, coalesce(min(p.b), id)) AS component FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) v LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a) p ON p.a = id GROUP BY id")
def graph_strong_components(spark, d):
    return digraph.strongly_connected_components(_chains(spark, d, (1,), True))


@query("id level position", "", f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({_sql((1, 3))})), r AS (SELECT DISTINCT src AS id, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.id), m AS (SELECT id, max(level) AS level FROM r GROUP BY id) SELECT id, level, row_number() OVER (ORDER BY level, id) - 1 AS position FROM m")
def graph_topological_sort(spark, d):
    return digraph.topological_sort(_chains(spark, d, (1, 3)))


@query("src dst", "w", f"""WITH RECURSIVE e AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, min(w) AS w FROM ({_sql((1, 2, 3))}) GROUP BY 1, 2), ends AS (SELECT u AS a, v AS b, u, v, w FROM e UNION ALL SELECT v, u, u, v, w FROM e),
 r AS (SELECT u, v, w, u AS at FROM e UNION SELECT r.u, r.v, r.w, o.b FROM r JOIN ends o ON o.a = r.at AND (o.w, o.u, o.v) < (r.w, r.u, r.v) WHERE r.at <> r.v)
 SELECT u AS src, v AS dst, w FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.u = e.u AND r.v = e.v AND r.at = e.v)""", 4)
def graph_spanning_forest(spark, d):
    return digraph.minimum_spanning_forest(_chains(spark, d, (1, 2, 3)))


def _nations(spark, d):
    """Nations that trade: an arc from each customer's nation to each supplier's that sold it at least so many parts of one
    brand, weighted by the mean discount."""
    orders, lines = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_discount", "l_quantity")
    c, s = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    t = lines.where("l_quantity >= 45").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return t.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("w")).where("(src + 3 * dst) % 4 = 0 AND src <> dst")


_NATIONS_SQL = "SELECT c_nationkey AS src, s_nationkey AS dst, sum(l_quantity)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45 AND (c_nationkey + 3 * s_nationkey) % 4 = 0 AND c_nationkey <> s_nationkey GROUP BY 1, 2"


@query("id", "closeness", f"""WITH RECURSIVE e AS (SELECT src, dst, w::DOUBLE AS w FROM ({_NATIONS_SQL})), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
 p AS (SELECT id AS s, id AS node, 0.0::DOUBLE AS d, 0 AS k FROM v UNION ALL SELECT s, node, d, k FROM (SELECT p.s, e.dst AS node, min(p.d + e.w) AS d, p.k + 1 AS k FROM p JOIN e ON e.src = p.node WHERE p.k < 12 GROUP BY p.s, e.dst, p.k)),
 m AS (SELECT s, node, min(d) AS d FROM p WHERE node <> s GROUP BY s, node) SELECT id, coalesce(count(node) / sum(d), 0) AS closeness FROM v LEFT JOIN m ON m.s = id GROUP BY id""", 9)
def graph_closeness(spark, d):
    return digraph.closeness_centrality(_nations(spark, d))


@query("id", "betweenness", f"""WITH RECURSIVE e AS (SELECT src, dst FROM ({_NATIONS_SQL})), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
 p AS (SELECT id AS s, id AS t, 0 AS d, 1.0::DOUBLE AS n FROM v UNION ALL SELECT s, t, d, n FROM (SELECT p.s, e.dst AS t, p.d + 1 AS d, sum(p.n) AS n FROM p JOIN e ON e.src = p.t WHERE p.d < 12 GROUP BY p.s, e.dst, p.d)),
 m AS (SELECT s, t, d, n FROM p QUALIFY d = min(d) OVER (PARTITION BY s, t)),
 x AS (SELECT a.t AS id, sum(a.n * b.n / c.n) AS part FROM m a JOIN m b ON b.s = a.t JOIN m c ON c.s = a.s AND c.t = b.t WHERE a.d + b.d = c.d AND a.s <> a.t AND b.t <> a.t AND a.s <> b.t GROUP BY a.t)
 SELECT id, coalesce(part, 0) / (((SELECT count(*) FROM v) - 1) * ((SELECT count(*) FROM v) - 2)) AS betweenness FROM v LEFT JOIN x USING (id)""", 9)
def graph_betweenness(spark, d):
    return digraph.betweenness_centrality(_nations(spark, d))
