"""Queries of trees, forests, boosting, density clusters, resampling and filters of members."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, membership, resampling, trees
from ..sources.tables import table
from .registry import query

FEATURES = ["l_quantity", "l_discount", "l_tax"]
DEPTH = 3


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in [*FEATURES, "l_extendedprice"]), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("back"))


def _level_sql(k: int) -> str:
    """Rows at level k + 1 from those at level k: every cut of every feature tried on counts by value."""
    long = " UNION ALL ".join(f"SELECT node, {f} AS f, f{f} AS v, y FROM r{k}" for f in range(len(FEATURES)))
    gain = "round(((lq - ls * ls / ln) + ((tq - lq) - (ts - ls) * (ts - ls) / (tn - ln))) / (tq - ts * ts / tn), 10)"
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY node, f ORDER BY v) AS l{c}, sum({c}) OVER (PARTITION BY node, f) AS t{c}" for c in "nsq")
    return f"""h{k} AS (SELECT node, f, v, count(*)::DOUBLE AS n, sum(y) AS s, sum(y * y) AS q FROM ({long}) GROUP BY ALL),
c{k} AS (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nxt, {sums} FROM h{k}),
s{k} AS (SELECT node, f, (v + nxt) / 2 AS t FROM c{k} WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY {gain}, f, v) = 1),
r{k + 1} AS (SELECT 2 * r{k}.node + CASE WHEN CASE f WHEN 0 THEN f0 WHEN 1 THEN f1 ELSE f2 END > t THEN 1 ELSE 0 END AS node, f0, f1, f2, y FROM r{k} JOIN s{k} USING (node))"""


TREE_SQL = f"""WITH r0 AS (SELECT 1 AS node, {', '.join(f'{c}::DOUBLE AS f{k}' for k, c in enumerate(FEATURES))}, l_extendedprice::DOUBLE AS y FROM lineitem),
{', '.join(_level_sql(k) for k in range(DEPTH))}
SELECT n, prediction FROM (SELECT node, count(*) AS n, avg(y) AS prediction FROM r{DEPTH} GROUP BY node)"""


@query("n", "prediction", TREE_SQL, 3)
def ml_regression_tree(spark, d):
    """Leaves of a tree for prices: rows and what is predicted for them."""
    lines = _lines(spark, d)
    model = trees.decision_tree(lines, FEATURES, "l_extendedprice", DEPTH, "mse")
    return trees.predict(lines, model).groupBy("prediction").agg(F.count("*").alias("n"))


@query("back predicted n")
def ml_random_forest(spark, d):
    """What a forest makes of returned lines and others. Held against an exact search in the tests."""
    lines = _lines(spark, d)
    model = trees.random_forest(lines.withColumn("id", F.hash("l_orderkey", "l_linenumber")), [*FEATURES, "l_extendedprice"], "back", "id", n_trees=10, depth=4)
    return trees.predict(lines, model, "predicted").groupBy("back", "predicted").agg(F.count("*").alias("n"))


@query("n", "mse")
def ml_gradient_boosting(spark, d):
    """Mean squared error of boosted trees for prices. Held against an exact search in the tests."""
    lines = _lines(spark, d)
    model = trees.gradient_boosting(lines, FEATURES, "l_extendedprice", n_trees=6, depth=3, rate=0.5)
    apart = F.col("prediction") - F.col("l_extendedprice")
    return trees.predict(lines, model).agg(F.count("*").alias("n"), F.avg(apart * apart).alias("mse"))


DBSCAN_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_retailprice - 900) / 2 AS y FROM part),
near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 1.25),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
arc AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id, id AS root FROM core UNION SELECT b, root FROM reach JOIN arc ON a = id AND root < b),
named AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
number AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS label FROM (SELECT DISTINCT root FROM named)),
inner_ AS (SELECT id, label FROM named JOIN number USING (root)),
edge AS (SELECT a AS id, min(label) AS label FROM near JOIN inner_ ON b = inner_.id WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
SELECT p.id, coalesce(inner_.label, edge.label, -1) AS label FROM p LEFT JOIN inner_ USING (id) LEFT JOIN edge USING (id)"""


@query("id label", "", DBSCAN_SQL)
def ml_dbscan(spark, d):
    """Parts by size and price."""
    points = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("x"), ((F.col("p_retailprice") - 900) / 2).alias("y"))
    return clustering.dbscan(points, 1.25, 5)


@query("flag", "estimate lower upper std_error", digits=3)
def stats_bootstrap_ci(spark, d):
    """Mean price of a line by flag, with bounds from 1,000 resamples. Held against numpy in the tests."""
    return resampling.bootstrap_ci(table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("flag"), "l_extendedprice"), "l_extendedprice", "id", by=["flag"])


@query("o_orderkey lines", "", "SELECT o_orderkey, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def join_bloom_filtered(spark, d):
    """Lines of urgent orders: a filter of the orders' keys drops other lines before they are shuffled."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.filtered_join(lines, urgent, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("lines"))
