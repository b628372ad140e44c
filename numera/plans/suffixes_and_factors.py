"""Queries over the order of suffixes and over factors of sales."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factorize, suffixes
from ..sources.tables import table
from .registry import query

_SUFFIXES = """SELECT p_partkey, p, row_number() OVER (PARTITION BY p_partkey ORDER BY substr(p_name, p + 1)) - 1 AS r,
CASE WHEN p = 0 THEN 0 ELSE ascii(substr(p_name, p, 1)) END AS c
FROM (SELECT p_partkey, p_name, unnest(range(length(p_name) + 1)) AS p FROM part)"""


@query("p_partkey primary_index codes", sql=f"SELECT p_partkey, max(r) FILTER (WHERE p = 0) AS primary_index, string_agg(c, ',' ORDER BY r) AS codes FROM ({_SUFFIXES}) GROUP BY 1")
def compress_bwt(spark, d):
    b = suffixes.bwt(suffixes.symbols(table(spark, d, "part"), "p_partkey", "p_name"))
    codes = F.transform(F.array_sort(F.collect_list(F.struct("row", "c"))), lambda x: x["c"].cast("string"))
    return b.groupBy(F.col("g").alias("p_partkey")).agg(F.max(F.when(F.col("whole"), F.col("row"))).alias("primary_index"), F.array_join(codes, ",").alias("codes"))


@query("line text", sql="SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line, p_name AS text FROM part")
def compress_bwt_column(spark, d):
    """The whole column as one text, transformed and back."""
    b = suffixes.bwt(suffixes.column_symbols(table(spark, d, "part"), "p_partkey", "p_name"))
    return suffixes.lines(suffixes.ibwt(b.drop("whole")))


def _sales(spark, d):
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select("l_suppkey", "p_size", "l_returnflag", F.col("l_quantity").cast("double").alias("v"))


@query("mode coordinate component", "x", digits=4)
def tensor_cp(spark, d):
    """Quantities by supplier, size and return flag: two components."""
    modes = ["l_suppkey", "p_size", "l_returnflag"]
    made, weights, _ = factorize.cp(_sales(spark, d), modes, 2, rounds=50, tolerance=1e-4)
    scaled = [made[0].withColumn("x", F.col("x") * F.element_at(F.array(*map(F.lit, weights)), F.col("component") + 1)), *made[1:]]
    out = [f.select(F.lit(m).alias("mode"), F.col(m).cast("string").alias("coordinate"), "component", "x") for m, f in zip(modes, scaled)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("side coordinate component", "x", digits=4)
def tensor_nmf(spark, d):
    """Quantities by supplier and size: three parts, none negative."""
    w, h, _ = factorize.nmf(_sales(spark, d), 3, "l_suppkey", "p_size", tolerance=1e-3)
    return w.select(F.lit("supplier").alias("side"), F.col("l_suppkey").alias("coordinate"), "component", "x").unionByName(h.select(F.lit("size").alias("side"), F.col("p_size").alias("coordinate"), "component", "x"))
