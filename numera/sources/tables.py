"""Readers, and the inputs that the queries derive from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one series a user: g, idx (from 0), v."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("g"), (F.row_number().over(w) - 1).alias("idx"), F.col("value").alias("v"))


SERIES_SQL = "SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v FROM events"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a matrix in coordinates: i, j, v."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


MATRIX_SQL = "SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings"


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer -> supplier (suppliers have negative ids), weighted by the number of order lines."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return joined.groupBy(F.col("o_custkey").alias("src"), (-1 - F.col("l_suppkey")).alias("dst")).agg(F.count("*").cast("double").alias("w"))


TRADE_SQL = "SELECT o_custkey AS src, -1 - l_suppkey AS dst, count(*)::DOUBLE AS w FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"
