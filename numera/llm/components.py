"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, not_guessed


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """node, root (the smallest node of its component), both long, for each node that has a link. links: u, v long.

    Alternating large-star and small-star rounds, each a few aggregates and joins; the number of rounds grows with the
    logarithm of the number of nodes. Each round is written to the shared folder. Direction, repeats and self-links of
    the input don't matter; an empty input gives an empty result.
    """
    edges = materialize(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = not_guessed(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), now[0])
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, label)
        low = not_guessed(large.groupBy("u").agg(F.min("v").alias("m")), now[0])
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, label)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
