"""Information measures over tables of probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import descriptive as D


def distribution(df: DataFrame, *keys: str) -> DataFrame:
    """keys and p: the shares of the rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    # one row: joined to each of the counts
    return counts.join(F.broadcast(total), F.lit(True)).select(*keys, (F.col("n") / F.col("_total")).alias("p"))


def _log(c, base):
    return F.ln(c) / F.ln(F.lit(base))


def joint_measures(pxy: DataFrame, x: str, y: str, base: float = 2.0) -> DataFrame:
    """joint, conditional (of y given x) and mutual information, from the joint shares p, in one pass over grouping sets."""
    sets = pxy.rollup(x, y).agg(F.sum("p").alias("p"), F.grouping_id().alias("k"))
    by_y = pxy.groupBy(y).agg(F.sum("p").alias("p")).select("p", F.lit(9).alias("k"))
    each = sets.select("p", "k").unionByName(by_y)
    h = lambda k: F.coalesce(-F.sum(F.when((F.col("k") == k) & (F.col("p") > 0), F.col("p") * _log(F.col("p"), base))), F.lit(0.0))
    hx, hy, hxy = h(1), h(9), h(0)
    return each.agg(hxy.alias("joint_entropy"), (hxy - hx).alias("conditional_entropy"), (hx + hy - hxy).alias("mutual_info"))


def divergences(p: DataFrame, q: DataFrame, key: str, base: float = 2.0) -> DataFrame:
    """cross_entropy and kl (cells with p or q of 0 are skipped), js, hellinger, tv, of two tables of shares p by key."""
    both = p.select(key, F.col("p").alias("a")).join(q.select(key, F.col("p").alias("b")), key, "full_outer").select(F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    a, b = F.col("a"), F.col("b")
    ok = (a > 0) & (b > 0)
    m = (a + b) / 2
    side = lambda c: F.sum(F.when(c > 0, c * _log(c / m, base)).otherwise(0.0))
    return both.agg(
        F.coalesce(-F.sum(F.when(ok, a * _log(b, base))), F.lit(0.0)).alias("cross_entropy"), F.coalesce(F.sum(F.when(ok, a * _log(a / b, base))), F.lit(0.0)).alias("kl"),
        ((side(a) + side(b)) / 2).alias("js"), F.sqrt(F.sum(F.pow(F.sqrt(a) - F.sqrt(b), F.lit(2))) / 2).alias("hellinger"), (F.sum(F.abs(a - b)) / 2).alias("tv"),
    )


def entropies(p: DataFrame) -> DataFrame:
    """entropy, normalized, redundancy, renyi2, tsallis2 of a table of shares p."""
    h, n = D.entropy(F.col("p")), F.count("*")
    norm = F.when(n > 1, h / F.log2(n)).otherwise(0.0)
    return p.agg(h.alias("entropy"), norm.alias("normalized"), (1 - norm).alias("redundancy"), D.renyi(F.col("p"), 2.0).alias("renyi2"), D.tsallis(F.col("p"), 2.0).alias("tsallis2"))


def permutation_entropy(series: DataFrame, order: int, g: str = "g", idx: str = "idx", v: str = "v", delay: int = 1) -> DataFrame:
    """g, entropy in bits over the orders of windows; equal values keep their order in time."""
    o = W.partitionBy(g).orderBy(idx)
    cells = [F.struct(F.lead(v, k * delay).over(o).alias("v"), F.lit(k).alias("k")) for k in range(order)]
    seen = series.select(g, F.array(*cells).alias("a")).where(F.forall("a", lambda x: x["v"].isNotNull()))
    shape = F.concat_ws(",", F.transform(F.sort_array("a"), lambda x: x["k"].cast("string")))
    counts = seen.groupBy(g, shape.alias("s")).agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(g)))
    return p.groupBy(g).agg(D.entropy(F.col("p")).alias("entropy"))
