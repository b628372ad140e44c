"""Kendall's rank correlation by counting inversions range by range, without a join of all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums, written

#: Rows of a block of neighbouring x whose pairs are counted within one task.
BLOCK = 1 << 15
#: Rows of all bits that a task makes, about.
EXPLODED = 2_000_000


def _surplus(x, y, n):
    """Pairs in the same order less pairs in opposite order, ties in neither. x, y: dense ranks; n: how often each pair of
    values occurs. Exact: Python integers hold the total."""
    import numpy as np

    total = 0
    for level in range(int(x.max(initial=0)).bit_length()):
        parent, right = x >> (level + 1), (x >> level) & 1 == 1
        order = np.lexsort((y, parent))
        p, yy, a, b = parent[order], y[order], np.where(right, 0, n)[order], np.where(right, n, 0)[order]
        below = np.concatenate([[0], np.cumsum(a)])
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        group = np.searchsorted(starts, np.arange(len(p)), "right") - 1
        first = starts[group]
        ends = np.concatenate([starts[1:], [len(p)]])[group]
        runs = np.concatenate([[True], (p[1:] != p[:-1]) | (yy[1:] != yy[:-1])])
        run_starts = np.flatnonzero(runs)
        run = np.cumsum(runs) - 1
        run_ends = np.concatenate([run_starts[1:], [len(p)]])
        less = below[run_starts[run]] - below[first]
        more = below[ends] - below[run_ends[run]]
        total += sum(int(v) for v in (b * (less - more))[b > 0])
    return total


def _blocks(key, frame):
    import numpy as np
    import pandas as pd

    x = np.unique(frame["x"].to_numpy(), return_inverse=True)[1]
    y = np.unique(frame["y"].to_numpy(), return_inverse=True)[1]
    return pd.DataFrame({"s": [str(_surplus(x, y, frame["n"].to_numpy().astype(np.int64)))]})


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: tau, the pairs of rows in the same order by x and y less those in opposite order, over all pairs; pairs tied
    in x or y count as neither. Fewer than two rows give 0. Rows with a null are left out.

    Rows are counted by (x, y) first. Neighbouring x make blocks of some BLOCK rows, and an x with more rows than that a
    block of its own, in which all pairs are tied. Pairs within a block are counted in its task. Any two blocks differ in a
    highest bit of their numbers: for each bit, a running count of the lower half in the order of y tells how many of its
    rows each row of the upper half is above and below. All bits go in one range sort, log(rows / BLOCK) rows for each.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    rows = written(rows.groupBy("x", "y").agg(F.count("*").alias("n")))
    xs = rows.groupBy("x").agg(F.sum("n").alias("n")).withColumn("hot", (F.col("n") > BLOCK).cast("long"))
    xs = running_sums(xs, [], [F.col("x")], {"t": "n", "h": "hot"})
    # both parts grow with x
    xs = xs.select("x", "hot", (2 * F.col("h") - F.col("hot")).alias("part"), F.floor((F.col("t") - F.col("n")) / BLOCK).alias("piece"))
    xs = written(xs)
    numbered = running_sums(xs.select("part", "piece").distinct().withColumn("one", F.lit(1).cast("long")), [], [F.col("part"), F.col("piece")], {"block": "one"})
    numbered = written(numbered.select("part", "piece", (F.col("block") - 1).alias("block")))
    placed = written(rows.join(xs, "x").join(numbered, ["part", "piece"]).select("x", "y", "n", "hot", "block"))
    inner = placed.where("hot = 0").groupBy("block").applyInPandas(_blocks, "s string").select(F.col("s").cast("decimal(38,0)").alias("s"))
    last = placed.agg(F.max("block")).first()[0] or 0
    bits = int(last).bit_length()
    parts = inner
    if bits:
        # by y, so that the rows of all bits are added up where they are made, and few enough in a task
        dealt = placed.groupBy("block", "y").agg(F.sum("n").alias("n")).repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-placed.count() * bits // EXPLODED)), "y")
        each = dealt.withColumn("bit", F.explode(F.array(*(F.lit(k) for k in range(bits)))))
        up = F.expr("shiftright(block, bit) & 1")
        sides = each.groupBy("bit", F.expr("shiftright(block, bit + 1)").alias("above"), "y").agg(F.sum(F.when(up == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(up == 1, F.col("n")).otherwise(0)).alias("b"))
        sides = running_sums(sides, ["bit", "above"], [F.col("y")], {"upto": "a"})
        whole = each.where(up == 0).groupBy("bit", F.expr("shiftright(block, bit + 1)").alias("above")).agg(F.sum("n").alias("all"))
        wide = "decimal(19,0)"
        gain = F.col("b").cast(wide) * (2 * F.col("upto") - F.col("a") - F.col("all")).cast(wide)
        parts = parts.unionByName(sides.where("b > 0").join(whole, ["bit", "above"]).select(gain.cast("decimal(38,0)").alias("s")))
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("rows"))
    pairs = F.col("rows") * (F.col("rows") - 1) / 2
    return parts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("s")).join(F.broadcast(n), F.lit(True)).select(F.when(pairs > 0, F.col("s") / pairs).otherwise(0.0).alias("tau"))
