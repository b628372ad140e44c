"""Parts of a graph that hang together, so that each small one can be solved whole in a task and only large ones by rounds.

Edges are joined up where they lie first: each task tells, of some edges at a time, which hang together, and only vertices
that more than one of these pieces holds link pieces across tasks. So edges that are made together cost little more than a
pass, and edges in any order the rounds of `graph.connected_components`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .running import written

#: Edges of a part up to which it is solved whole in a task.
WHOLE = 1 << 17
#: Edges that are joined up at a time, and edges of a task that solves parts, about.
TASK = 1 << 20


def _least_connected(u, v):
    """Of each edge the least vertex that these edges connect it to."""
    import numpy as np

    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low, x, y = label.copy(), label[a], label[b]
        for to, what in ((a, y), (b, x), (x, y), (y, x)):
            np.minimum.at(low, to, what)
        low = low[low]
        if np.array_equal(low, label):
            return ids[label[a]]
        label = low


def _pieces(it):
    import pyarrow as pa

    def joined(held):
        t = pa.Table.from_batches(held).combine_chunks()
        label = pa.array(_least_connected(t.column(0).to_numpy(), t.column(1).to_numpy()), pa.int64())
        return t.append_column("_part", label).to_batches()

    held, n = [], 0
    for b in it:
        held.append(b)
        n += b.num_rows
        if n >= TASK:
            yield from joined(held)
            held, n = [], 0
    if n:
        yield from joined(held)


def parted(edges: DataFrame) -> DataFrame:
    """edges, written, with _part: the least vertex of what each hangs together with. The first two columns are an edge's
    vertices (long, no nulls); direction is not looked at."""
    u, v = edges.columns[:2]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema.fields)
    pieces = written(edges.mapInArrow(_pieces, f"{schema}, _part long"))
    ends = pieces.select(F.col(u).alias("id"), "_part").unionByName(pieces.select(F.col(v).alias("id"), "_part"))
    torn = written(ends.groupBy("id").agg(F.min("_part").alias("least"), F.max("_part").alias("most")).where("least <> most").select("id", "least"))
    if torn.isEmpty():
        return pieces
    links = ends.join(torn, "id").where("_part <> least").select(F.col("_part").alias("src"), F.col("least").alias("dst")).distinct()
    roots = written(connected_components(written(links)).select(F.col("id").alias("_part"), F.col("component").alias("_root")))
    return written(pieces.join(roots, "_part", "left").select(*edges.columns, F.coalesce("_root", "_part").alias("_part")))


def by_size(parts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Of parted edges those of parts that fit a task, those of larger ones, and the number of tasks to deal the first to."""
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"))
    large = F.broadcast(written(sizes.where(F.col("n") > WHOLE).select("_part")))  # at most one of WHOLE edges
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // TASK))
    return parts.join(large, "_part", "left_anti"), parts.join(large, "_part", "left_semi").drop("_part"), tasks
