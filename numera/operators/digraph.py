"""Components, orders and forests of graphs given as edges src, dst, w. Each round is written to the checkpoint folder.

Edges with a null end are left out; repeated edges and loops are allowed everywhere. Rows meet on vertices or on contracted
vertices and are aggregated in each task before they are shuffled; of what meets on one vertex, one side has one row for it.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import by_size, parted
from .running import running_sums, written

log = logging.getLogger("numera.graph")


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def _vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).where("id IS NOT NULL").distinct()


def _coloured(arcs: DataFrame, seed: int) -> tuple[DataFrame, int]:
    """id, f, b: of the vertices that reach id and of those that id reaches (itself included) the least in an order drawn
    from the seed; and the rounds that took. Colours pass along the arcs and jump to their own vertex's colour."""
    own = F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), "id")
    now = written(_vertices(arcs).select("id", own.alias("f"), own.alias("b")))
    rounds = 0
    while True:
        ahead = arcs.join(now.select(F.col("id").alias("src"), "f"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("f").alias("f1"))
        behind = arcs.join(now.select(F.col("id").alias("dst"), "b"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("b").alias("b1"))
        step = now.join(ahead, "id", "left").join(behind, "id", "left").select("id", F.least("f", "f1").alias("f"), F.least("b", "b1").alias("b"), F.col("f").alias("f0"), F.col("b").alias("b0"))
        of_f, of_b = now.select(F.col("id").alias("i"), F.col("f").alias("f2")), now.select(F.col("id").alias("j"), F.col("b").alias("b2"))
        step = step.join(of_f, F.col("f.id") == F.col("i")).join(of_b, F.col("b.id") == F.col("j"))
        step = written(step.select("id", F.least("f", "f2").alias("f"), F.least("b", "b2").alias("b"), "f0", "b0"))
        rounds += 1
        now = step.select("id", "f", "b")
        if step.where("f <> f0 OR b <> b0").isEmpty():
            return now, rounds


def _strong(src, dst):
    """ids, and of each the least one that lies on cycles with it, by the colours of strongly_connected_components."""
    import numpy as np

    ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = at[: len(src)], at[len(src) :]
    a, b = a[a != b], b[a != b]
    root, draw = np.arange(len(ids)), np.random.default_rng(1)
    while len(a):
        f = draw.permutation(len(ids))
        of, back = np.argsort(f), f.copy()
        while True:
            f1, b1 = f.copy(), back.copy()
            np.minimum.at(f1, b, f[a])
            np.minimum.at(b1, a, back[b])
            f1, b1 = np.minimum(f1, f1[of[f1]]), np.minimum(b1, b1[of[b1]])
            if np.array_equal(f, f1) and np.array_equal(back, b1):
                break
            f, back = f1, b1
        done = f == back
        live = np.zeros(len(ids), bool)
        live[a] = live[b] = True
        root[live & done] = of[f[live & done]]
        stay = (f[a] == f[b]) & (back[a] == back[b]) & ~done[a]
        a, b = a[stay], b[stay]
    least = np.arange(len(ids))
    np.minimum.at(least, root, np.arange(len(ids)))
    return ids, ids[least[root]]


def _strong_tasks(it):
    import pyarrow as pa

    held = list(it)
    t = pa.Table.from_batches(held) if held else None
    if t is not None and t.num_rows:
        found = _strong(t.column(0).to_numpy(), t.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["id", "component"])


def strongly_connected_components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every vertex. An empty graph gives an empty result.

    What hangs together in few arcs is solved in a task that holds it whole, larger parts by strong_by_rounds(); so are all
    vertices that are not numbers.
    """
    kinds = dict(edges.dtypes)
    if {kinds["src"], kinds["dst"]} != {"bigint"}:
        return strong_by_rounds(edges)
    small, large, tasks = by_size(parted(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")))
    found = small.repartition(tasks, "_part").select("src", "dst").mapInArrow(_strong_tasks, "id long, component long")
    return found if large.isEmpty() else found.unionByName(strong_by_rounds(large))


def strong_by_rounds(edges: DataFrame) -> DataFrame:
    """As strongly_connected_components, for parts of any size.

    Vertices are put in a random order. Each takes as its colours the least vertex that reaches it and the least that it
    reaches; where both are one, it lies on a cycle with that vertex, and with all others of these colours. Arcs between
    different colours lie on no cycle: they go, as do settled vertices and those without arcs to them or from them, and
    the rest takes colours in a new order. Chains of components are cut in many places at a time. Rounds are logged.
    """
    everyone = written(_vertices(edges))
    arcs = written(_arcs(edges).where("src <> dst"))
    settled, rounds, seed = [], 0, 0
    while True:
        into, out = arcs.select(F.col("dst").alias("src")).distinct(), arcs.select(F.col("src").alias("dst")).distinct()
        arcs = written(arcs.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        if arcs.isEmpty():
            break
        colours, took = _coloured(arcs, seed)
        seed, rounds = seed + 1, rounds + took
        settled.append(written(colours.where("f = b").select("id", F.col("f.id").alias("r"))))
        x = colours.where("f <> b").select(F.col("id").alias("src"), F.col("f").alias("f1"), F.col("b").alias("b1"))
        y = colours.where("f <> b").select(F.col("id").alias("dst"), F.col("f").alias("f2"), F.col("b").alias("b2"))
        arcs = arcs.join(x, "src").join(y, "dst").where("f1 = f2 AND b1 = b2").select("src", "dst")
    log.info("strongly connected components: %d orders, %d rounds", seed, rounds)
    inside = everyone.limit(0).select("id", F.col("id").alias("r"))
    for s in settled:
        inside = inside.unionByName(s)
    names = inside.groupBy("r").agg(F.min("id").alias("component"))
    alone = everyone.join(inside.select("id"), "id", "left_anti")
    return inside.join(names, "r").select("id", "component").unionByName(alone.select("id", F.col("id").alias("component")))


def is_strongly_connected(edges: DataFrame) -> bool:
    return strongly_connected_components(edges).select("component").distinct().count() == 1


class CycleError(ValueError):
    """The graph has a cycle, so it has no topological order."""


def topological_levels(edges: DataFrame) -> DataFrame:
    """id, level: the number of arcs on the longest path to the vertex. Layers without arcs to them are peeled off one after
    the other, as many rounds as the longest path has vertices. A cycle, loops included, is an error."""
    arcs = written(_arcs(edges))
    waiting = written(_vertices(edges))
    layers, level, left = [], 0, waiting.count()
    empty = waiting.limit(0).withColumn("level", F.lit(0))
    while left:
        free = written(waiting.join(arcs.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(level)))
        n = free.count()
        if not n:
            raise CycleError(f"{left} vertices lie on cycles or behind them")
        layers.append(free)
        waiting = written(waiting.join(free.select("id"), "id", "left_anti"))
        arcs = written(arcs.join(free.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst"))
        level, left = level + 1, left - n
    for x in layers:
        empty = empty.unionByName(x)
    return empty


def topological_sort(edges: DataFrame) -> DataFrame:
    """id, level, position (from 0): every arc leads to a later position. Within a level the order is that of the ids."""
    levels = topological_levels(edges).withColumn("one", F.lit(1).cast("long"))
    return running_sums(levels, [], [F.col("level"), F.col("id")], {"t": "one"}).select("id", "level", (F.col("t") - 1).alias("position"))


def is_dag(edges: DataFrame) -> bool:
    try:
        topological_levels(edges)
    except CycleError:
        return False
    return True


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """src, dst, w (src < dst) of the lightest edges that connect whatever is connected; direction is not looked at.

    Ties of weight go by src, then dst, so the forest is the one that taking edges in that order gives. Borůvka: in each
    round every contracted vertex takes its least edge, and what these connect becomes one vertex; between two vertices
    only the least edge is kept. At least half of the vertices with edges go in each round. Null weights are left out.
    """
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND w IS NOT NULL")
    e = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
    between = written(e.groupBy("a", "b").agg(F.min(F.struct("w", F.col("a").alias("u"), F.col("b").alias("v"))).alias("e")))
    empty = between.limit(0).select("e")
    taken, rounds = [], 0
    while not between.isEmpty():
        ends = between.select("a", "b", "e").unionByName(between.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        least = ends.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", "m.e", "m.b")
        least = written(least)
        taken.append(least.select("e").distinct())
        # each vertex points across its edge; of two that point at each other the smaller is the root
        back = least.select(F.col("a").alias("b"), F.col("b").alias("c"))
        to = written(least.join(back, "b").select("a", F.when((F.col("c") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("root")))
        while True:
            jump = to.select(F.col("a").alias("root"), F.col("root").alias("further"))
            step = written(to.join(jump, "root").select("a", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved")))
            to = step.select("a", "root")
            if step.where("moved").isEmpty():
                break
        merged = between.join(to.withColumnRenamed("root", "x"), "a").join(to.select(F.col("a").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        between = written(merged.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("e").alias("e")))
        rounds += 1
    log.info("minimum spanning forest: %d rounds", rounds)
    for t in taken:
        empty = empty.unionByName(t)
    return empty.distinct().select(F.col("e.u").alias("src"), F.col("e.v").alias("dst"), F.col("e.w").alias("w"))


def _from_sources(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """s, id, d, paths: steps and number of shortest paths from each source, level by level."""
    front = written(sources.select(F.col("id").alias("s"), "id", F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("s", "id")
    while True:
        new = front.join(arcs, front["id"] == arcs["src"]).groupBy("s", F.col("dst").alias("id")).agg((F.min("d") + 1).alias("d"), F.sum("paths").alias("paths"))
        front = written(new.join(seen, ["s", "id"], "left_anti"))
        if front.isEmpty():
            return levels
        levels.append(front)
        seen = seen.unionByName(front.select("s", "id"))


def betweenness_centrality(edges: DataFrame, batches: int | None = None) -> DataFrame:
    """id, betweenness: of all ordered pairs of other vertices, the share of shortest paths (in steps, along the arcs) that
    pass through, over (n - 1)(n - 2); 0 where there are fewer than 3 vertices.

    All vertices are sources, in batches by a hash: counts of paths go forward level by level, dependencies back. What is
    held at a time is (sources in a batch) x (vertices they reach) rows; by default so many batches that this is some
    million rows. Arcs count once however often they are repeated, loops not at all.
    """
    arcs = written(_arcs(edges).where("src <> dst"))
    ids = written(_vertices(edges))
    n = ids.count()
    batches = batches or max(1, n * n // 4_000_000)
    total = ids.withColumn("part", F.lit(0.0)).select("id", "part")
    for k in range(batches):
        levels = _from_sources(arcs, ids.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
        behind = None
        for d in range(len(levels) - 1, 0, -1):
            own = levels[d]
            own = own.withColumn("dep", F.lit(0.0)) if behind is None else own.join(behind, ["s", "id"], "left").fillna(0.0, ["dep"])
            own = written(own)
            total = total.unionByName(own.select("id", F.col("dep").alias("part")))
            up = levels[d - 1].select("s", F.col("id").alias("src"), F.col("paths").alias("p"))
            passed = own.join(arcs.withColumnRenamed("dst", "id"), "id").join(up, ["s", "src"])
            behind = passed.groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("p") / F.col("paths") * (1 + F.col("dep"))).alias("dep"))
        total = written(total.groupBy("id").agg(F.sum("part").alias("part")))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return total.groupBy("id").agg((F.sum("part") * scale).alias("betweenness"))


def closeness_centrality(edges: DataFrame, batches: int | None = None) -> DataFrame:
    """id, closeness: the number of other vertices that it reaches over the sum of their weighted distances; 0 where it
    reaches none. Weights must not be negative; null weights are left out. Sources go in batches, as for betweenness."""
    arcs = written(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND w IS NOT NULL").groupBy("src", "dst").agg(F.min("w").cast("double").alias("w")))
    ids = written(_vertices(edges))
    n = ids.count()
    batches = batches or max(1, n * n // 4_000_000)
    found = []
    for k in range(batches):
        best = written(ids.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k).select(F.col("id").alias("s"), "id", F.lit(0.0).alias("dist")))
        front = best
        while True:
            seen = front.join(arcs, front["id"] == arcs["src"]).groupBy("s", F.col("dst").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("near"))
            step = written(seen.join(best, ["s", "id"], "left").where("dist IS NULL OR near < dist").select("s", "id", F.col("near").alias("dist")))
            if step.isEmpty():
                break
            front = step
            best = written(best.join(front, ["s", "id"], "left_anti").unionByName(front))
        found.append(written(best.where("s <> id").groupBy(F.col("s").alias("id")).agg(F.count("*").alias("k"), F.sum("dist").alias("far"))))
    sums = found[0]
    for x in found[1:]:
        sums = sums.unionByName(x)
    return ids.join(sums, "id", "left").select("id", F.when(F.col("far") > 0, F.col("k") / F.col("far")).otherwise(0.0).alias("closeness"))
