"""Vietoris-Rips complexes of points of the plane, up to triangles, and the persistence of their components.

Edges come from cells as wide as the radius, so only neighbours meet; triangles from the edges of each corner with the
fewest, of which a corner of m edges in all has at most the root of 2 m. A complex has as many edges as it has: a radius
that makes most points neighbours makes most pairs of them edges. Where only their number is asked for, or which of them
join components, none is moved or written: both take points by cells, and a task holds one cell and what surrounds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .digraph import minimum_spanning_forest
from .geo import within_distance
from .running import written


def rips_edges(points: DataFrame, radius: float, id_: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """a, b, at: a < b at most radius apart, and their distance. Points with a null are left out; ids are unique."""
    p = points.select(F.col(id_).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    return within_distance(p, radius).select("a", "b", F.col("distance").alias("at"))


def rips_triangles(edges: DataFrame) -> DataFrame:
    """a, b, c, at: three points (a < b < c) of which each two are joined, and the longest of their edges."""
    e = written(edges.select("a", "b", "at"))
    n = written(e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n")))
    known = e.join(n.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    low, high = F.struct(F.col("na").alias("n"), F.col("a").alias("id")), F.struct(F.col("nb").alias("n"), F.col("b").alias("id"))
    out = written(known.select(F.least(low, high)["id"].alias("u"), F.greatest(low, high).alias("v"), "at"))
    left, right = out.select("u", F.col("v").alias("v"), "at"), out.select("u", F.col("v").alias("w"), F.col("at").alias("at2"))
    wedges = left.join(right, "u").where("v < w").select("u", F.col("v.id").alias("v"), F.col("w.id").alias("w"), F.greatest("at", "at2").alias("at1"))
    third = e.withColumnRenamed("at", "at3")
    closed = wedges.join(third, (F.least("v", "w") == third["a"]) & (F.greatest("v", "w") == third["b"]))
    sides = F.array_sort(F.array("u", "v", "w"))
    return closed.select(*(F.element_at(sides, k + 1).alias(c) for k, c in enumerate("abc")), F.greatest("at1", "at3").alias("at"))


#: Points of a cell whose edges and triangles one task counts; those of larger cells are dealt to several.
OWNERS = 4_096
#: Points whose neighbours are marked at a time, as bits in a table with a row for each neighbour.
MARKED = 16_384
#: Points of a block in which nearest neighbours are sought at first.
CROWD = 256
#: How often the radius of that search is halved at most, where points crowd.
HALVINGS = 40
#: Numbers of a table of distances that is held at a time.
DISTANCES = 1 << 20
#: Cells and blocks are wider than the radius asks for by this share, so that rounding never puts neighbours too far apart.
WIDER = 1 + 1e-9


def _count_cell(radius: float):
    """Of a cell's own points (place 0, dealt to slices) and those of the cells after it: edges and triangles whose first
    point is an own one of the slice. Points stand for n points at one place each."""

    def run(key, f):
        import numpy as np
        import pandas as pd

        f = f.sort_values(["ahead", "x", "y"], kind="stable")  # places are distinct: no ties
        x, y, n = (f[c].to_numpy() for c in ("x", "y", "n"))
        own = np.flatnonzero((f["ahead"] == 0) & (f["slice"] == key[-1]))
        near = lambda i, j: np.sqrt((x[i, None] - x[None, j]) ** 2 + (y[i, None] - y[None, j]) ** 2) <= radius
        single = int(n.max()) == 1
        after = []  # of each own point: its neighbours that come after it
        edges = triangles = 0
        step = max(1, DISTANCES // len(x))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            for u, row in zip(some.tolist(), near(some, np.arange(len(x)))):
                v = np.flatnonzero(row[u + 1 :]) + u + 1
                c, m = int(n[u]), n[v]
                with_one, with_two = int(m.sum()), sum(int(k) * (int(k) - 1) // 2 for k in m[m > 1])
                edges += c * with_one + c * (c - 1) // 2
                triangles += c * (c - 1) // 2 * with_one + c * with_two + c * (c - 1) * (c - 2) // 6
                after.append(v.astype(np.int32))
        for a in range(0, len(x), MARKED):
            third = np.arange(a, min(a + MARKED, len(x)))
            words = -(-len(third) // 64)
            rows = np.zeros((len(x), words * 8), np.uint8)
            step = max(1, DISTANCES // len(third))
            for at in range(0, min(int(third[-1]) + 1, len(x)), step):
                second = np.arange(at, min(at + step, len(x)))
                packed = np.packbits(near(second, third) & (third[None] > second[:, None]), axis=1)
                rows[second, : packed.shape[1]] = packed
            rows = rows.view(np.uint64)
            planes = []  # how many points a place stands for, bit by bit
            for bit in range(int(n[third].max()).bit_length()):
                plane = np.zeros(words * 8, np.uint8)
                packed = np.packbits(n[third] >> bit & 1 == 1)
                plane[: len(packed)] = packed
                planes.append(plane.view(np.uint64))
            for u, v in zip(own.tolist(), after):
                marks = np.zeros(words * 64, bool)
                marks[v[(v >= a) & (v <= third[-1])] - a] = True
                mine = np.packbits(marks).view(np.uint64)
                for at in range(0, len(v), max(1, DISTANCES // words)):
                    second = v[at : at + max(1, DISTANCES // words)]
                    shared = rows[second] & mine
                    for bit, plane in enumerate(planes):
                        found = np.bitwise_count(shared if single else shared & plane).sum(1, dtype=np.int64)
                        triangles += (int(n[u]) << bit) * (int(found.sum()) if single else sum(int(p) * int(q) for p, q in zip(found, n[second])))
        return pd.DataFrame({"edges": [str(edges)], "triangles": [str(triangles)]})

    return run


def rips_counts(points: DataFrame, radius: float, id_: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """dim (0 to 2), n: how many points, edges and triangles the complex has.

    Cells are half as wide as the radius; a cell's points meet those of the cells after it that are within reach. Points at
    one place are one row with their number. In a task, bits tell who is whose neighbour, so a triangle is a bit of a word
    and never a row: a point is sent to 13 cells, whatever the radius, and what is shuffled grows as the points do.
    """
    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col(id_).isNotNull()).dropna()
    p = written(p.groupBy("x", "y").agg(F.count("*").alias("n")))
    cell = lambda c: F.floor(F.col(c) / (radius / 2 * WIDER))
    at = p.withColumns({"cx": cell("x"), "cy": cell("y")})
    # a cell's slices, by which its own points are dealt; all of them see all that surrounds it
    sizes = written(at.groupBy("cx", "cy").agg(F.ceil(F.count("*") / OWNERS).cast("int").alias("slices")))
    ahead = [(dx, dy) for dx in range(3) for dy in range(-2, 3) if (dx, dy) >= (0, 0)]
    to = F.explode(F.array(*(F.struct((F.col("cx") - dx).alias("cx"), (F.col("cy") - dy).alias("cy"), F.lit(k).alias("ahead")) for k, (dx, dy) in enumerate(ahead))))
    sent = at.select("x", "y", "n", to.alias("to")).select("x", "y", "n", "to.*").join(sizes, ["cx", "cy"])
    dealt = sent.select("x", "y", "n", "cx", "cy", "ahead", F.pmod(F.xxhash64("x", "y"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"))
    got = dealt.groupBy("cx", "cy", "part").applyInPandas(_count_cell(radius), "edges string, triangles string")
    whole = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("long")
    counts = got.agg(whole("edges").alias("e"), whole("triangles").alias("t")).join(p.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("p")))  # a row each
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("dim"), F.col(c).alias("n")) for k, c in enumerate("pet"))))
    return counts.select(each.alias("r")).select("r.*")


def _nearest(reach: float):
    """Of a block: for each point to be done (closed is 0 or more: bits of the sectors that have an edge already) its edge to
    the nearest point of each other sector within reach, without those that close a circle as its longest edge; and the
    points, with the bits of their sectors (b is a, w is -1)."""

    def run(f):
        import numpy as np
        import pandas as pd

        own, all_ = f[f["closed"] >= 0], f[f["closed"] < 0].reset_index(drop=True)
        x, y, ids = all_["x"].to_numpy(), all_["y"].to_numpy(), all_["id"].to_numpy()
        place = {p: k for k, p in enumerate(zip(x.tolist(), y.tolist()))}
        ox, oy, closed = own["x"].to_numpy(), own["y"].to_numpy(), own["closed"].to_numpy().copy()
        pairs, lengths = [], []
        step = max(1, DISTANCES // len(x))
        for at in range(0, len(own), step):
            s = slice(at, at + step)
            dx, dy = x[None] - ox[s, None], y[None] - oy[s, None]
            d = np.sqrt(dx**2 + dy**2)
            d[(d > reach) | ((dx == 0) & (dy == 0))] = np.inf
            sector = (dx < 0) * 4 + (dy < 0) * 2 + (np.abs(dx) < np.abs(dy))
            here = np.array([place[p] for p in zip(ox[s].tolist(), oy[s].tolist())])
            for k in range(8):
                todo = np.flatnonzero(closed[s] >> k & 1 == 0)
                of = np.where(sector[todo] == k, d[todo], np.inf)
                best = of.argmin(1)
                w = of[np.arange(len(todo)), best]
                got = np.isfinite(w)
                closed[at + todo[got]] |= 1 << k
                pairs.append(np.stack([here[todo[got]], best[got]], 1))
                lengths.append(w[got])
        ends, w = np.concatenate(pairs), np.concatenate(lengths)
        root, kept = list(range(len(x))), []

        def find(a):
            while root[a] != a:
                root[a] = a = root[root[a]]
            return a

        for i in np.lexsort((ends.max(1), ends.min(1), w)).tolist():
            a, b = find(int(ends[i, 0])), find(int(ends[i, 1]))
            if a != b:
                root[a] = b
                kept.append(i)
        edges = pd.DataFrame({"a": ids[ends[kept, 0]], "b": ids[ends[kept, 1]], "w": w[kept], "closed": -1})
        return pd.concat([edges, pd.DataFrame({"a": own["id"], "b": own["id"], "w": -1.0, "closed": closed})])

    return run


def joining_edges(spots: DataFrame, radius: float) -> DataFrame:
    """src, dst, w: edges of at most the radius, some few a point, that connect at any length whatever all edges connect.
    spots: id, x, y, none of them at the same place as another.

    Of the edges from a point into an eighth of a turn only the shortest is needed: the ends of any longer one are closer
    to each other's neighbours than to each other. It is sought in blocks with a margin, at first in small ones where points
    crowd; points without one in some sector go on to blocks twice as wide, up to the radius. A block whose double has at
    most CROWD points waits for that.
    """
    spots = spots.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    block = lambda c, reach: F.floor(c / (4 * reach * WIDER))
    of = lambda reach: (block(F.col("x"), reach).alias("bx"), block(F.col("y"), reach).alias("by"))
    reaches = [radius]
    while len(reaches) <= HALVINGS and not spots.groupBy(*of(reaches[-1])).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).isEmpty():
        reaches.append(reaches[-1] / 2)
    kind = spots.schema["id"].dataType.simpleString()
    open_, found = spots.withColumn("closed", F.lit(0)), []
    for reach in reversed(reaches):
        last = reach == radius
        todo, wait = open_, None
        if not last:
            full = written(spots.groupBy(*of(2 * reach)).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("bx", "by"))
            named = open_.select("*", *of(2 * reach))
            todo, wait = (named.join(full, ["bx", "by"], how).select("id", "x", "y", "closed") for how in ("left_semi", "left_anti"))
        todo = todo.select("*", *of(reach))
        span = lambda c: F.explode(F.sequence(block(F.col(c) - reach * WIDER, reach), block(F.col(c) + reach * WIDER, reach)))
        around = spots.withColumn("bx", span("x")).withColumn("by", span("y")).join(todo.select("bx", "by").distinct(), ["bx", "by"], "left_semi")
        rows = todo.unionByName(around.withColumn("closed", F.lit(-1)))
        got = written(rows.groupBy("bx", "by").applyInPandas(_nearest(reach), f"a {kind}, b {kind}, w double, closed int"))
        found.append(got.where("closed < 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"))
        if not last:
            left = got.where("closed >= 0 AND closed < 255").select(F.col("a").alias("id"), "closed").join(spots, "id").select("id", "x", "y", "closed")
            open_ = written(left.unionByName(wait))
    return reduce(DataFrame.unionByName, found)


def persistence_of_components(points: DataFrame, radius: float, id_: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """birth, death, n: the diagram of dimension 0, with how many components share a death. All are born at 0; death is the
    length at which a component joins another, null where that is beyond the radius.

    Deaths are the edges of the least spanning forest, which is sought among a few edges a point. Points at one place die at
    0: they are counted, not paired. Points with a null are left out; without points there are no rows.
    """
    p = points.select(F.col(id_).alias("id"), F.col(x).alias("x"), F.col(y).alias("y")).dropna()
    spots = written(p.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    forest = written(minimum_spanning_forest(joining_edges(spots, radius)))
    born = F.lit(0.0).alias("birth")
    joined = forest.groupBy(F.col("w").alias("death")).agg(F.count("*").alias("n")).select(born, "death", "n")
    copies = spots.agg(F.sum(F.col("n") - 1).alias("n")).select(born, F.lit(0.0).alias("death"), "n")
    left = spots.agg(F.count("*").alias("_p")).join(forest.agg(F.count("*").alias("_f")))  # a row each
    stay = left.select(born, F.lit(None).cast("double").alias("death"), (F.col("_p") - F.col("_f")).alias("n"))
    return joined.unionByName(copies).unionByName(stay).where("n > 0")
