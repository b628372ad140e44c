"""Clusters by density, on cells: no task holds a crowded place, and no pairs are made within one."""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .running import running_sums, written

#: A crowded cell meets its neighbours in parts of about as many points.
SPLIT = 20_000
#: Boxes with as many pairs of points at most are compared point by point.
SMALL = 4_096
#: The number of neighbouring cells grows with the power of the dimensions: 5, 21, 117, 609.
MOST_DIMENSIONS = 4


def _apart(gaps: list[Column]) -> Column:
    return F.sqrt(sum((g * g for g in gaps[1:]), gaps[0] * gaps[0]))


def _nearest(alow: str, ahigh: str, blow: str, bhigh: str, d: int) -> Column:
    """Least distance that points of two boxes can have. Rounding keeps order, so no pair of points comes out nearer."""
    return _apart([F.greatest(F.lit(0.0), F.col(blow)[k] - F.col(ahigh)[k], F.col(alow)[k] - F.col(bhigh)[k]) for k in range(d)])


def _farthest(alow: str, ahigh: str, blow: str, bhigh: str, d: int) -> Column:
    return _apart([F.greatest(F.col(bhigh)[k] - F.col(alow)[k], F.col(ahigh)[k] - F.col(blow)[k]) for k in range(d)])


def _box(d: int) -> list[Column]:
    return [F.count("*").alias("n"), F.array(*(F.min(F.col("x")[k]) for k in range(d))).alias("low"), F.array(*(F.max(F.col("x")[k]) for k in range(d))).alias("high")]


def _around(cell: str, offsets: list[tuple[int, ...]]) -> Column:
    return F.explode(F.array(*(F.array(*(F.col(cell)[k] + o for k, o in enumerate(off))) for off in offsets)))


def _reached(some: DataFrame, cells: DataFrame, points: DataFrame, offsets, eps: float, d: int) -> tuple[DataFrame, DataFrame]:
    """Of a few points a cell (k, x, cell): the cells around that lie wholly within eps (k, cell, n), and the single points of
    the other cells that do (k, cell, other). A crowded cell's points are dealt to parts, the few points go to each part."""
    near = some.select("k", F.col("x").alias("px"), _around("cell", offsets).alias("cell")).join(cells, "cell").where(_nearest("px", "px", "low", "high", d) <= eps)
    near = near.withColumn("whole", _farthest("px", "px", "low", "high", d) <= eps)
    parts = F.ceil(F.col("n") / SPLIT)
    ask = near.where("NOT whole").select("k", "px", "cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    dealt = points.select("cell", F.col("k").alias("other"), F.col("x").alias("ox"))
    dealt = dealt.join(cells.select("cell", parts.alias("parts")), "cell").withColumn("part", F.pmod(F.xxhash64("other"), "parts")).drop("parts")
    single = ask.join(dealt, ["cell", "part"]).where(_nearest("px", "px", "ox", "ox", d) <= eps)
    return near.where("whole").select("k", "cell", "n"), single.select("k", "cell", "other")


def _linked_cells(core: DataFrame, offsets, eps: float, d: int) -> DataFrame:
    """a, b: pairs of cells with points at most eps apart, one of each. core: cell, x.

    The boxes of two cells' points tell where they must be so near, or can't be. Where they tell neither, both are cut in the middle
    and their parts compared, until that tells or few points are left: a crowd meets a crowd in a few boxes, not in pairs.
    """
    points = written(core.select("cell", F.lit(0).cast("long").alias("box"), "x"))
    boxes = written(points.groupBy("cell", "box").agg(*_box(d)))
    forward = [o for o in offsets if o > (0,) * d]

    def side(s: str) -> DataFrame:
        return boxes.select(F.col("cell").alias(s), F.col("box").alias(f"{s}box"), F.col("n").alias(f"{s}n"), F.col("low").alias(f"{s}low"), F.col("high").alias(f"{s}high"))

    pairs = side("a").withColumn("b", _around("a", forward)).join(side("b"), "b")
    found = None
    while True:
        judged = pairs.where(_nearest("alow", "ahigh", "blow", "bhigh", d) <= eps).withColumn("sure", _farthest("alow", "ahigh", "blow", "bhigh", d) <= eps)
        judged = written(judged.select("a", "b", "abox", "bbox", "an", "bn", "sure"))
        sure = judged.where("sure").select("a", "b").distinct()
        found = written(sure if found is None else found.unionByName(sure))
        left = judged.where("NOT sure").join(found, ["a", "b"], "left_anti")
        few = left.where(F.col("an") * F.col("bn") <= SMALL)
        of = lambda s: points.select(F.col("cell").alias(s), F.col("box").alias(f"{s}box"), F.col("x").alias(f"{s}x"))
        met = few.join(of("a"), ["a", "abox"]).join(of("b"), ["b", "bbox"]).where(_nearest("ax", "ax", "bx", "bx", d) <= eps)
        found = written(found.unionByName(met.select("a", "b").distinct()))
        open_ = written(left.where(F.col("an") * F.col("bn") > SMALL).select("a", "b", "abox", "bbox").join(found, ["a", "b"], "left_anti"))
        if open_.isEmpty():
            return found.distinct()
        # the boxes still in question, cut in the middle of each side
        asked = open_.select(F.col("a").alias("cell"), F.col("abox").alias("box")).unionByName(open_.select(F.col("b").alias("cell"), F.col("bbox").alias("box"))).distinct()
        asked = asked.join(boxes.select("cell", "box", "low", "high"), ["cell", "box"])
        asked = written(asked)
        cut = points.join(asked, ["cell", "box"])
        upper = [F.when((F.col("low")[k] < F.col("high")[k]) & ((F.col("x")[k] > F.col("low")[k] + (F.col("high")[k] - F.col("low")[k]) / 2) | (F.col("x")[k] == F.col("high")[k])), 1 << k).otherwise(0) for k in range(d)]
        points = written(cut.select("cell", F.col("box").alias("parent"), F.xxhash64("box", sum(upper[1:], upper[0])).alias("box"), "x"))
        parts = written(points.groupBy("cell", "parent", "box").agg(*_box(d)))
        points, boxes = points.drop("parent"), parts.groupBy("cell", "box").agg(F.sum("n").alias("n"), *(F.array(*(f(F.col(c)[k]) for k in range(d))).alias(c) for c, f in (("low", F.min), ("high", F.max))))
        child = lambda s: parts.select(F.col("cell").alias(s), F.col("parent").alias(f"{s}box"), F.col("box").alias(f"{s}part"), F.col("n").alias(f"{s}n"), F.col("low").alias(f"{s}low"), F.col("high").alias(f"{s}high"))
        pairs = open_.join(child("a"), ["a", "abox"]).join(child("b"), ["b", "bbox"]).drop("abox", "bbox").withColumnsRenamed({"apart": "abox", "bpart": "bbox"})


def dbscan(points: DataFrame, eps: float, min_samples: int, id_: str = "id", by: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """id, label: clusters numbered from 0 by their smallest core id, -1 for noise.

    A point is core if at least min_samples other points lie within eps of it. Core points within eps of each other share
    a cluster; others within eps of core points go to the lowest cluster among those, or are noise. Rows with a null or NaN
    are left out; repeated rows are points of their own; ids should be distinct for the numbering to have no ties. An
    empty table gives an empty result.

    Cells are so small that all points of one are within eps of each other: a crowded cell is core as a whole. Only points of
    cells with few are compared with those around, and of crowded cells only boxes are (see _linked_cells).
    """
    d = len(by)
    if not eps > 0 or not 1 <= d <= MOST_DIMENSIONS:
        raise ValueError(f"eps has to be positive, and dimensions 1 to {MOST_DIMENSIONS}")
    side = eps / math.sqrt(d) * (1 - 1e-9)
    reach = math.ceil(math.sqrt(d) / (1 - 1e-9))
    # cells whose nearest corners are too far apart are left out
    offsets = [o for o in product(range(-reach, reach + 1), repeat=d) if sum(max(abs(v) - 1, 0) ** 2 for v in o) * side * side <= eps * eps * (1 + 1e-6)]
    x = F.array(*(F.col(c).cast("double") for c in by))
    rows = points.select(F.col(id_).alias("id"), x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    cell = F.transform("x", lambda v: F.floor(v / side).cast("long"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("k"), "id", "x", cell.alias("cell")))
    cells = written(rows.groupBy("cell").agg(*_box(d)))
    crowded = cells.where(F.col("n") > min_samples).select("cell")
    sparse = rows.join(crowded, "cell", "left_anti").select("k", "x", "cell")

    whole, single = _reached(sparse, cells, rows, offsets, eps, d)
    counts = whole.unionByName(single.select("k", "cell", F.lit(1).cast("long").alias("n"))).groupBy("k").agg((F.sum("n") - 1).alias("near"))
    tested = written(sparse.join(counts, "k").withColumn("is_core", F.col("near") >= min_samples))
    core = written(rows.join(crowded, "cell", "left_semi").select("k", "id", "x", "cell").unionByName(rows.join(tested.where("is_core").select("k"), "k", "left_semi").select("k", "id", "x", "cell")))

    named = written(core.groupBy("cell").agg(F.min("id").alias("first"), *_box(d)).withColumn("node", F.monotonically_increasing_id()))
    of = lambda s, n: named.select(F.col("cell").alias(s), F.col("node").alias(n))
    links = _linked_cells(core, offsets, eps, d).join(of("a", "src"), "a").join(of("b", "dst"), "b").select("src", "dst")
    groups = connected_components(links.withColumn("w", F.lit(1.0))).withColumnRenamed("id", "node")
    named = written(named.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = named.groupBy("component").agg(F.min("first").alias("first"))
    labels = running_sums(first.withColumn("one", F.lit(1).cast("long")), [], [F.col("first"), F.col("component")], {"number": "one"}).select("component", (F.col("number") - 1).alias("label"))
    named = written(named.join(labels, "component").select("cell", "n", "low", "high", "label"))

    edge = tested.where("NOT is_core").select("k", "x", "cell")
    whole, single = _reached(edge, named, core, offsets, eps, d)
    taken = whole.select("k", "cell").unionByName(single.select("k", "cell")).join(named.select("cell", "label"), "cell").groupBy("k").agg(F.min("label").alias("label"))
    of_core = core.select("k", "id", "cell").join(named.select("cell", "label"), "cell").select("id", "label")
    of_rest = rows.join(edge.select("k"), "k", "left_semi").join(taken, "k", "left").select("id", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))
    return of_core.unionByName(of_rest)
