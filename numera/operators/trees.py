"""Decision trees, random forests and boosted trees over columns, grown level by level from histograms.

Each level takes one aggregate of (tree, node, feature, bin), added up in numpy in each task before it is shuffled; cuts are
sought on Spark, and the driver gets one row a node. A row finds its node by walking the trees so far, so nothing is kept by
row, and no row is copied for a tree or a feature.
Rows with a null or NaN among features or target are left out of a fit, and predicted as null. An empty table gives one
leaf with value 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import resampling
from .running import dropped, written

#: Bins of a feature. A feature with no more distinct values has one bin for each, and its cuts are those of an exact search.
BINS = 256
#: A tree is an array of 2^(depth + 1) places; a level has a row for each node on the driver.
MOST_DEPTH = 12
MOST_CLASSES = 100
#: Scores of cuts are compared after rounding to as many digits relative to the node's spread, so that ties are ties.
DIGITS = 10

#: Boosting takes what its trees say off the target, and writes that, after as many trees.
WRITE_EVERY = 8
#: Places of a level's histograms that a task holds, over all trees and features; of more, each batch of rows sends its own.
HELD = 1 << 20


@dataclass
class Trees:
    """Trees as heaps: node k has the children 2k (up to the cut) and 2k + 1; feature is -1 at leaves. Root: 1."""

    features: list[str]
    trees: list[dict] = field(default_factory=list)

    def values(self, x: Column, since: int = 0) -> Column:
        """Array of what each tree says of the features x (array of doubles); null where that is null."""
        trees = self.trees[since:]

        @F.arrow_udf("array<double>")
        def said(x: pa.Array) -> pa.Array:
            known = x.is_valid().to_numpy(zero_copy_only=False)
            at = x.flatten().to_numpy(zero_copy_only=False).reshape(known.sum(), -1)
            found = np.stack([np.array(t["value"])[_walk(t, at)] for t in trees], 1) if trees else np.zeros((len(at), 0))
            ends = np.concatenate([[0], np.cumsum(known)]) * len(trees)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ravel(), pa.float64()), mask=pa.array(~known))

        return said(x)


def _walk(tree: dict, x):
    """The node of the tree in which each row of x ends."""
    feature, cut = np.array(tree["feature"]), np.array(tree["cut"])
    node = np.ones(len(x), np.int64)
    row = np.arange(len(x))
    for _ in range(_depth([tree])):
        f = feature[node]
        node = np.where(f < 0, node, 2 * node + (x[row, np.maximum(f, 0)] > cut[node]))
    return node


def _depth(trees: list[dict]) -> int:
    return max((len(t["feature"]).bit_length() - 2 for t in trees), default=0)


def _features(df: DataFrame, features: list[str]) -> Column:
    x = F.array(*(F.col(c).cast("double") for c in features))
    return F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v)), x)


def bin_edges(rows: DataFrame, p: int, bins: int = BINS, values: DataFrame | None = None) -> list[list[float]]:
    """For each place of the array x the largest values of its bins but the last: all its values where these are few, else
    quantiles. values: x of the rows without repeats, where that is at hand."""
    known = rows if values is None else values
    stats = known.agg(*(F.approx_count_distinct(F.col("x")[k]).alias(f"d{k}") for k in range(p))).first()
    # the estimate of the number of values may be off by some percent: beyond the bins they are counted as many
    few = [k for k in range(p) if stats[f"d{k}"] <= 2 * bins]
    exact = known.agg(*(F.collect_set(F.col("x")[k]).alias(f"v{k}") for k in few)).first() if few else {}
    many = [k for k in range(p) if k not in few or len(exact[f"v{k}"]) > bins]
    shares = [k / bins for k in range(1, bins)]
    quantiles = rows.agg(*(F.percentile_approx(F.col("x")[k], shares, 100 * bins).alias(f"q{k}") for k in many)).first() if many else {}
    return [sorted({*(quantiles[f"q{k}"] or [])}) if k in many else sorted(exact[f"v{k}"])[:-1] for k in range(p)]


def _bins_of(x, edges: list[list[float]]):
    return np.stack([np.searchsorted(np.array(e), x[:, k], side="left") for k, e in enumerate(edges)], 1).astype("i4")


def _numbers(df: DataFrame, features: list[str], y: str, bins: int) -> DataFrame:
    """For a target of numbers: the rows of equal features as one (x, its bins b, their number n, the target's sum s1, sum of
    squares s2, least and most), written once."""
    names = [f"x{k}" for k in range(len(features))]
    flat = df.select(*(F.col(c).cast("double").alias(n) for c, n in zip(features, names)), F.col(y).cast("double").alias("y"))
    flat = flat.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in [*names, "y"]))
    sums = [F.count("*").cast("double").alias("n"), F.sum("y").alias("s1"), F.sum(F.col("y") * F.col("y")).alias("s2"), F.min("y").alias("least"), F.max("y").alias("most")]
    x = F.array(*names).alias("x")
    alike = written(flat.groupBy(*names).agg(*sums).select(x, "n", "s1", "s2", "least", "most"))
    edges = bin_edges(flat.select(x), len(features), bins, alike)

    def batches(it):
        for b in it:
            found = _bins_of(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features)), edges)
            bins_ = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(features), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, bins_], [*b.schema.names, "b"])

    return written(alike.mapInArrow(batches, "x array<double>, n double, s1 double, s2 double, least double, most double, b array<int>"))


def _binned(rows: DataFrame, p: int, bins: int, resamples: int, seed: int) -> DataFrame:
    """rows (x, y, h) with the bin of each feature and the weights in each resample (Poisson draws), written once."""
    edges = bin_edges(rows, p, bins)

    def batches(it):
        for b in it:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            found = _bins_of(x, edges)
            bins_ = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * p, pa.int32()), pa.array(found.ravel()))
            drawn = resampling.weights(b.column("h").to_numpy().view(np.uint64), resamples, seed).astype("i1")
            weights = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * resamples, pa.int32()), pa.array(drawn.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], bins_, weights], ["x", "y", "b", "ws"])

    return written(rows.mapInArrow(batches, "x array<double>, y double, b array<int>, ws array<tinyint>"))


def _spread(s: list[Column], classes: list[float] | None) -> tuple[Column, Column]:
    """Weight of a side, and its weight times its impurity (Gini, or mean squared deviation)."""
    if classes is None:
        return s[0], s[2] - s[1] * s[1] / s[0]
    n = sum(s[1:], s[0])
    return n, n - sum((c * c for c in s[1:]), s[0] * s[0]) / n


def _moved(b, x, start: float, rate: float, before: list[dict]) -> list:
    """n, s1, s2, least and most of a batch of _numbers, of the target less start and rate times what trees say."""
    n, s1, s2, least, most = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "s1", "s2", "least", "most"))
    f = start + rate * sum((np.array(t["value"])[_walk(t, x)] for t in before), np.zeros(len(x)))
    return [n, s1 - n * f, s2 - 2 * f * s1 + n * f * f, least - f, most - f]


class _Histograms:
    """Of the rows that reach a level: sums by tree, node, feature and bin, and by tree and node (feature -1). Sums are such
    that their differences give a side's impurity: weights by class, or weight, sum and sum of squares of the target."""

    def __init__(self, trees: list[dict], level: int, weighted: bool, chosen: list[list[int]], classes: list[float] | None, cuts: bool, bins: int, said: tuple):
        self.trees, self.level, self.weighted, self.chosen, self.classes, self.cuts, self.bins, self.said = trees, level, weighted, chosen, classes, cuts, bins, said

    def target(self, b, x) -> tuple:
        """How many rows a row stands for, the least and most of the target, and the sums: of the target's distance from what
        the trees before say, which is start and rate times their values, where it is a number."""
        if self.classes is not None:
            y = b.column("y").to_numpy(zero_copy_only=False)
            return np.ones(len(x)), y, y, lambda i, w: [np.where(y[i] == c, w, 0.0) for c in self.classes]
        n, s1, s2, least, most = _moved(b, x, *self.said)
        return n, least, most, lambda i, w: [n[i], s1[i], s2[i]]

    def parts(self, b):
        """tree, feature, places (node and bin as one number), least and most there, rows, sums."""
        p = len(b.column("x")[0].as_py()) if b.num_rows else 0
        x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
        bin_ = b.column("b").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
        ws = b.column("ws").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if self.weighted else None
        rows, least, most, sums = self.target(b, x)
        for t, tree in enumerate(self.trees):
            node = _walk(tree, x)
            here = node >= 2**self.level
            if self.weighted:
                here &= ws[:, t] > 0
            i = np.flatnonzero(here)
            if not len(i):
                continue
            at = node[i] - 2**self.level
            s = [rows[i], *sums(i, ws[i, t].astype(float) if self.weighted else np.ones(len(i)))]
            yield t, -1, at * self.bins, least[i], most[i], s
            for f in self.chosen[t] if self.cuts else ():
                yield t, f, at * self.bins + bin_[i, f], x[i, f], x[i, f], s

    def rows(self, found: dict):
        for (t, f), (low, high, *sums) in found.items():
            at = np.flatnonzero(sums[0])
            if len(at):
                node = [pa.array(np.full(len(at), t), pa.int32()), pa.array(at // self.bins + 2**self.level, pa.int32()), pa.array(np.full(len(at), f), pa.int32()), pa.array(at % self.bins, pa.int32())]
                yield pa.RecordBatch.from_arrays([*node, *(pa.array(c[at], pa.float64()) for c in (low, high, *sums))], self.names())

    def names(self) -> list[str]:
        n = 3 if self.classes is None else len(self.classes)
        return ["tree", "node", "f", "bin", "low", "high", "rows", *(f"s{k}" for k in range(n))]

    def __call__(self, it):
        size = 2**self.level * self.bins
        # sums of a level stay in the task as long as they are few; else each batch of rows sends its own
        keep = size * sum(len(c) + 1 for c in self.chosen) <= HELD
        found: dict = {}
        for b in it:
            for t, f, at, least, most, s in self.parts(b):
                if (t, f) not in found:
                    found[t, f] = [np.full(size, np.inf), np.full(size, -np.inf), *(np.zeros(size) for _ in s)]
                low, high, *sums = found[t, f]
                np.minimum.at(low, at, least)
                np.maximum.at(high, at, most)
                for total, more in zip(sums, s):
                    total += np.bincount(at, more, size)
                if not keep:
                    yield from self.rows(found)
                    found = {}
        yield from self.rows(found)


def _grow(rows: DataFrame, model: Trees, weighted: bool, chosen: list[list[int]], depth: int, classes: list[float] | None, bins: int = BINS, said: tuple = (0.0, 0.0, [])) -> None:
    """Adds one tree for each list of chosen features to the model. rows: x, y, b, ws for classes (weighted: a row counts as
    ws says, by tree), else those of _numbers; said: start, rate and the trees whose sum is taken from the target."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth has to be 0 to {MOST_DEPTH}")
    size = 2 ** (depth + 1)
    new = [{"feature": [-1] * size, "cut": [0.0] * size, "value": [0.0] * size} for _ in chosen]
    for level in range(depth + 1):
        sought = _Histograms(new, level, weighted, chosen, classes, level < depth, bins + 1, said)
        names = sought.names()[7:]
        schema = "tree int, node int, f int, bin int, " + ", ".join(f"{c} double" for c in sought.names()[4:])
        key = ["tree", "node", "f", "bin"]
        found = rows.mapInArrow(sought, schema).groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.sum(c).alias(c) for c in ["rows", *names]))
        found = written(found)
        nodes = {}
        for r in found.where("f < 0").collect():  # bounded by trees and 2^depth
            s = [r[n] for n in names]
            new[r["tree"]]["value"][r["node"]] = s[1] / s[0] if classes is None else classes[max(range(len(s)), key=lambda k: (s[k], -k))]
            if r["rows"] > 1 and r["high"] - r["low"] > (1e-12 if classes is None else 0.0):
                nodes[r["tree"], r["node"]] = r
        if level == depth or not nodes:
            dropped(found)
            break
        # nodes that hold one value of the target, or one row, stay leaves
        open_ = F.from_json(F.lit(json.dumps([[n for t, n in nodes if t == k] for k in range(len(new))])), "array<array<int>>")
        here = found.where("f >= 0").where(F.array_contains(F.get(open_, F.col("tree")), F.col("node")))
        one = W.partitionBy("tree", "node", "f")
        upto, all_ = one.orderBy("bin").rowsBetween(W.unboundedPreceding, 0), one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        cuts = here.select("tree", "node", "f", "high", F.lead("low").over(one.orderBy("bin")).alias("next"), *(F.sum(n).over(upto).alias(f"l_{n}") for n in names), *(F.sum(n).over(all_).alias(f"t_{n}") for n in names))
        left = [F.col(f"l_{n}") for n in names]
        whole = [F.col(f"t_{n}") for n in names]
        (_, a), (_, b), (n, c) = _spread(left, classes), _spread([t - x for t, x in zip(whole, left)], classes), _spread(whole, classes)
        score = F.round((a + b) / c, DIGITS)
        best = cuts.where("next IS NOT NULL").select("tree", "node", F.struct(score.alias("score"), "f", "high", "next").alias("cut")).groupBy("tree", "node").agg(F.min("cut").alias("cut"))
        for r in best.collect():
            new[r["tree"]]["feature"][r["node"]] = r["cut"]["f"]
            new[r["tree"]]["cut"][r["node"]] = (r["cut"]["high"] + r["cut"]["next"]) / 2
        dropped(found)
    model.trees += new


def _prepared(df: DataFrame, features: list[str], y: str, id_: str | None, bins: int, resamples: int = 0, seed: int = 0) -> DataFrame:
    h = F.xxhash64(F.col(id_)) if id_ else F.lit(0).cast("long")
    rows = df.select(_features(df, features).alias("x"), F.col(y).cast("double").alias("y"), h.alias("h")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    return _binned(rows, len(features), bins, resamples, seed)


def _classes(rows: DataFrame) -> list[float]:
    found = [r["y"] for r in rows.select("y").distinct().orderBy("y").limit(MOST_CLASSES + 1).collect()]
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    return found or [0.0]


def decision_tree(df: DataFrame, features: list[str], y: str, depth: int = 5, criterion: str = "gini", bins: int = BINS) -> Trees:
    """A tree for classes (gini) or numbers (mse). A node takes the cut of least impurity, whether it gains or not; ties go to
    the first feature and the lowest cut, which lies midway between the values of the node on its sides. Leaves hold the
    most frequent class (ties: the smallest), or the mean."""
    gini, model = criterion == "gini", Trees(features)
    rows = _prepared(df, features, y, None, bins) if gini else _numbers(df, features, y, bins)
    _grow(rows, model, False, [list(range(len(features)))], depth, _classes(rows) if gini else None, bins)
    return model


def random_forest(df: DataFrame, features: list[str], y: str, id_: str, n_trees: int = 50, depth: int = 5, feature_share: float = 0.7, seed: int = 42, bins: int = BINS) -> Trees:
    """Trees for classes, each on a resample and some of the features. Resamples are Poisson weights drawn by a hash of the
    id, so they don't depend on partitions; rows with equal ids are drawn together."""
    import random

    rows, model = _prepared(df, features, y, id_, bins, n_trees, seed), Trees(features)
    some, n = random.Random(seed), max(1, round(feature_share * len(features)))
    chosen = [sorted(some.sample(range(len(features)), n)) for _ in range(n_trees)]
    _grow(rows, model, True, chosen, depth, _classes(rows), bins)
    return model


@dataclass
class Boosted:
    start: float
    rate: float
    trees: Trees


def gradient_boosting(df: DataFrame, features: list[str], y: str, n_trees: int = 50, depth: int = 3, rate: float = 0.1, bins: int = BINS) -> Boosted:
    """Trees for numbers, each fitted to what the ones before leave of the target."""
    rows, model = _numbers(df, features, y, bins), Trees(features)
    start = rows.agg(F.sum("s1") / F.nullif(F.sum("n"), F.lit(0.0))).first()[0] or 0.0
    p, rest, since = len(features), (start, rate, []), 0
    for k in range(n_trees):
        if k - since == WRITE_EVERY:
            old, rows, since = rows, _written_rest(rows, p, rest), k
            dropped(old)
            rest = (0.0, rate, [])
        _grow(rows, model, False, [list(range(p))], depth, None, bins, rest)
        rest = (*rest[:2], model.trees[since:])
    return Boosted(start, rate, model)


def _written_rest(rows: DataFrame, p: int, said: tuple) -> DataFrame:
    def batches(it):
        for b in it:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            yield pa.RecordBatch.from_arrays([b.column("x"), *map(pa.array, _moved(b, x, *said)), b.column("b")], b.schema.names)

    return written(rows.mapInArrow(batches, rows.schema))


def predict(df: DataFrame, model: Trees | Boosted, out: str = "prediction") -> DataFrame:
    """df with a column of predictions: the tree's value, the forest's vote (ties: the smallest class), or the boosted sum."""
    trees = model.trees if isinstance(model, Boosted) else model
    x = _features(df, trees.features)
    kept = df.columns
    df = df.withColumn("_said", trees.values(x))  # a column of its own, so that it is asked once
    said, x = F.col("_said"), F.col("_said")
    if isinstance(model, Boosted):
        value = model.start + model.rate * F.aggregate(said, F.lit(0.0), lambda s, v: s + v)
    elif len(trees.trees) == 1:
        value = F.get(said, F.lit(0))
    else:
        votes = F.transform(F.array_sort(F.array_distinct(said)), lambda c: F.struct(F.size(F.filter(said, lambda v: v == c)).alias("n"), (-c).alias("c")))
        value = -F.array_max(votes)["c"]
    return df.withColumn("_value", F.when(x.isNotNull(), value)).select(*(c for c in kept if c != out), F.col("_value").alias(out))
