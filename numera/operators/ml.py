"""Model scores, scaling, neighbours and clustering over columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import running_sums

#: Queries that meet a batch of points at a time.
QUERIES = 512


def confusion(df: DataFrame, p: str, y: str, limit: float = 0.5) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1."""
    a, b = F.col(p) >= limit, F.col(y) >= 0.5
    c = df.agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"), F.count_if(~a & ~b).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    safe = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)
    c = c.withColumns({"accuracy": safe(tp + tn, tp + fp + fn + tn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn)})
    return c.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc_auc(df: DataFrame, p: str, y: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half. From counts by score, ranged: rows are not sorted. Rows with a null are left out."""
    by = df.dropna(subset=[p, y]).groupBy(p).agg(F.count_if(F.col(y) >= 0.5).alias("a"), F.count_if(F.col(y) < 0.5).alias("b"))
    by = running_sums(by, [], [F.col(p)], {"upto": "b"})
    won = by.select("a", "b", (F.col("a") * (F.col("upto") - F.col("b") / 2)).alias("u"))
    return won.agg((F.sum("u") / F.nullif((F.sum("a") * F.sum("b")).cast("double"), F.lit(0.0))).alias("auc"))


def regression_scores(df: DataFrame, p: str, y: str) -> DataFrame:
    """mse, rmse, mae, r2."""
    e = F.col(y) - F.col(p)
    return df.agg(F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))


def standard_scale(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """(x - mean) / sqrt(population variance + 1e-12). One row of statistics goes to the driver."""
    row = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("v", F.var_pop)))).first()
    return df.select(*key, *(((F.col(c) - (row[f"m_{c}"] or 0.0)) / ((row[f"v_{c}"] or 0.0) + 1e-12) ** 0.5).alias(c) for c in columns))


def min_max_scale(df: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    row = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max)))).first()
    span = lambda c: (row[f"b_{c}"] or 0.0) - (row[f"a_{c}"] or 0.0)
    return df.select(*key, *((((F.col(c) - row[f"a_{c}"]) / span(c)) if span(c) else F.lit(0.0)).alias(c) for c in columns))


def _nearest(q_vectors, k: int):
    """Of the points of a task: the k nearest to each query. Products of matrices tell which points may be among them; the
    distances of those are then taken coordinate by coordinate."""

    def run(it):
        import numpy as np
        import pandas as pd

        a = q_vectors.value
        square = (a * a).sum(1)
        best = pd.DataFrame({"q": np.zeros(0, np.int64), "distance": np.zeros(0)})
        limit = np.full(len(a), np.inf)
        for f in it:
            if not len(f):
                continue
            b = np.stack(f["vec"].to_numpy()).astype(float)
            of_b = (b * b).sum(1)
            found = []
            for at in range(0, len(a), QUERIES):
                s = slice(at, at + QUERIES)
                d = square[s, None] + of_b[None] - 2 * (a[s] @ b.T)
                slack = 1e-9 * (square[s, None] + of_b[None]) + 1e-300  # far beyond what rounding can do
                high = d + slack
                if len(b) > k:
                    high = np.partition(high, k - 1, axis=1)[:, :k]
                most = high.max(1) if len(b) >= k else np.full(len(high), np.inf)
                q, p = np.nonzero(d - slack <= np.minimum(most, limit[s])[:, None])
                total = np.zeros(len(q))
                for c in range(b.shape[1]):
                    total += (a[at + q, c] - b[p, c]) ** 2
                found.append(pd.DataFrame({"q": at + q, "id": f["id"].to_numpy()[p], "distance": np.sqrt(total)}))
            best = pd.concat([best, *found] if len(best) else found).sort_values(["q", "distance", "id"]).groupby("q").head(k)
            full = best.groupby("q")["distance"].agg(["size", "max"])
            full = full[full["size"] == k]
            limit[full.index.to_numpy()] = full["max"].to_numpy() ** 2 * (1 + 1e-9) + 1e-300
        if len(best):
            yield best[["q", "id", "distance"]]

    return run


def knn(queries: DataFrame, points: DataFrame, k: int, q: str = "q", id_: str = "id", vec: str = "vec") -> DataFrame:
    """q, id, distance, rank: the k nearest points of each query by Euclidean distance, ties by id. Queries are the small,
    stated side and are sent to all; each task keeps k points a query, so no pair beyond those is a row. Rows without a
    vector, or with a null in it, are left out; all vectors have to be of one length."""
    import numpy as np

    spark = points.sparkSession
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda v: v.isNull())
    asked = queries.where(whole(vec)).select(F.col(q).alias("q"), F.col(vec).cast("array<double>").alias("vec")).toArrow()
    n = asked.num_rows
    names = spark.createDataFrame(asked.select(["q"]).append_column("_n", [list(range(n))])) if n else queries.select(F.col(q).alias("q"), F.lit(0).cast("long").alias("_n")).limit(0)
    a = np.stack(asked.column("vec").to_numpy()) if n else np.zeros((0, 1))
    rows = points.where(whole(vec)).select(F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    kind = rows.schema["id"].dataType.simpleString()
    few = rows.mapInPandas(_nearest(spark.sparkContext.broadcast(a), k), f"q long, id {kind}, distance double").withColumnRenamed("q", "_n")
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("_n").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return ranked.join(names, "_n").select("q", "id", "distance", "rank")


def kmeans(points: DataFrame, k: int, id_: str = "id", vec: str = "vec", rounds: int = 20) -> DataFrame:
    """id, cluster. Starts from the k points of smallest id; only k centres are on the driver. An empty cluster's centre becomes 0.
    Rows without a vector, or with a null in it, are left out; an empty table gives an empty result."""
    import numpy as np

    rows = points.select(F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    centres = np.array([r["x"] for r in rows.orderBy("id").limit(k).collect()])
    if not len(centres):
        return rows.select("id", F.lit(0).cast("long").alias("cluster"))
    cluster = None
    for _ in range(rounds):
        far = [F.aggregate(F.zip_with("x", F.lit([float(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in centres]
        dist = F.array(*far)
        cluster = rows.select("id", "x", (F.array_position(dist, F.array_min(dist)) - 1).alias("cluster"))
        sums = cluster.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("x")[d]).alias(f"s{d}") for d in range(centres.shape[1]))).collect()
        new = np.zeros_like(centres)
        for r in sums:
            new[r["cluster"]] = [r[f"s{d}"] / r["n"] for d in range(centres.shape[1])]
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new
    return cluster.select("id", "cluster")
