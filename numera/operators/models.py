"""Models whose fit is a few aggregates: the rows are never collected, only sums of products are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import running_sums
from .stats import gram


def covariance(points: DataFrame, i: str = "id", vec: str = "vec") -> DataFrame:
    """i, j, v: sample covariance of an array's places. Rows without a vector, or with a null in it, are left out; an empty
    table gives an empty result."""
    points = points.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull()))
    cells = points.select(F.col(i).alias("_r"), F.posexplode(F.col(vec).cast("array<double>")).alias("k", "x"))
    n = points.count()
    means = cells.groupBy("k").agg(F.avg("x").alias("m"))
    packed = points.select(F.col(vec).cast("array<double>").alias("v"))
    left = packed.select("v", F.posexplode("v").alias("i", "x"))
    sums = left.select("i", "x", F.posexplode("v").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    a, b = means.select(F.col("k").alias("i"), F.col("m").alias("mi")), means.select(F.col("k").alias("j"), F.col("m").alias("mj"))
    return sums.join(a, "i").join(b, "j").select("i", "j", ((F.col("s") - n * F.col("mi") * F.col("mj")) / max(n - 1, 1)).alias("v"))


def pca(points: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """component, variance, loadings: eigenvectors of the covariance (places x places on the driver); the largest loading is positive."""
    import numpy as np

    rows = covariance(points.withColumn("id", F.lit(0)), "id", vec).collect()
    n = 1 + max((r["i"] for r in rows), default=-1)
    c = np.zeros((n, n))
    for r in rows:
        c[r["i"], r["j"]] = r["v"]
    values, vectors = np.linalg.eigh(c)
    out = []
    for m, at in enumerate(np.argsort(-values)[:k]):
        v = vectors[:, at]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        out.append((m, float(values[at]), [float(x) for x in v]))
    return points.sparkSession.createDataFrame(out, "component int, variance double, loadings array<double>")


def ridge(df: DataFrame, xs: list[str], y: str, penalty: float) -> DataFrame:
    """name, coefficient: with an intercept, which is not penalised. Rows with a null are left out; no rows: zeros."""
    import numpy as np

    g = gram(df.withColumn("_one", F.lit(1.0)), ["_one", *xs, y])
    if not g[0, 0]:
        return df.sparkSession.createDataFrame([(n, 0.0) for n in ["intercept", *xs]], "name string, coefficient double")
    a = g[:-1, :-1] + penalty * np.diag([0.0] + [1.0] * len(xs))
    beta = np.linalg.solve(a, g[:-1, -1])
    return df.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(["intercept", *xs], beta)], "name string, coefficient double")


def lasso(df: DataFrame, xs: list[str], y: str, penalty: float, rounds: int = 1000) -> DataFrame:
    """Coordinate descent on sums of products, without an intercept; the loss is half the sum of squares over n. Rows with a
    null are left out; no rows: zeros."""
    import numpy as np

    df = df.dropna(subset=[*xs, y])
    n = max(df.count(), 1)
    g = gram(df, [*xs, y]) / n
    beta = np.zeros(len(xs))
    for _ in range(rounds):
        old = beta.copy()
        for j in range(len(xs)):
            rho = g[j, -1] - g[j, :-1] @ beta + g[j, j] * beta[j]
            beta[j] = np.sign(rho) * max(abs(rho) - penalty, 0) / g[j, j] if g[j, j] > 0 else 0.0
        if np.abs(beta - old).max() < 1e-12:
            break
    return df.sparkSession.createDataFrame([(k, float(b)) for k, b in zip(xs, beta)], "name string, coefficient double")


def naive_bayes(points: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """label, k, mean, var (population), share: the Gaussian model of each class and place."""
    cells = points.select(label, F.posexplode(F.col(vec).cast("array<double>")).alias("k", "x"))
    shares = points.groupBy(label).agg(F.count("*").alias("n"))
    total = points.count()
    return cells.groupBy(label, "k").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")).join(shares, label).select(label, "k", "mean", "var", (F.col("n") / total).alias("share"))


def naive_bayes_predict(points: DataFrame, model: DataFrame, id_: str = "id", label: str = "label", vec: str = "vec") -> DataFrame:
    """id, predicted: the class of the largest log posterior, ties by class. The model has classes x places rows and is broadcast."""
    cells = points.select(F.col(id_).alias("id"), F.posexplode(F.col(vec).cast("array<double>")).alias("k", "x"))
    v = F.col("var") + 1e-9
    ll = F.sum(-F.ln(2 * 3.141592653589793 * v) / 2 - (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")) / (2 * v)) + F.ln(F.first("share"))
    scores = cells.join(F.broadcast(model), "k").groupBy("id", label).agg(ll.alias("s"))
    return scores.groupBy("id").agg(F.max(F.struct("s", (-F.col(label)).alias("c"))).alias("b")).select("id", (-F.col("b.c")).alias("predicted"))


def losses(df: DataFrame, p: str, y: str, delta: float = 1.0) -> DataFrame:
    """binary_crossentropy (p kept within 1e-12 of 0 and 1), huber, hinge (of y 0/1 as -1/+1)."""
    q = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col(p)))
    e = F.abs(F.col(y) - F.col(p))
    return df.agg(
        F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("binary_crossentropy"), F.avg(F.when(e <= delta, e * e / 2).otherwise(delta * (e - delta / 2))).alias("huber"),
        F.avg(F.greatest(F.lit(0.0), 1 - (2 * F.col(y) - 1) * F.col(p))).alias("hinge"),
    )


def average_precision(df: DataFrame, p: str, y: str) -> DataFrame:
    """Mean precision at each step of recall, from counts by score, ranged. Rows with a null are left out."""
    by = df.dropna(subset=[p, y]).groupBy(p).agg(F.count_if(F.col(y) >= 0.5).alias("a"), F.count("*").alias("n"))
    steps = running_sums(by, [], [F.desc(p)], {"hits": "a", "all": "n"}).select("a", (F.col("hits") / F.col("all")).alias("precision"))
    return steps.agg((F.sum(F.col("a") * F.col("precision")) / F.nullif(F.sum("a").cast("double"), F.lit(0.0))).alias("average_precision"))


def hash_split(df: DataFrame, keys: list[str], share: float, seed: int = 42) -> DataFrame:
    """df with test boolean: by the keys' hash, so that a row is on the same side whenever it is read."""
    return df.withColumn("test", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1_000_000)) < int(share * 1_000_000))
