"""Decompositions of tall matrices i, j, v (many rows, few columns) by way of their Gram matrix.

One aggregate over the rows gives the sums of products of columns, columns squared of them, which the driver decomposes;
what has a row for each row of the matrix is a join with a small table. Squaring costs half of the digits for the smallest
singular values; qr goes twice to make up for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linalg import gram_of, times

#: Columns beyond this are an error, as their products would not fit the driver.
COLUMNS = 2048


def _products(a: DataFrame, columns: int):
    """The transpose of a by a, as a numpy array."""
    import numpy as np

    if columns > COLUMNS:
        raise ValueError(f"{columns} columns: at most {COLUMNS}")
    g = np.zeros((columns, columns))
    got = gram_of(a.dropna(subset=["i", "j", "v"]), columns).select("i", "j", "v").toArrow()
    g[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return (g + g.T) / 2


def _table(spark, m) -> DataFrame:
    import pyarrow as pa

    i, j = m.nonzero()
    return spark.createDataFrame(pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "v": pa.array(m[i, j], pa.float64())}))


def svd(a: DataFrame, columns: int, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """u (i, j, v), s (k, s) and v (i, j, v), largest first, without singular values below tolerance times the largest.
    Null entries are left out; an empty matrix has none of them."""
    import numpy as np

    spark, a = a.sparkSession, a.dropna(subset=["i", "j", "v"])
    w, v = np.linalg.eigh(_products(a, columns))
    w, v = np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1]
    kept = w > tolerance * max(w.max(initial=0.0), 1e-300)
    w, v = w[kept], v[:, kept]
    s = spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k long, s double")
    return times(a, columns, v / w), s, _table(spark, v)


def qr(a: DataFrame, columns: int) -> tuple[DataFrame, DataFrame]:
    """q and r, both i, j, v; r has a positive diagonal. Null entries are left out. Columns that depend on each other are an error."""
    import numpy as np

    spark, r = a.sparkSession, np.eye(columns)
    q = a = a.dropna(subset=["i", "j", "v"])
    for _ in range(2):
        try:
            step = np.linalg.cholesky(_products(q, columns)).T
        except np.linalg.LinAlgError as e:
            raise ValueError("the columns depend on each other") from e
        r = step @ r
        q = times(a, columns, np.linalg.inv(r))
    return q, _table(spark, r)


def lsq(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    """j, x: the least-squares solution of a x = b (i, v) of smallest norm; rows that b lacks count
    as 0, null entries are left out."""
    import numpy as np

    a = a.dropna(subset=["i", "j", "v"])
    g, right = _products(a, columns), np.zeros(columns)
    for r in a.join(b.select("i", F.col("v").alias("_b")), "i").groupBy("j").agg(F.sum(F.col("v") * F.col("_b")).alias("v")).collect():
        right[r["j"]] = r["v"]
    x = np.linalg.lstsq(g, right, rcond=1e-14)[0]
    return a.sparkSession.createDataFrame([(j, float(v)) for j, v in enumerate(x)], "j long, x double")


def rank_and_condition(a: DataFrame, columns: int, tolerance: float = 1e-7) -> DataFrame:
    """rank, condition (infinity below full rank), nuclear and spectral norm: one row."""
    s = svd(a, columns, tolerance)[1]
    n = F.count("*")
    return s.agg(n.alias("rank"), F.when(n == columns, F.max("s") / F.min("s")).otherwise(float("inf")).alias("condition"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("nuclear"), F.coalesce(F.max("s"), F.lit(0.0)).alias("spectral"))
