"""Images as rows img, r, c, v: neighbourhoods are joins on shifted places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def from_vectors(df: DataFrame, img: str, vec: str, width: int) -> DataFrame:
    p = df.select(F.col(img).alias("img"), F.posexplode(vec).alias("p", "v"))
    return p.select("img", F.expr(f"p div {width}").cast("int").alias("r"), (F.col("p") % width).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def filter2(im: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """Correlation with a small odd kernel; outside the image values are 0."""
    h, w = len(kernel) // 2, len(kernel[0]) // 2
    taps = F.explode(F.array(*(F.struct(F.lit(i - h).alias("dr"), F.lit(j - w).alias("dc"), F.lit(float(k)).alias("k")) for i, row in enumerate(kernel) for j, k in enumerate(row) if k)))
    given = im.select("img", "r", "c", "v", taps.alias("t")).groupBy("img", (F.col("r") - F.col("t.dr")).alias("r"), (F.col("c") - F.col("t.dc")).alias("c")).agg(F.sum(F.col("v") * F.col("t.k")).alias("v"))
    return given.join(im.select("img", "r", "c"), ["img", "r", "c"], "left_semi")


def box_filter(im: DataFrame, size: int) -> DataFrame:
    """Mean over the part of the square that lies within the image."""
    ones = [[1.0] * size] * size
    total, n = filter2(im, ones), filter2(im.withColumn("v", F.lit(1.0)), ones).withColumnRenamed("v", "n")
    return total.join(n, ["img", "r", "c"]).select("img", "r", "c", (F.col("v") / F.col("n")).alias("v"))


def sobel(im: DataFrame) -> DataFrame:
    """Gradient magnitude."""
    x, y = filter2(im, [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]), filter2(im, [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]).withColumnRenamed("v", "w")
    return x.join(y, ["img", "r", "c"]).select("img", "r", "c", F.sqrt(F.col("v") * F.col("v") + F.col("w") * F.col("w")).alias("v"))


def threshold(im: DataFrame, limit: float) -> DataFrame:
    return im.withColumn("v", (F.col("v") > limit).cast("double"))


def histogram(im: DataFrame, bins: int, lo: float, hi: float) -> DataFrame:
    """img, bin, n; values outside go to the end bins."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / (hi - lo) * bins))).cast("int")
    return im.groupBy("img", b.alias("bin")).agg(F.count("*").alias("n"))


def integral(im: DataFrame) -> DataFrame:
    """Sums over all places above and left."""
    rows = im.withColumn("v", F.sum("v").over(W.partitionBy("img", "r").orderBy("c")))
    return rows.withColumn("v", F.sum("v").over(W.partitionBy("img", "c").orderBy("r")))


def rotate90(im: DataFrame) -> DataFrame:
    """Against the clock."""
    width = F.max("c").over(W.partitionBy("img"))
    return im.select("img", (width - F.col("c")).alias("r"), F.col("r").alias("c"), "v")


def max_pool(im: DataFrame, size: int) -> DataFrame:
    return im.groupBy("img", F.expr(f"r div {size}").alias("r"), F.expr(f"c div {size}").alias("c")).agg(F.max("v").alias("v"))
