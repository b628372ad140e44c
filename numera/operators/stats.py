"""Statistics that need more than one aggregate: order statistics, ranks, tests and regressions.

x, g and so on are column names; by is a list of grouping columns. Nulls in the values are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import descriptive as D
from .running import running_sums, written


def _counted(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    return df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_c"))


def _ranked(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Rows with _rn (from 1) in ascending order and _n of their group. Ranks come from value counts, so that a value
    that many rows share costs one row, and no row is collected."""
    return _ranked_counts(_counted(df, x, by), x, by)


def _ranked_counts(counts: DataFrame, x: str, by: list[str]) -> DataFrame:
    sums = running_sums(counts, by, [F.col(x)], {"_hi": "_c"})
    groups = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if not by:
        return sums.crossJoin(F.broadcast(groups))  # one row
    same = reduce(lambda a, b: a & b, [sums[c].eqNullSafe(groups[c]) for c in by])
    return sums.join(groups, same).select(sums["*"], "_n")


def percentiles(df: DataFrame, x: str, by: list[str], ps: list[float]) -> DataFrame:
    """by, and p<p> for each p: the value at place floor(p/100 (n-1)), counted from 0."""
    at = lambda p: F.floor(F.lit(p / 100) * (F.col("_n") - 1)) + 1
    inside = lambda p: (F.col("_hi") >= at(p)) & (F.col("_hi") - F.col("_c") < at(p))
    return _ranked(df, x, by).groupBy(*by).agg(*(F.min(F.when(inside(p), F.col(x))).alias(f"p{p:g}") for p in ps))


def iqr(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Difference of the lower-index quartiles; fewer than 4 values: 0."""
    n = df.groupBy(*by).agg(F.count(x).alias("_m"))
    return percentiles(df, x, by, [25, 75]).join(n, by).select(*by, F.when(F.col("_m") < 4, 0.0).otherwise(F.col("p75") - F.col("p25")).alias("iqr"))


def trimmed_mean(df: DataFrame, x: str, by: list[str], share: float) -> DataFrame:
    """Mean without the floor(share n) smallest and largest values; the median where nothing would be left."""
    r = _ranked(df, x, by).withColumn("_t", F.floor(F.lit(share) * F.col("_n")))
    lo, hi = F.col("_hi") - F.col("_c"), F.col("_hi")
    kept = F.greatest(F.lit(0), F.least(hi, F.col("_n") - F.col("_t")) - F.greatest(lo, F.col("_t")))
    mid = lambda k: F.min(F.when((hi >= k) & (lo < k), F.col(x)))
    median = (mid(F.floor((F.col("_n") + 1) / 2)) + mid(F.floor(F.col("_n") / 2) + 1)) / 2
    return r.withColumn("_k", kept).groupBy(*by).agg(F.when(F.sum("_k") > 0, F.sum(F.col("_k") * F.col(x)) / F.nullif(F.sum("_k"), F.lit(0))).otherwise(median).alias("trimmed_mean"))


def _medians(counts: DataFrame, x: str, by: list[str]) -> DataFrame:
    """by, _med of values with their counts _c: no task holds a group."""
    lo, hi = F.col("_hi") - F.col("_c"), F.col("_hi")
    mid = lambda k: F.min(F.when((hi >= k) & (lo < k), F.col(x)))
    median = mid(F.floor((F.col("_n") + 1) / 2)) * 0.5 + mid(F.floor(F.col("_n") / 2) + 1) * 0.5
    return _ranked_counts(counts, x, by).groupBy(*by).agg(median.alias("_med"))


def mad(df: DataFrame, x: str, by: list[str], scale: float = 1.4826) -> DataFrame:
    """Median absolute deviation from the median. A group without values: null; a null is no group."""
    rows = df.select(*by, F.col(x).cast("double").alias("_x")).dropna(subset=by) if by else df.select(F.col(x).cast("double").alias("_x"))
    counts = written(_counted(rows, "_x", by))
    m = F.broadcast(_medians(counts, "_x", by)) if not by else _medians(counts, "_x", by)
    away = (counts.join(m, by) if by else counts.join(m)).withColumn("_x", F.abs(F.col("_x") - F.col("_med")))
    found = _medians(away.groupBy(*by, "_x").agg(F.sum("_c").alias("_c")), "_x", by)
    groups = rows.select(*by).distinct().join(found, by, "left") if by else found
    return groups.select(*by, (F.col("_med") * scale).alias("mad"))


def average_ranks(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    """df with _rank (equal values share their mean rank) and _ties (rows of equal value). Rows with a null in x or a group
    are left out."""
    by = by or []
    counts = df.dropna(subset=[*by, x]).groupBy(*by, x).agg(F.count("*").alias("_ties"))
    ranks = running_sums(counts, by, [F.col(x)], {"_upto": "_ties"}).withColumn("_rank", F.col("_upto") - (F.col("_ties") - 1) / 2).drop("_upto")
    return df.join(ranks, [*by, x])


def spearman(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """From ordinal ranks; equal values are ordered by key, which tells rows apart. Rows with a null in x or y are left out."""
    r = df.dropna(subset=[x, y]).select(x, y, key, F.lit(1).cast("long").alias("_one"))
    for c, rank in ((x, "_rx"), (y, "_ry")):
        r = running_sums(r, [], [F.col(c), F.col(key)], {rank: "_one"})
    r = r.select((F.col("_rx") - F.col("_ry")).alias("d"))
    n = F.count("*")
    return r.agg((1 - 6 * F.sum(F.col("d").cast("double") * F.col("d")) / (n.cast("double") * (n * n - 1))).alias("spearman"))


def ttest(df: DataFrame, x: str, by: list[str], mu: float) -> DataFrame:
    """The statistic of one sample against mu; no spread: 0."""
    x_ = F.col(x)
    se = D.stddev(x_) / F.sqrt(F.count(x_))
    return df.groupBy(*by).agg(F.when(se > 0, (F.avg(x_) - mu) / se).otherwise(0.0).alias("t"))


def welch_ttest(df: DataFrame, x: str, g: str, a, b) -> DataFrame:
    part = lambda v: F.when(F.col(g) == v, F.col(x))
    se = F.sqrt(F.var_samp(part(a)) / F.count(part(a)) + F.var_samp(part(b)) / F.count(part(b)))
    return df.agg(((F.avg(part(a)) - F.avg(part(b))) / se).alias("t"))


def ztest(df: DataFrame, x: str, by: list[str], mu: float, sigma: float) -> DataFrame:
    return df.groupBy(*by).agg(((F.avg(x) - mu) / (sigma / F.sqrt(F.count(x)))).alias("z"))


def chi2_gof(df: DataFrame, observed: str, expected: str) -> DataFrame:
    o, e = F.col(observed), F.col(expected)
    return df.agg(F.sum(F.when(e > 0, (o - e) * (o - e) / e)).alias("chi2"))


def one_way_anova(df: DataFrame, x: str, g: str) -> DataFrame:
    """f, df_between, df_within."""
    per = df.groupBy(g).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("v"))
    n, k = F.sum("n"), F.count("*")
    grand = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    within = F.sum((F.col("n") - 1) * F.col("v"))
    return per.agg(((between / (k - 1)) / (within / (n - k))).alias("f"), (k - 1).alias("df_between"), (n - k).alias("df_within"))


def levene_test(df: DataFrame, x: str, g: str) -> DataFrame:
    """Centred by group medians."""
    m = _medians(_counted(df.select(g, F.col(x).cast("double").alias(x)).dropna(subset=[g]), x, [g]), x, [g])
    return one_way_anova(df.dropna(subset=[g]).join(m, g, "left").select(g, F.abs(F.col(x) - F.col("_med")).alias("d")), "d", g).withColumnRenamed("f", "w")


def bartlett_test(df: DataFrame, x: str, g: str) -> DataFrame:
    per = df.groupBy(g).agg(F.count(x).alias("n"), F.var_samp(x).alias("v")).where("n > 1")
    d = F.col("n") - 1
    k, nk = F.count("*"), F.sum(d)
    pooled = F.sum(d * F.col("v")) / nk
    stat = (nk * F.ln(pooled) - F.sum(d * F.ln("v"))) / (1 + (F.sum(1 / d) - 1 / nk) / (3 * (k - 1)))
    return per.agg(stat.alias("statistic"), (k - 1).alias("df"))


def mann_whitney_u(df: DataFrame, x: str, g: str, a, b) -> DataFrame:
    """u of the first group."""
    r = average_ranks(df.where(F.col(g).isin(a, b)), x)
    n1 = F.count_if(F.col(g) == a)
    return r.agg((F.sum(F.when(F.col(g) == a, F.col("_rank"))) - n1 * (n1 + 1) / 2).alias("u"), n1.alias("n1"), F.count_if(F.col(g) == b).alias("n2"))


def kruskal_wallis(df: DataFrame, x: str, g: str) -> DataFrame:
    """h, corrected for ties, and df."""
    r = average_ranks(df.where(F.col(x).isNotNull()), x)
    per = r.groupBy(g).agg(F.count("*").cast("double").alias("n"), F.sum("_rank").alias("r"), F.sum(F.col("_ties").cast("double") * F.col("_ties") - 1).alias("t"))
    n = F.sum("n")
    h = 12 / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    return per.agg((h / (1 - F.sum("t") / (n * n * n - n))).alias("h"), (F.count("*") - 1).alias("df"))


def jarque_bera(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    s, k, n = D.skewness(F.col(x)), D.kurtosis(F.col(x)), F.count(x)
    return df.groupBy(*by).agg((n / 6 * (s * s + k * k / 4)).alias("jb"))


def linear_regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """slope, intercept, r2; no spread in x: zeros."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy(*by).agg(zero(F.regr_slope(y, x)).alias("slope"), zero(F.regr_intercept(y, x)).alias("intercept"), zero(F.regr_r2(y, x)).alias("r2"))


def gram(df: DataFrame, columns: list[str]):
    """All sums of products of two columns, as a symmetric numpy array: one aggregate over the rows without a null in any
    of the columns, so that all sums are over the same rows."""
    import numpy as np

    df = df.dropna(subset=list(dict.fromkeys(columns)))

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs))).first()
    out = np.zeros((len(columns), len(columns)))
    for k, (a, b) in enumerate(pairs):
        out[columns.index(a), columns.index(b)] = out[columns.index(b), columns.index(a)] = row[k] or 0.0
    return out


def multiple_regression(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Least squares without an intercept: name, coefficient."""
    import numpy as np

    g = gram(df, [*xs, y])
    beta = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
    return df.sparkSession.createDataFrame([(n, float(b)) for n, b in zip(xs, beta)], "name string, coefficient double")


def acf(series: DataFrame, max_lag: int, g: str = "g", idx: str = "idx", v: str = "v") -> DataFrame:
    """g, lag, acf: one shared denominator; no spread gives 0."""
    w, o = W.partitionBy(g), W.partitionBy(g).orderBy(idx)
    d = series.select(g, idx, (F.col(v) - F.avg(v).over(w)).alias("d"))
    lags = d.select(g, "d", *(F.lag("d", k).over(o).alias(f"l{k}") for k in range(1, max_lag + 1)))
    sums = lags.groupBy(g).agg(F.sum(F.col("d") * F.col("d")).alias("s0"), *(F.coalesce(F.sum(F.col("d") * F.col(f"l{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, max_lag + 1)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.when(F.col("s0") > 0, F.col(f"s{k}") / F.col("s0")).otherwise(0.0).alias("acf")) for k in range(max_lag + 1))))
    return sums.select(g, each.alias("x")).select(g, "x.lag", "x.acf")


def ljung_box(series: DataFrame, max_lag: int, g: str = "g", idx: str = "idx", v: str = "v") -> DataFrame:
    n = series.groupBy(g).agg(F.count("*").alias("n")).where(F.col("n") > max_lag)
    return acf(series, max_lag, g, idx, v).where("lag > 0").join(n, g).groupBy(g).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q"))


def kde(samples: DataFrame, x: str, grid: DataFrame, at: str, bandwidth: float) -> DataFrame:
    """at, density: Epanechnikov kernel. Samples meet grid points by buckets one bandwidth wide, so no pair farther than two buckets is made."""
    bucket = lambda c: F.floor(F.col(c) / bandwidth)
    n = samples.count()
    # equal samples count once, with their number
    s = samples.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.count("*").alias("_c")).withColumn("_b", bucket("_x"))
    near = grid.select(F.col(at)).withColumn("_b", F.explode(F.array(bucket(at) - 1, bucket(at), bucket(at) + 1)))
    u = (F.col("_x") - F.col(at)) / bandwidth
    hit = near.join(s, "_b").where(F.abs(u) <= 1).groupBy(at).agg((F.sum(0.75 * (1 - u * u) * F.col("_c")) / (max(n, 1) * bandwidth)).alias("_d"))
    return grid.join(hit, at, "left").select(at, F.coalesce("_d", F.lit(0.0)).alias("density"))
