"""Queries of descriptive statistics, tests, information measures and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import descriptive as D
from ..operators import finance, info, signal, stats
from ..sources.tables import SERIES_SQL, series, table
from .registry import query

X = "l_extendedprice"


@query("l_returnflag n", "mean var stddev median min_value max_value skewness kurtosis geometric_mean harmonic_mean rms", f"""
SELECT l_returnflag, count(*) AS n, avg(x) AS mean, var_samp(x) AS var, stddev_samp(x) AS stddev, median(x) AS median, min(x) AS min_value, max(x) AS max_value,
 avg(pow((x - m) / s, 3)) AS skewness, avg(pow((x - m) / s, 4)) - 3 AS kurtosis, exp(avg(ln(x))) AS geometric_mean, count(*) / sum(1 / x) AS harmonic_mean, sqrt(avg(x * x)) AS rms
FROM (SELECT l_returnflag, {X} AS x, avg({X}) OVER w AS m, stddev_samp({X}) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) GROUP BY l_returnflag""", 3)
def stats_summary(spark, d):
    x = F.col(X)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.count(x).alias("n"), D.mean(x).alias("mean"), D.var(x).alias("var"), D.stddev(x).alias("stddev"), D.median(x).alias("median"), F.min(x).alias("min_value"), F.max(x).alias("max_value"),
        D.skewness(x).alias("skewness"), D.kurtosis(x).alias("kurtosis"), D.geometric_mean(x).alias("geometric_mean"), D.harmonic_mean(x).alias("harmonic_mean"), D.rms(x).alias("rms"))


@query("l_returnflag", "p10 p50 p90", f"""SELECT l_returnflag, max(CASE WHEN rn = floor(0.1 * (n - 1)) + 1 THEN x END) AS p10, max(CASE WHEN rn = floor(0.5 * (n - 1)) + 1 THEN x END) AS p50,
 max(CASE WHEN rn = floor(0.9 * (n - 1)) + 1 THEN x END) AS p90 FROM (SELECT l_returnflag, {X} AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY {X}) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1""")
def stats_percentiles(spark, d):
    return stats.percentiles(table(spark, d, "lineitem"), X, ["l_returnflag"], [10, 50, 90])


@query("l_returnflag", "iqr", f"""SELECT l_returnflag, max(CASE WHEN rn = floor(0.75 * (n - 1)) + 1 THEN x END) - max(CASE WHEN rn = floor(0.25 * (n - 1)) + 1 THEN x END) AS iqr
 FROM (SELECT l_returnflag, {X} AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY {X}) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY 1""")
def stats_iqr(spark, d):
    return stats.iqr(table(spark, d, "lineitem"), X, ["l_returnflag"])


@query("l_returnflag", "trimmed_mean", f"""SELECT l_returnflag, avg(x) AS trimmed_mean FROM (SELECT l_returnflag, {X} AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY {X}) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
 WHERE rn > floor(0.1 * n) AND rn <= n - floor(0.1 * n) GROUP BY 1""", 4)
def stats_trimmed_mean(spark, d):
    return stats.trimmed_mean(table(spark, d, "lineitem"), X, ["l_returnflag"], 0.1)


@query("l_linestatus", "mad", f"""SELECT l_linestatus, median(abs(x - m)) * 1.4826 AS mad FROM (SELECT l_linestatus, {X} AS x, median({X}) OVER (PARTITION BY l_linestatus) AS m FROM lineitem) GROUP BY 1""", 4)
def stats_mad(spark, d):
    return stats.mad(table(spark, d, "lineitem"), X, ["l_linestatus"])


@query("l_returnflag", "mode", "SELECT l_returnflag, l_quantity AS mode FROM (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1")
def stats_mode(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(D.mode(F.col("l_quantity")).alias("mode"))


@query("l_returnflag", "weighted_mean weighted_variance weighted_correlation", """SELECT l_returnflag, mx AS weighted_mean, sxx / (s - ss / s) AS weighted_variance, sxy / sqrt(sxx * syy) AS weighted_correlation FROM (
 SELECT l_returnflag, sum(w) AS s, sum(w * w) AS ss, any_value(mx) AS mx, sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (y - my) * (y - my)) AS syy, sum(w * (x - mx) * (y - my)) AS sxy FROM (
 SELECT l_returnflag, l_tax AS x, l_discount AS y, l_quantity AS w, sum(l_tax * l_quantity) OVER g / sum(l_quantity) OVER g AS mx, sum(l_discount * l_quantity) OVER g / sum(l_quantity) OVER g AS my FROM lineitem WINDOW g AS (PARTITION BY l_returnflag)) GROUP BY 1)""", 9)
def stats_weighted(spark, d):
    x, y, w = F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(D.weighted_mean(x, w).alias("weighted_mean"), D.weighted_variance(x, w).alias("weighted_variance"), D.weighted_correlation(x, y, w).alias("weighted_correlation"))


@query("l_linestatus", "correlation partial_correlation", f"""SELECT l_linestatus, a AS correlation, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS partial_correlation FROM (SELECT l_linestatus, corr({X}, l_quantity) AS a, corr({X}, l_discount) AS b, corr(l_quantity, l_discount) AS c FROM lineitem GROUP BY 1)""", 9)
def stats_correlation(spark, d):
    x, y, z = F.col(X), F.col("l_quantity"), F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(D.correlation(x, y).alias("correlation"), D.partial_correlation(x, y, z).alias("partial_correlation"))


@query("", "spearman", "SELECT 1 - 6 * sum((a - b)::DOUBLE * (a - b)) / (count(*)::DOUBLE * (count(*) * count(*) - 1)) AS spearman FROM (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) AS a, row_number() OVER (ORDER BY p_size, p_partkey) AS b FROM part)", 9)
def stats_spearman(spark, d):
    return stats.spearman(table(spark, d, "part"), "p_retailprice", "p_size", "p_partkey")


@query("l_returnflag", "t", "SELECT l_returnflag, (avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))) AS t FROM lineitem GROUP BY 1")
def stats_ttest(spark, d):
    return stats.ttest(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"], 25.0)


@query("", "t", f"SELECT (avg(a) - avg(b)) / sqrt(var_samp(a) / count(a) + var_samp(b) / count(b)) AS t FROM (SELECT CASE WHEN l_returnflag = 'A' THEN {X} END AS a, CASE WHEN l_returnflag = 'R' THEN {X} END AS b FROM lineitem)")
def stats_welch_ttest(spark, d):
    return stats.welch_ttest(table(spark, d, "lineitem"), X, "l_returnflag", "A", "R")


@query("l_returnflag", "z", "SELECT l_returnflag, (avg(l_quantity) - 25) / (14.0 / sqrt(count(*))) AS z FROM lineitem GROUP BY 1")
def stats_ztest(spark, d):
    return stats.ztest(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"], 25.0, 14.0)


@query("", "chi2", "SELECT sum((n - e) * (n - e) / e) AS chi2 FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER () / count(*) OVER () AS e FROM lineitem GROUP BY l_quantity)")
def stats_chi2_uniform(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_quantity").agg(F.count("*").cast("double").alias("o"))
    total = counts.agg((F.sum("o") / F.count("*")).alias("e"))
    return stats.chi2_gof(counts.join(F.broadcast(total), F.lit(True)), "o", "e")


ANOVA = "SELECT (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f, count(*) - 1 AS df_between, sum(n)::BIGINT - count(*) AS df_within FROM (SELECT n, m, v, sum(n * m) OVER () / sum(n) OVER () AS gm FROM (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM ({rows}) GROUP BY g))"


@query("df_between df_within", "f", ANOVA.format(rows=f"SELECT l_returnflag AS g, {X} AS x FROM lineitem"))
def stats_anova(spark, d):
    return stats.one_way_anova(table(spark, d, "lineitem"), X, "l_returnflag")


@query("df_between df_within", "w", ANOVA.format(rows=f"SELECT l_returnflag AS g, abs({X} - median({X}) OVER (PARTITION BY l_returnflag)) AS x FROM lineitem").replace("AS f,", "AS w,"))
def stats_levene(spark, d):
    return stats.levene_test(table(spark, d, "lineitem"), X, "l_returnflag")


@query("df", "statistic", f"SELECT (nk * ln(p) - sl) / (1 + (si - 1 / nk) / (3 * df)) AS statistic, df FROM (SELECT sum(n - 1)::DOUBLE AS nk, sum((n - 1) * v) / sum(n - 1) AS p, sum((n - 1) * ln(v)) AS sl, sum(1.0 / (n - 1)) AS si, count(*) - 1 AS df FROM (SELECT count(*) AS n, var_samp({X}) AS v FROM lineitem GROUP BY l_returnflag))")
def stats_bartlett(spark, d):
    return stats.bartlett_test(table(spark, d, "lineitem"), X, "l_returnflag")


RANKS = "SELECT a.g, (b.hi - (b.c - 1) / 2.0)::DOUBLE AS r, b.c::DOUBLE AS c FROM ({rows}) a JOIN (SELECT x, c, sum(c) OVER (ORDER BY x) AS hi FROM (SELECT x, count(*) AS c FROM ({rows}) GROUP BY x)) b ON a.x = b.x"


@query("n1 n2", "u", "SELECT sum(CASE WHEN g = 'A' THEN r END) - count_if(g = 'A') * (count_if(g = 'A') + 1) / 2.0 AS u, count_if(g = 'A')::BIGINT AS n1, count_if(g = 'R')::BIGINT AS n2 FROM (" + RANKS.format(rows="SELECT l_returnflag AS g, l_quantity AS x FROM lineitem WHERE l_returnflag IN ('A', 'R')") + ")", 1)
def stats_mann_whitney(spark, d):
    return stats.mann_whitney_u(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", "A", "R")


@query("df", "h", "SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, df FROM (SELECT sum(n) AS n, sum(r * r / n) AS s, sum(t) AS t, count(*) - 1 AS df FROM (SELECT count(*)::DOUBLE AS n, sum(r) AS r, sum(c * c - 1) AS t FROM (" + RANKS.format(rows="SELECT l_returnflag AS g, l_quantity AS x FROM lineitem") + ") GROUP BY g))", 5)
def stats_kruskal_wallis(spark, d):
    return stats.kruskal_wallis(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


@query("l_returnflag", "jb", "SELECT l_returnflag, count(*) / 6.0 * (pow(avg(pow(z, 3)), 2) + pow(avg(pow(z, 4)) - 3, 2) / 4) AS jb FROM (SELECT l_returnflag, (l_quantity - avg(l_quantity) OVER w) / stddev_samp(l_quantity) OVER w AS z FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) GROUP BY 1", 5)
def stats_jarque_bera(spark, d):
    return stats.jarque_bera(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])


@query("l_returnflag", "slope intercept r2", f"SELECT l_returnflag, regr_slope({X}, l_quantity) AS slope, regr_intercept({X}, l_quantity) AS intercept, regr_r2({X}, l_quantity) AS r2 FROM lineitem GROUP BY 1", 4)
def stats_linear_regression(spark, d):
    return stats.linear_regression(table(spark, d, "lineitem"), "l_quantity", X, ["l_returnflag"])


@query("name", "coefficient", f"""WITH s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_ FROM (SELECT l_quantity AS a, l_discount AS b, {X} AS y FROM lineitem))
 SELECT 'l_quantity' AS name, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS coefficient FROM s UNION ALL SELECT 'l_discount', (by_ * aa - ay * ab) / (aa * bb - ab * ab) FROM s""", 3)
def stats_multiple_regression(spark, d):
    return stats.multiple_regression(table(spark, d, "lineitem"), ["l_quantity", "l_discount"], X)


@query("g lag", "acf", f"""WITH s AS ({SERIES_SQL}), c AS (SELECT g, idx, v - avg(v) OVER (PARTITION BY g) AS x FROM s), z AS (SELECT g, sum(x * x) AS z FROM c GROUP BY g)
 SELECT g, k AS lag, CASE WHEN z > 0 THEN coalesce(p, 0) / z ELSE 0 END AS acf FROM z, (SELECT unnest(range(4))::INT AS k) LEFT JOIN (SELECT a.g AS g2, (a.idx - b.idx)::INT AS k2, sum(a.x * b.x) AS p FROM c a JOIN c b ON a.g = b.g AND a.idx - b.idx BETWEEN 0 AND 3 GROUP BY 1, 2) ON g2 = g AND k2 = k""", 8)
def stats_acf(spark, d):
    return stats.acf(series(spark, d), 3)


@query("point", "density", "SELECT point, sum(CASE WHEN abs(x - point) <= 2000 THEN 0.75 * (1 - pow((x - point) / 2000.0, 2)) ELSE 0 END) / (count(*) * 2000.0) AS density FROM (SELECT p_retailprice AS x FROM part), (SELECT unnest(range(0, 4001, 250))::DOUBLE AS point) GROUP BY point", 12)
def stats_kde(spark, d):
    grid = spark.range(0, 4001, 250).select(F.col("id").cast("double").alias("point"))
    return stats.kde(table(spark, d, "part"), "p_retailprice", grid, "point", 2000.0)


@query("", "joint_entropy conditional_entropy mutual_info", """WITH n AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) / sum(count(*)) OVER () AS p FROM lineitem GROUP BY 1, 2),
 h AS (SELECT (SELECT -sum(p * log2(p)) FROM n) AS xy, (SELECT -sum(p * log2(p)) FROM (SELECT sum(p) AS p FROM n GROUP BY x)) AS x, (SELECT -sum(p * log2(p)) FROM (SELECT sum(p) AS p FROM n GROUP BY y)) AS y)
 SELECT xy AS joint_entropy, xy - x AS conditional_entropy, x + y - xy AS mutual_info FROM h""", 9)
def info_joint(spark, d):
    return info.joint_measures(info.distribution(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")


@query("", "entropy normalized redundancy renyi2 tsallis2", "SELECT -sum(p * log2(p)) AS entropy, -sum(p * log2(p)) / log2(count(*)) AS normalized, 1 + sum(p * log2(p)) / log2(count(*)) AS redundancy, -log2(sum(p * p)) AS renyi2, 1 - sum(p * p) AS tsallis2 FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type)", 9)
def info_entropies(spark, d):
    return info.entropies(info.distribution(table(spark, d, "events"), "event_type"))


@query("", "cross_entropy kl js hellinger tv", """WITH a AS (SELECT l_quantity AS k, count(*) / sum(count(*)) OVER () AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_quantity AS k, count(*) / sum(count(*)) OVER () AS b FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
 j AS (SELECT coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (k))
 SELECT -sum(CASE WHEN a > 0 AND b > 0 THEN a * log2(b) END) AS cross_entropy, sum(CASE WHEN a > 0 AND b > 0 THEN a * log2(a / b) END) AS kl, (sum(CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0 END) + sum(CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0 END)) / 2 AS js,
 sqrt(sum(pow(sqrt(a) - sqrt(b), 2)) / 2) AS hellinger, sum(abs(a - b)) / 2 AS tv FROM j""", 9)
def info_divergences(spark, d):
    lines = table(spark, d, "lineitem")
    return info.divergences(*(info.distribution(lines.where(F.col("l_returnflag") == k), "l_quantity") for k in ("A", "N")), "l_quantity")


@query("g", "entropy", f"""WITH s AS ({SERIES_SQL}), w AS (SELECT g, v AS a, lead(v) OVER o AS b, lead(v, 2) OVER o AS c FROM s WINDOW o AS (PARTITION BY g ORDER BY idx)),
 p AS (SELECT g, CASE WHEN a <= b AND b <= c THEN 1 WHEN a <= c AND c < b THEN 2 WHEN b < a AND a <= c THEN 3 WHEN c < a AND a <= b THEN 4 WHEN b <= c AND c < a THEN 5 ELSE 6 END AS k FROM w WHERE c IS NOT NULL),
 q AS (SELECT g, count(*) / sum(count(*)) OVER (PARTITION BY g) AS p FROM p GROUP BY g, k) SELECT g, -sum(p * log2(p)) AS entropy FROM q GROUP BY g""", 8)
def info_permutation_entropy(spark, d):
    return info.permutation_entropy(series(spark, d), 3)


@query("g idx", "v", f"SELECT g, idx, avg(v) OVER (PARTITION BY g ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM ({SERIES_SQL})")
def signal_moving_average(spark, d):
    return signal.moving_average(series(spark, d), 5)


@query("g idx", "v", f"SELECT g, idx, CASE WHEN idx >= 2 AND idx + 2 < n THEN m ELSE v END AS v FROM (SELECT g, idx, v, median(v) OVER (PARTITION BY g ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m, count(*) OVER (PARTITION BY g) AS n FROM ({SERIES_SQL}))")
def signal_median_filter(spark, d):
    return signal.median_filter(series(spark, d), 5)


@query("g idx", "v", f"SELECT g, idx, CASE WHEN idx >= 2 AND idx + 2 < n THEN (-3 * a + 12 * b + 17 * v + 12 * c - 3 * e) / 35.0 ELSE v END AS v FROM (SELECT g, idx, v, lag(v, 2) OVER o AS a, lag(v) OVER o AS b, lead(v) OVER o AS c, lead(v, 2) OVER o AS e, count(*) OVER (PARTITION BY g) AS n FROM ({SERIES_SQL}) WINDOW o AS (PARTITION BY g ORDER BY idx))")
def signal_savgol(spark, d):
    return signal.savgol(series(spark, d), 5, 2)


@query("g idx", "v", f"SELECT g, idx, v - coalesce(lag(v) OVER (PARTITION BY g ORDER BY idx), 0) AS v FROM ({SERIES_SQL})")
def signal_delta_encode(spark, d):
    return signal.delta_encode(series(spark, d))


@query("g idx", "v", SERIES_SQL, 4)
def signal_delta_round_trip(spark, d):
    return signal.delta_decode(signal.delta_encode(series(spark, d)))


@query("g first_idx n", "v", f"""WITH s AS (SELECT g, idx, (v::BIGINT % 3)::DOUBLE AS v FROM (SELECT g, idx, floor(v) AS v FROM ({SERIES_SQL}))), r AS (SELECT g, idx, v, idx - row_number() OVER (PARTITION BY g, v ORDER BY idx) AS k FROM s) SELECT g, min(idx) AS first_idx, v, count(*) AS n FROM r GROUP BY g, v, k""")
def signal_run_lengths(spark, d):
    return signal.run_lengths(series(spark, d).withColumn("v", (F.floor("v") % 3).cast("double")))


@query("g idx", "v", f"SELECT g, idx // 3 AS idx, v FROM ({SERIES_SQL}) WHERE idx % 3 = 0")
def signal_downsample(spark, d):
    return signal.downsample(series(spark, d), 3)


@query("g idx", "v", f"SELECT g, idx * 2 + k AS idx, CASE WHEN k = 0 THEN v ELSE 0 END AS v FROM ({SERIES_SQL}), (SELECT unnest(range(2)) AS k)")
def signal_upsample(spark, d):
    return signal.upsample(series(spark, d), 2)


@query("g lag", "v", f"WITH s AS ({SERIES_SQL}) SELECT a.g, (b.idx - a.idx)::INT AS lag, sum(a.v * b.v) AS v FROM s a JOIN s b ON a.g = b.g AND b.idx - a.idx BETWEEN -2 AND 2 GROUP BY 1, 2", 5)
def signal_autocorr(spark, d):
    s = series(spark, d)
    return signal.xcorr(s, s, 2)


@query("g idx", "v", f"SELECT g, idx + j AS idx, sum(v * k) AS v FROM ({SERIES_SQL}), (VALUES (0, 0.25), (1, 0.5), (2, 0.25)) t(j, k) GROUP BY 1, 2")
def signal_convolve(spark, d):
    return signal.convolve(series(spark, d), signal.binomial_kernel(2))


@query("g idx", "v", f"""WITH s AS (SELECT g, idx, sin(v) * 3 AS v FROM ({SERIES_SQL})), t AS (SELECT g, idx, v, coalesce(CASE WHEN abs(v - lag(v) OVER o) > pi() THEN -2 * pi() * round((v - lag(v) OVER o) / (2 * pi())) ELSE 0 END, 0) AS t FROM s WINDOW o AS (PARTITION BY g ORDER BY idx)) SELECT g, idx, v + sum(t) OVER (PARTITION BY g ORDER BY idx) AS v FROM t""")
def signal_unwrap(spark, d):
    return signal.unwrap(series(spark, d).withColumn("v", F.sin("v") * 3))


@query("g", "drawdown", f"SELECT g, max((p - v) / p) AS drawdown FROM (SELECT g, v, max(v) OVER (PARTITION BY g ORDER BY idx) AS p FROM ({SERIES_SQL}) WHERE v > 0) GROUP BY g", 9)
def finance_max_drawdown(spark, d):
    return signal.max_drawdown(series(spark, d))


RETURNS_SQL = f"SELECT g, idx, r FROM (SELECT g, idx, v / nullif(lag(v) OVER (PARTITION BY g ORDER BY idx), 0) - 1 AS r FROM ({SERIES_SQL})) WHERE r IS NOT NULL"


@query("g", "sharpe", f"SELECT g, CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) ELSE 0 END AS sharpe FROM ({RETURNS_SQL}) GROUP BY g")
def finance_sharpe(spark, d):
    return finance.sharpe(finance.returns(series(spark, d)))


@query("g", "sortino", f"SELECT g, coalesce(avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 1e9) AS sortino FROM ({RETURNS_SQL}) GROUP BY g", 5)
def finance_sortino(spark, d):
    return finance.sortino(finance.returns(series(spark, d)))


@query("l_returnflag", "var", "SELECT l_returnflag, -x AS var FROM (SELECT l_returnflag, l_discount - l_tax AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_discount - l_tax) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE rn = floor(round(0.05 * n, 9)) + 1")
def finance_historical_var(spark, d):
    return finance.historical_var(table(spark, d, "lineitem").withColumn("x", F.col("l_discount") - F.col("l_tax")), "x", ["l_returnflag"], 0.95)


@query("o_custkey", "npv", "SELECT o_custkey, sum(o_totalprice / pow(1.05, t)) AS npv FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t FROM orders) GROUP BY 1", 3)
def finance_npv(spark, d):
    from pyspark.sql import Window as W

    t = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return finance.npv(table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("cash"), t.alias("t")), 0.05, ["o_custkey"])


@query("p_partkey", "payment price", "SELECT p_partkey, p_retailprice * 0.01 / (1 - pow(1.01, -12)) AS payment, 100 * 0.03 * (1 - pow(1.04, -p_size)) / 0.04 + 100 * pow(1.04, -p_size) AS price FROM part")
def finance_annuity_and_bond(spark, d):
    one = F.lit
    return table(spark, d, "part").select("p_partkey", finance.annuity_payment(F.col("p_retailprice"), one(0.01), one(12)).alias("payment"), finance.bond_price(one(100.0), one(0.03), one(0.04), F.col("p_size")).alias("price"))



def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    u = f"(exp(-{x} * {x} / 2) / 2.5066282746310002 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {u} ELSE {u} END)"


@query("p_partkey", "call put", f"SELECT p_partkey, c AS call, c - s + 1000 * exp(-0.05) AS put FROM (SELECT *, s * {_cdf('d1')} - 1000 * exp(-0.05) * {_cdf('d2')} AS c FROM (SELECT *, d1 - 0.2 AS d2 FROM (SELECT p_partkey, p_retailprice AS s, (ln(p_retailprice / 1000) + 0.07) / 0.2 AS d1 FROM part)))", 5)
def finance_black_scholes(spark, d):
    args = (F.col("p_retailprice"), F.lit(1000.0), F.lit(1.0), F.lit(0.05), F.lit(0.2))
    return table(spark, d, "part").select("p_partkey", finance.black_scholes(*args).alias("call"), finance.black_scholes(*args, call=False).alias("put"))
