"""Queries over spectra by segments, and over tests of fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fit, spectra
from ..sources.tables import SERIES_SQL, series, table
from .registry import query

# segments of 12 points, half overlapping, padded to 16
SEGMENTS = f"""s AS (SELECT g, idx, v, v * (idx % 3) AS u FROM ({SERIES_SQL})), c AS (SELECT g, count(*) AS n FROM s GROUP BY g), m AS (SELECT g, unnest(range((n - 12) // 6 + 1)) AS m FROM c WHERE n >= 12),
 p AS (SELECT m.g, m.m, idx - 6 * m AS t, v * (0.5 - 0.5 * cos(2 * pi() * (idx - 6 * m) / 11)) AS v, u * (0.5 - 0.5 * cos(2 * pi() * (idx - 6 * m) / 11)) AS u FROM m JOIN s ON m.g = s.g AND idx BETWEEN 6 * m AND 6 * m + 11),
 x AS (SELECT g, m, k, sum(v * cos(2 * pi() * k * t / 16)) AS a, -sum(v * sin(2 * pi() * k * t / 16)) AS b, sum(u * cos(2 * pi() * k * t / 16)) AS c, -sum(u * sin(2 * pi() * k * t / 16)) AS d FROM p, (SELECT unnest(range(9)) AS k) GROUP BY 1, 2, 3),
 e AS (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * t / 11), 2)) AS e FROM (SELECT unnest(range(12)) AS t))"""


@query("g k", "frequency psd", f"WITH {SEGMENTS} SELECT g, k, k * 2 / 16.0 AS frequency, avg(a * a + b * b) / (2 * any_value(e)) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END AS psd FROM x, e GROUP BY g, k", 4)
def spectra_welch(spark, d):
    return spectra.welch_psd(series(spark, d), 2.0, 12)


@query("g segment k", "time frequency magnitude", f"WITH {SEGMENTS} SELECT g, m AS segment, k, (6 * m + 6) / 2.0 AS time, k * 2 / 16.0 AS frequency, sqrt(a * a + b * b) AS magnitude FROM x", 4)
def spectra_spectrogram(spark, d):
    return spectra.spectrogram(series(spark, d), 2.0, 12)


@query("g k", "frequency coherence", f"WITH {SEGMENTS} SELECT g, k, k * 2 / 16.0 AS frequency, least(1, (pow(sum(a * c + b * d), 2) + pow(sum(b * c - a * d), 2)) / (sum(a * a + b * b) * sum(c * c + d * d))) AS coherence FROM x GROUP BY g, k")
def spectra_coherence(spark, d):
    return spectra.coherence(series(spark, d).withColumn("u", F.col("v") * (F.col("idx") % 3)), "v", "u", 2.0, 12)


@query("", "d", """WITH p AS (SELECT p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice) AS i, count(*) OVER () AS n FROM part), c AS (SELECT x, min(i) - 1 AS lo, max(i) AS hi, any_value(n) AS n FROM p GROUP BY x)
 SELECT max(greatest(hi / n - 1 / (1 + exp(-(x - 1300) / 150)), 1 / (1 + exp(-(x - 1300) / 150)) - lo / n)) AS d FROM c""", 8)
def stats_ks_test(spark, d):
    return fit.ks_test(table(spark, d, "part"), "p_retailprice", lambda x: 1 / (1 + F.exp(-(x - 1300) / 150)))


@query("g lag", "pacf", f"""WITH s AS ({SERIES_SQL}), z AS (SELECT g, idx, v - avg(v) OVER (PARTITION BY g) AS d FROM s), l AS (SELECT g, d, lag(d, 1) OVER w AS l1, lag(d, 2) OVER w AS l2 FROM z WINDOW w AS (PARTITION BY g ORDER BY idx)),
 r AS (SELECT g, sum(d * l1) / sum(d * d) AS r1, sum(d * l2) / sum(d * d) AS r2 FROM l GROUP BY g), o AS (SELECT unnest([0, 1, 2]) AS lag)
 SELECT g, lag, CASE lag WHEN 0 THEN 1 WHEN 1 THEN r1 ELSE (r2 - r1 * r1) / (1 - r1 * r1) END AS pacf FROM r, o""")
def stats_pacf(spark, d):
    return fit.pacf(series(spark, d), 2)


@query("name", "vif", """WITH s AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem))
 SELECT 'l_quantity' AS name, (xx - sx * sx / n) / (xx - xy * xy / yy) AS vif FROM s UNION ALL SELECT 'l_extendedprice', (yy - sy * sy / n) / (yy - xy * xy / xx) FROM s""", 5)
def stats_vif(spark, d):
    return fit.vif(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])


@query("n", "w_plus w_minus", """WITH d AS (SELECT l_discount::DOUBLE * 100 - l_tax::DOUBLE * 100 AS d FROM lineitem WHERE round(l_discount::DOUBLE * 100) <> round(l_tax::DOUBLE * 100)), r AS (SELECT round(d) AS d, rank() OVER (ORDER BY abs(round(d))) + (count(*) OVER (PARTITION BY abs(round(d))) - 1) / 2.0 AS r FROM d)
 SELECT count(*) AS n, coalesce(sum(CASE WHEN d > 0 THEN r END), 0) AS w_plus, coalesce(sum(CASE WHEN d < 0 THEN r END), 0) AS w_minus FROM r""", 2)
def stats_wilcoxon(spark, d):
    percent = lambda c: F.round(F.col(c).cast("double") * 100)
    return fit.wilcoxon_signed_rank(table(spark, d, "lineitem").select(percent("l_discount").alias("x"), percent("l_tax").alias("y")), "x", "y")
