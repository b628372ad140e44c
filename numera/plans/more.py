"""Queries over distributions, polynomials, images, dynamics and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import poly, prob, special
from ..operators import dynamics, image, stats
from ..sources.tables import SERIES_SQL, series, table
from ..streaming import windows
from .registry import query

Z = "((p_retailprice - 1300) / 300)"


@query("p_partkey", "n ln_ e ec eq u uc lo la ca we pa ra gu ge po", f"""SELECT p_partkey, exp(-{Z} * {Z} / 2) / 2.5066282746310002 AS n, exp(-pow((ln(p_retailprice) - 7) / 0.5, 2) / 2) / (0.5 * 2.5066282746310002) / p_retailprice AS ln_,
 0.1 * exp(-0.1 * p_size) AS e, 1 - exp(-0.1 * p_size) AS ec, -ln(1 - p_size / 100.0) / 2 AS eq, CASE WHEN p_size BETWEEN 10 AND 30 THEN 0.05 ELSE 0 END AS u, greatest(0.0, least(1.0, (p_size - 10) / 20.0)) AS uc,
 1 / (1 + exp(-{Z})) AS lo, CASE WHEN {Z} < 0 THEN exp({Z}) / 2 ELSE 1 - exp(-{Z}) / 2 END AS la, atan({Z}) / pi() + 0.5 AS ca, 1 - exp(-pow(p_size / 20.0, 1.5)) AS we, CASE WHEN p_size >= 5 THEN 1 - pow(5.0 / p_size, 2) ELSE 0 END AS pa,
 1 - exp(-p_size * p_size / 200.0) AS ra, exp(-exp(-{Z})) AS gu, 0.2 * pow(0.8, p_size - 1) AS ge, exp(p_size * ln(4.0::DOUBLE) - 4 - lgamma(p_size + 1)) AS po FROM part""", 8)
def prob_closed_forms(spark, d):
    x, k = F.col("p_retailprice"), F.col("p_size")
    z = (x - 1300) / 300
    return table(spark, d, "part").select(
        "p_partkey", prob.norm_pdf(z).alias("n"), prob.lognorm_pdf(x, 7.0, 0.5).alias("ln_"), prob.exp_pdf(k, 0.1).alias("e"), prob.exp_cdf(k, 0.1).alias("ec"), prob.exp_ppf(k / 100, 2.0).alias("eq"),
        prob.uniform_pdf(k, 10.0, 30.0).alias("u"), prob.uniform_cdf(k, 10.0, 30.0).alias("uc"), prob.logistic_cdf(z, 0.0, 1.0).alias("lo"), prob.laplace_cdf(z, 0.0, 1.0).alias("la"), prob.cauchy_cdf(z, 0.0, 1.0).alias("ca"),
        prob.weibull_cdf(k, 1.5, 20.0).alias("we"), prob.pareto_cdf(k, 5.0, 2.0).alias("pa"), prob.rayleigh_cdf(k, 10.0).alias("ra"), prob.gumbel_cdf(z, 0.0, 1.0).alias("gu"), prob.geometric_pmf(k, 0.2).alias("ge"), prob.poisson_pmf(k, 4.0).alias("po"))


@query("p_partkey", "g lg", "SELECT p_partkey, gamma(p_size / 10.0) AS g, lgamma(p_size / 10.0) AS lg FROM part")
def special_gamma(spark, d):
    x = F.col("p_size") / 10.0
    return table(spark, d, "part").select("p_partkey", special.gamma(x).alias("g"), special.lgamma(x).alias("lg"))


@query("p_partkey", "y dy iy", "SELECT p_partkey, 1 + x * (2 + x * (3 + 4 * x)) AS y, 2 + x * (6 + 12 * x) AS dy, x + x * x + x * x * x + pow(x, 4) AS iy FROM (SELECT p_partkey, p_size / 10.0 AS x FROM part)")
def poly_calculus(spark, d):
    c, x = F.array(*(F.lit(float(k)) for k in (1, 2, 3, 4))), F.col("p_size") / 10.0
    return table(spark, d, "part").select("p_partkey", poly.evaluate(c, x).alias("y"), poly.evaluate(poly.derivative(c), x).alias("dy"), poly.evaluate(poly.integral(c), x).alias("iy"))


@query("p_partkey", "s p", "SELECT p_partkey, (1 + 2 * x) + (3 - x * x) AS s, (1 + 2 * x) * (3 - x * x) AS p FROM (SELECT p_partkey, p_size / 10.0 AS x FROM part)")
def poly_algebra(spark, d):
    a, b, x = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(0.0), F.lit(-1.0)), F.col("p_size") / 10.0
    return table(spark, d, "part").select("p_partkey", poly.evaluate(poly.add(a, b), x).alias("s"), poly.evaluate(poly.multiply(a, b), x).alias("p"))


def _seconds(ts: str):
    """Of a time without a zone, which is taken as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _images(spark, d):
    return image.from_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


IMAGES = "SELECT vec_id AS img, (p // 8)::INT AS r, (p % 8)::INT AS c, embedding[p + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS p)"


@query("img r c", "v", f"WITH i AS ({IMAGES}) SELECT a.img, a.r, a.c, avg(b.v) AS v FROM i a JOIN i b ON a.img = b.img AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL")
def image_box_filter(spark, d):
    return image.box_filter(_images(spark, d), 3)


@query("img r c", "v", f"""WITH i AS ({IMAGES}) SELECT a.img, a.r, a.c, sqrt(pow(sum(b.v * (b.c - a.c) * (2 - abs(b.r - a.r))), 2) + pow(sum(b.v * (b.r - a.r) * (2 - abs(b.c - a.c))), 2)) AS v FROM i a JOIN i b ON a.img = b.img AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL""")
def image_sobel(spark, d):
    return image.sobel(_images(spark, d))


@query("img bin n", "", f"SELECT img, greatest(0, least(7, floor((v + 0.4) / 0.8 * 8)))::INT AS bin, count(*) AS n FROM ({IMAGES}) GROUP BY ALL")
def image_histogram(spark, d):
    return image.histogram(_images(spark, d), 8, -0.4, 0.4)


@query("img r c", "v", f"WITH i AS ({IMAGES}) SELECT a.img, a.r, a.c, sum(b.v) AS v FROM i a JOIN i b ON a.img = b.img AND b.r <= a.r AND b.c <= a.c GROUP BY ALL")
def image_integral(spark, d):
    return image.integral(_images(spark, d))


@query("img r c", "v", f"SELECT img, (r // 2)::BIGINT AS r, (c // 2)::BIGINT AS c, max(v) AS v FROM (SELECT img, 7 - c AS r, r AS c, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS v FROM ({IMAGES})) GROUP BY ALL")
def image_rotate_threshold_pool(spark, d):
    return image.max_pool(image.rotate90(image.threshold(_images(spark, d), 0.0)), 2)


@query("p_partkey", "e r", "SELECT p_partkey, p_size * pow(1 - 0.01, 100) AS e, p_size * pow(1 - 0.1 + 0.005 - 0.001 / 6 + 0.0001 / 24, 10) AS r FROM part")
def ode_decay(spark, d):
    f = lambda t, y: -y
    return table(spark, d, "part").select("p_partkey", dynamics.euler(f, 0.0, F.col("p_size"), 1.0, 100).alias("e"), dynamics.rk4(f, 0.0, F.col("p_size"), 1.0, 10).alias("r"))


@query("g idx", "v", f"WITH RECURSIVE s AS ({SERIES_SQL}), r AS (SELECT g, idx, v FROM s WHERE idx = 0 UNION ALL SELECT s.g, s.idx, 0.3 * s.v + 0.7 * r.v FROM r JOIN s ON s.g = r.g AND s.idx = r.idx + 1) SELECT g, idx, v FROM r")
def dynamics_ema(spark, d):
    return dynamics.ema(series(spark, d), 0.3)


@query("g idx", "v", f"""WITH RECURSIVE s AS ({SERIES_SQL}), r AS (SELECT g, idx, (1.05 / 1.55 * v)::DOUBLE AS v, (1.05 - 1.05 * 1.05 / 1.55)::DOUBLE AS p FROM s WHERE idx = 0
 UNION ALL SELECT s.g, s.idx, r.v + (r.p + 0.05) / (r.p + 0.55) * (s.v - r.v), (r.p + 0.05) * 0.5 / (r.p + 0.55) FROM r JOIN s ON s.g = r.g AND s.idx = r.idx + 1) SELECT g, idx, v FROM r""", 5)
def dynamics_kalman(spark, d):
    return dynamics.kalman(series(spark, d), 0.05, 0.5)


@query("start event_type n", "mean low high", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, avg(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return windows.windowed(table(spark, d, "events"), "ts", ["event_type"], "value", "1 day")


@query("user_id n", "seconds", """SELECT user_id, count(*) AS n, epoch(max(ts) - min(ts)) + 3600 AS seconds FROM (SELECT user_id, ts, sum(j) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
 SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS j FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    s = windows.sessions(table(spark, d, "events"), "ts", ["user_id"], "1 hour")
    return s.select("user_id", "n", (_seconds("end") - _seconds("start")).alias("seconds"))


@query("handle allowed", "tokens level", f"""WITH RECURSIVE s AS (SELECT user_id::VARCHAR AS handle, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS i FROM events), q AS (SELECT handle, i, epoch(ts)::DOUBLE AS now, (value / 10)::DOUBLE AS tokens FROM s),
 r AS (SELECT handle, i, now, tokens, tokens <= 10 AS allowed, CASE WHEN tokens <= 10 THEN 10 - tokens ELSE 10 END::DOUBLE AS level FROM q WHERE i = 1
 UNION ALL SELECT q.handle, q.i, q.now, q.tokens, q.tokens <= least(10, r.level + (q.now - r.now) * 0.0001), least(10, r.level + (q.now - r.now) * 0.0001) - CASE WHEN q.tokens <= least(10, r.level + (q.now - r.now) * 0.0001) THEN q.tokens ELSE 0 END FROM r JOIN q ON q.handle = r.handle AND q.i = r.i + 1) SELECT handle, allowed, tokens, level FROM r""", 4)
def stream_token_bucket(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("handle"), _seconds("ts").alias("now"), (F.col("value") / 10).alias("tokens"))
    return windows.token_bucket(e, 10.0, 0.0001)


@query("g", "q", f"""WITH s AS ({SERIES_SQL}), c AS (SELECT g, idx, v - avg(v) OVER (PARTITION BY g) AS x, count(*) OVER (PARTITION BY g) AS n FROM s), z AS (SELECT g, any_value(n) AS n, sum(x * x) AS z FROM c GROUP BY g HAVING any_value(n) > 3),
 a AS (SELECT a.g, a.idx - b.idx AS k, sum(a.x * b.x) AS p FROM c a JOIN c b ON a.g = b.g AND a.idx - b.idx BETWEEN 1 AND 3 GROUP BY 1, 2) SELECT g, any_value(n) * (any_value(n) + 2) * sum(CASE WHEN z > 0 THEN pow(p / z, 2) ELSE 0 END / (n - k)) AS q FROM z JOIN a USING (g) GROUP BY g""")
def stats_ljung_box(spark, d):
    return stats.ljung_box(series(spark, d), 3)
