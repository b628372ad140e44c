"""Queries over Fourier, cosine and sine transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transforms
from ..sources.tables import MATRIX_SQL, SERIES_SQL, matrix, series, table
from .registry import query

SIZES = f"s AS ({SERIES_SQL}), c AS (SELECT g, count(*) AS m, pow(2, ceil(log2(count(*))))::BIGINT AS n FROM s GROUP BY g)"
DFT = f"""{SIZES}, f AS (SELECT g, n, unnest(range(n)) AS k FROM c),
 x AS (SELECT f.g, f.n, f.k, sum(v * cos(2 * pi() * ((f.k * idx) % n) / n)) AS re, -sum(v * sin(2 * pi() * ((f.k * idx) % n) / n)) AS im FROM f JOIN s ON f.g = s.g GROUP BY 1, 2, 3)"""


@query("g k", "power slant", f"WITH {DFT} SELECT g, k, re * re + im * im AS power, re + 2 * im AS slant FROM x", 4)
def fft_series(spark, d):
    re, im = F.col("re"), F.col("im")
    return transforms.fft(series(spark, d)).select("g", "k", (re * re + im * im).alias("power"), (re + 2 * im).alias("slant"))


@query("g k shifted back", "power freq", f"WITH {DFT} SELECT g, k, (k + n // 2) % n AS shifted, (k + (n + 1) // 2) % n AS back, re * re + im * im AS power, k / (n * 0.5) AS freq FROM x WHERE k <= n / 2", 4)
def fft_real_half(spark, d):
    s = series(spark, d)
    n = s.groupBy("g").agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.count("*")))).cast("long").alias("n"))
    k, n_ = F.col("k"), F.col("n")
    return transforms.rfft(s).join(n, "g").select("g", "k", transforms.fftshift(k, n_).alias("shifted"), transforms.ifftshift(k, n_).alias("back"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"), transforms.rfftfreq(k, n_, 0.5).alias("freq"))


@query("g idx", "v w", f"WITH {SIZES}, p AS (SELECT g, unnest(range(n)) AS idx FROM c) SELECT p.g, p.idx, coalesce(v, 0) + 1 AS v, coalesce(v, 0) + 1 AS w FROM p LEFT JOIN s ON p.g = s.g AND p.idx = s.idx", 5)
def fft_round_trips(spark, d):
    s = series(spark, d)
    whole = transforms.ifft(transforms.fft(s)).select("g", "idx", (F.col("re") + F.col("im") + 1).alias("v"))
    return whole.join(transforms.irfft(transforms.rfft(s)).select("g", "idx", (F.col("v") + 1).alias("w")), ["g", "idx"])


@query("g", "power slant", f"WITH {SIZES}, f AS (SELECT g, m, floor(0.2 * m + 0.5)::BIGINT AS k FROM c), x AS (SELECT f.g, sum(v * cos(2 * pi() * ((k * idx) % m) / m)) AS re, -sum(v * sin(2 * pi() * ((k * idx) % m) / m)) AS im FROM f JOIN s ON f.g = s.g GROUP BY 1) SELECT g, re * re + im * im AS power, re + 2 * im AS slant FROM x", 4)
def fft_goertzel(spark, d):
    re, im = F.col("re"), F.col("im")
    return transforms.goertzel(series(spark, d), 2.0, 10.0).select("g", (re * re + im * im).alias("power"), (re + 2 * im).alias("slant"))


@query("i j", "power", f"""WITH m AS ({MATRIX_SQL}), e AS (SELECT pow(2, ceil(log2(max(i) + 1)))::BIGINT AS n FROM m), q AS (SELECT unnest(range(64)) AS q),
 a AS (SELECT i, q AS j, sum(v * cos(2 * pi() * ((m.j * q) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((m.j * q) % 64) / 64)) AS im FROM m, q GROUP BY 1, 2),
 p AS (SELECT n, unnest(range(n)) AS p FROM e), t AS (SELECT p, i, cos(2 * pi() * ((p * i) % n) / n) AS c, sin(2 * pi() * ((p * i) % n) / n) AS s FROM p, (SELECT DISTINCT i FROM m)),
 b AS (SELECT p AS i, j, sum(re * c + im * s) AS re, sum(im * c - re * s) AS im FROM t JOIN a ON t.i = a.i GROUP BY 1, 2) SELECT i, j, re * re + im * im AS power FROM b""", 4)
def fft_matrix(spark, d):
    return transforms.fft2(matrix(spark, d)).select("i", "j", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


@query("vec_id k", "c s", """WITH m AS (SELECT vec_id, unnest(range(64)) AS t, unnest(embedding)::DOUBLE AS v FROM embeddings), q AS (SELECT unnest(range(64)) AS k)
 SELECT vec_id, k, sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 64.0) * sum(v * cos(pi() * (2 * t + 1) * k / 128)) AS c, sqrt(2 / 65.0) * sum(v * sin(pi() * (t + 1) * (k + 1) / 65)) AS s FROM m, q GROUP BY 1, 2""", 5)
def dct_dst(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    both = table(spark, d, "embeddings").select("vec_id", F.arrays_zip(transforms.dct2(x, 64).alias("c"), transforms.dst2(x, 64).alias("s")).alias("z"))
    return both.select("vec_id", F.posexplode("z").alias("k", "z")).select("vec_id", F.col("k").cast("long").alias("k"), "z.c", "z.s")


@query("vec_id t", "v w", "SELECT vec_id, unnest(range(64)) AS t, unnest(embedding)::DOUBLE AS v, unnest(embedding)::DOUBLE AS w FROM embeddings", 5)
def dct_round_trips(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", transforms.dct2(x, 64).alias("c"), transforms.dst2(x, 64).alias("s"))
    both = e.select("vec_id", F.arrays_zip(transforms.idct2(F.col("c"), 64).alias("v"), transforms.idst2(F.col("s"), 64).alias("w")).alias("z"))
    return both.select("vec_id", F.posexplode("z").alias("t", "z")).select("vec_id", F.col("t").cast("long").alias("t"), "z.v", "z.w")
