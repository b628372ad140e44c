"""Queries over complex numbers, combinatorics, quantum states and codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import combo, cplx
from ..operators import compress, quantum
from ..sources.tables import table
from .registry import query

AB = "(SELECT p_partkey, p_size / 10.0 AS a, p_retailprice / 1000.0 AS b FROM part)"


@query("p_partkey", "mr mi dr di modulus arg er ei lr li sr si pr pi", f"""SELECT p_partkey, a * b - b * (-a) AS mr, a * (-a) + b * b AS mi, (a * b + b * (-a)) / (b * b + a * a) AS dr, (b * b - a * (-a)) / (b * b + a * a) AS di, sqrt(a * a + b * b) AS modulus, atan2(b, a) AS arg,
 exp(a) * cos(b) AS er, exp(a) * sin(b) AS ei, ln(sqrt(a * a + b * b)) AS lr, atan2(b, a) AS li, sqrt(sqrt(a * a + b * b)) * cos(atan2(b, a) / 2) AS sr, sqrt(sqrt(a * a + b * b)) * sin(atan2(b, a) / 2) AS si,
 pow(sqrt(a * a + b * b), 1.5) * cos(atan2(b, a) * 1.5) AS pr, pow(sqrt(a * a + b * b), 1.5) * sin(atan2(b, a) * 1.5) AS pi FROM {AB}""")
def complex_algebra(spark, d):
    a, b = F.col("p_size") / 10.0, F.col("p_retailprice") / 1000.0
    z, w = cplx.make(a, b), cplx.conj(cplx.make(b, a))
    two = lambda c, n: [c["re"].alias(n + "r"), c["im"].alias(n + "i")]
    return table(spark, d, "part").select("p_partkey", *two(cplx.mul(z, w), "m"), *two(cplx.div(z, w), "d"), cplx.modulus(z).alias("modulus"), cplx.arg(z).alias("arg"), *two(cplx.exp(z), "e"), *two(cplx.log(z), "l"), *two(cplx.sqrt(z), "s"), *two(cplx.power(z, 1.5), "p"))


@query("p_partkey c3 p3 cat der bell fib part", "", """WITH RECURSIVE fib AS (SELECT 0 AS n, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT n + 1, b, a + b FROM fib WHERE n < 60),
 der AS (SELECT 0 AS n, 1::BIGINT AS a, 0::BIGINT AS b UNION ALL SELECT n + 1, b, (n + 1) * (a + b) FROM der WHERE n < 15),
 cat AS (SELECT 0 AS n, 1::BIGINT AS c UNION ALL SELECT n + 1, c * 2 * (2 * n + 1) // (n + 2) FROM cat WHERE n < 20)
 SELECT p_partkey, (p_size * (p_size - 1) * (p_size - 2) // 6)::BIGINT AS c3, (p_size * (p_size - 1) * (p_size - 2))::BIGINT AS p3, cat.c AS cat, der.a AS der, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 5 ELSE 15 END::BIGINT AS bell, fib.a AS fib,
 CASE p_size % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 5 ELSE 7 END::BIGINT AS part FROM part JOIN fib ON fib.n = p_size JOIN der ON der.n = p_size % 15 JOIN cat ON cat.n = p_size % 20""")
def combo_counts(spark, d):
    n = F.col("p_size").cast("bigint")
    c = lambda x: x.cast("bigint")
    return table(spark, d, "part").select("p_partkey", combo.choose(n, F.lit(3)).alias("c3"), combo.permutations(n, F.lit(3)).alias("p3"), c(combo.catalan(n % 20)).alias("cat"), c(combo.derangements(n % 15)).alias("der"), c(combo.bell(n % 5)).alias("bell"), c(combo.fibonacci(n)).alias("fib"), c(combo.partitions(n % 6)).alias("part"))


def _states(spark, d):
    """Each embedding as the real amplitudes of six qubits."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sys"), F.posexplode("embedding").alias("k", "v"))
    return quantum.normalize(e.select("sys", F.col("k").cast("bigint").alias("k"), F.col("v").cast("double").alias("re"), F.lit(0.0).alias("im")))


STATES = "SELECT vec_id AS sys, k, embedding[k + 1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS re FROM embeddings, (SELECT unnest(range(64)) AS k)"


@query("sys", "z", f"WITH s AS ({STATES}), h AS (SELECT a.sys, a.k, (CASE WHEN (a.k & 4) = 0 THEN a.re + b.re ELSE b.re - a.re END) / sqrt(2) AS re FROM s a JOIN s b ON a.sys = b.sys AND b.k = xor(a.k, 4)) SELECT sys, sum(re * re * CASE WHEN (k & 4) = 0 THEN 1 ELSE -1 END) AS z FROM h GROUP BY sys", 9)
def quantum_hadamard_z(spark, d):
    return quantum.expect_z(quantum.apply_gate(_states(spark, d), "h", 2), 2)


@query("sys", "fidelity", f"WITH s AS ({STATES}) SELECT a.sys, pow(sum(a.re * b.re), 2) AS fidelity FROM s a JOIN s b ON a.sys = b.sys AND b.k = CASE WHEN (a.k & 1) = 1 THEN xor(a.k, 2) ELSE a.k END GROUP BY a.sys", 9)
def quantum_controlled_not(spark, d):
    s = _states(spark, d)
    return quantum.fidelity(s, quantum.apply_gate(s, "x", 1, control=0))


@query("doc_id same n_runs", "", "SELECT doc_id, true AS same, 1 + len(list_filter(range(2, len(c) + 1), lambda i: c[i] <> c[i - 1])) AS n_runs FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^ -~]', '?', 'g'), '.') AS c FROM documents)")
def compress_round_trips(spark, d):
    b = F.regexp_replace("text", "[^ -~]", "?").cast("binary")
    docs = table(spark, d, "documents").select("doc_id", b.alias("b"))
    docs = docs.select("doc_id", "b", compress.rle_encode(F.col("b")).alias("r"), compress.move_to_front(compress.delta_encode(F.col("b"))).alias("m"))
    same = (compress.rle_decode(F.col("r")) == F.col("b")) & (compress.delta_decode(compress.move_from_front(F.col("m"))) == F.col("b"))
    # runs of at most 255 bytes are one pair each
    return docs.select("doc_id", same.alias("same"), (F.octet_length("r") / 2).cast("long").alias("n_runs"))


@query("byte n bits", "")
def compress_huffman(spark, d):
    return compress.huffman_lengths(compress.symbol_counts(table(spark, d, "documents"), "text"))
