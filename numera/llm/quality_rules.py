"""Quality rules whose failures are judged by host.

Each document gets a few rule measures. Failures are summed by host, each host's rate is shrunk towards the rate of all
hosts by a beta prior fitted to the spread of the rates (empirical Bayes, by moments), and the verdict on a host goes
back to its documents. All of it is built-in column functions, aggregates and one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, words

#: Rules by which hosts are judged; the first two are the base rules.
RULES = ("short", "repeats", "symbols", "stutter", "dup_lines")
#: A host goes if its shrunk rate of some rule is at least this.
HOST_LIMIT = 0.8
#: A document that fails this rule alone goes only if its host surely fails it more often than hosts do on average: the
#: posterior rate less this many posterior standard deviations is above the mean.
BY_HOST, DEVIATIONS = "dup_lines", 2.0
#: Rejected and suspect hosts up to this number are broadcast.
BROADCAST_HOSTS = 100_000
#: The prior weighs as many documents at most, and one at least.
PRIOR_MOST = 1e6


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.transform(F.array(value), f)[0]


def _covered(w: Column, n: int) -> Column:
    """Words in windows of n words that occur twice or more in w."""

    def sorted_out(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def twin(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1)["h"] == x["h"])
                return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)), x["i"])

            return F.sort_array(F.filter(F.transform(s, twin), lambda p: p.isNotNull()))

        def spans(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0), lambda a, x: a + x)

        return _let(pairs, lambda s: _let(starts(s), spans))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(sorted_out(h)))
    return F.when(F.size(w) > n, found).otherwise(0)


def measures(text: Column) -> dict[str, Column]:
    """Rule measures of a text by name; _w has to be its words."""
    w = F.col("_w")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _covered(w, 5).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_stutter": F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x))).cast("long"),
    }


def _failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "short": n < 10,
        "repeats": 100 * F.col("n_repeat_words") > 20 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "stutter": 10 * F.col("n_stutter") > 3 * n,
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
    }


def host_rates(judged: DataFrame, host: str) -> DataFrame:
    """By host and rule: n, failed, rate (shrunk: the mean of the host's posterior), deviation (the posterior's), mean (of all
    hosts). A host of few documents keeps near the mean and has a wide posterior, whatever its own rate. judged has the host and a boolean column for each of RULES."""
    counts = judged.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n"), *(F.count_if(F.col(r)).alias(r) for r in RULES))
    long = counts.select(host, "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES))).alias("x")).select(host, "n", "x.rule", "x.failed")
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    # sums over hosts of n, n^2, f and n p^2 give the mean and the spread of the rates
    sums = long.groupBy("rule").agg(F.sum(n).alias("_n"), F.sum(n * n).alias("_nn"), F.sum(f).alias("_f"), F.sum(f * f / n).alias("_ff"), F.count("*").alias("_h"))
    mean = F.col("_f") / F.col("_n")
    spare = F.col("_n") - F.col("_nn") / F.col("_n")
    between = F.when(spare > 0, (F.col("_ff") - F.col("_n") * mean * mean - (F.col("_h") - 1) * mean * (1 - mean)) / spare)
    weight = F.when(between > 0, F.greatest(F.lit(1.0), F.least(F.lit(PRIOR_MOST), mean * (1 - mean) / between - 1))).otherwise(PRIOR_MOST)
    prior = sums.select("rule", mean.alias("_mean"), weight.alias("_weight"))
    # one row a rule: bounded by RULES
    shrunk = long.join(F.broadcast(prior), "rule").withColumn("rate", (f + F.col("_mean") * F.col("_weight")) / (n + F.col("_weight")))
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("rate") * (1 - F.col("rate"))) / (n + F.col("_weight") + 1))
    return shrunk.withColumn("deviation", deviation).withColumnRenamed("_mean", "mean").drop("_weight")


def host_quality(docs: DataFrame, carry: list[str], text_col: str = "text", host_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """A struct _doc of the carried columns, the measures, base_failed, host_rejected, host_suspect and kept.

    kept is false for a document that fails a base rule (short, repeats), that fails the symbol or the stutter rule,
    whose host is rejected, or that repeats lines and has a host that is suspect: its shrunk rate of such documents is
    above the mean of all hosts by more than DEVIATIONS posterior standard deviations. A null text has no words; a null host is no host and never rejected; repeated rows are judged
    as often as they occur. Columns of docs can have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*carry).alias("_doc"), F.col(text_col).alias("_text"), F.col(host_col).cast("string").alias("_host"))
    rows = rows.withColumn("_w", words(F.col("_text")))
    judged = rows.withColumns(measures(F.col("_text"))).drop("_w", "_text").withColumns(_failures())
    judged = materialize(judged, "quality")  # read twice: for the hosts, and for the documents
    rates = host_rates(judged, "_host").groupBy("_host")
    verdicts = rates.agg((F.max("rate") >= host_limit).alias("host_rejected"), F.max((F.col("rule") == BY_HOST) & (F.col("rate") - DEVIATIONS * F.col("deviation") > F.col("mean"))).alias("host_suspect"))
    verdicts = materialize(verdicts.where("host_rejected OR host_suspect"), "hosts")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    joined = judged.join(verdicts, "_host", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("host_rejected", "host_suspect")})
    base = F.col("short") | F.col("repeats")
    return joined.withColumns({"base_failed": base, "kept": ~(base | F.col("symbols") | F.col("stutter") | F.col("host_rejected") | (F.col("host_suspect") & F.col(BY_HOST)))})


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_quality(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("_doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns of docs; nulls, ties, repeats and empty tables: see host_quality()."""
    return host_quality(docs, docs.columns).where("kept").select("_doc.*")


#: DuckDB; {docs} is a relation with the columns of documents. Gives a row for each of its rows.
JUDGED_SQL = r"""
q_rows AS (SELECT row_number() OVER () AS r, *, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {docs}),
q_windows AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM q_rows WHERE len(w) >= 5)),
q_twice AS (SELECT r, i FROM q_windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
q_covered AS (SELECT r, count(DISTINCT i + k) AS c FROM q_twice, (SELECT unnest(range(5)) AS k) GROUP BY r),
q_measured AS (SELECT q.*, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter FROM q_rows q LEFT JOIN q_covered USING (r)),
q_failed AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 10 * n_symbols > 3 * n_words AS symbols,
  10 * n_stutter > 3 * n_words AS stutter, 10 * n_dup_lines > 3 * n_lines AS dup_lines FROM q_measured),
q_long AS (UNPIVOT (SELECT source, count(*)::DOUBLE AS n, count_if(short)::DOUBLE AS short, count_if(repeats)::DOUBLE AS repeats, count_if(symbols)::DOUBLE AS symbols,
  count_if(stutter)::DOUBLE AS stutter, count_if(dup_lines)::DOUBLE AS dup_lines FROM q_failed WHERE source IS NOT NULL GROUP BY source) ON short, repeats, symbols, stutter, dup_lines INTO NAME rule VALUE f),
q_sums AS (SELECT rule, sum(n) AS sn, sum(n * n) AS snn, sum(f) AS sf, sum(f * f / n) AS sff, count(*) AS h, sum(f) / sum(n) AS m FROM q_long GROUP BY rule),
q_spread AS (SELECT rule, m, CASE WHEN sn - snn / sn > 0 THEN (sff - sn * m * m - (h - 1) * m * (1 - m)) / (sn - snn / sn) END AS b FROM q_sums),
q_prior AS (SELECT rule, m, CASE WHEN b > 0 THEN greatest(1.0, least(1e6, m * (1 - m) / b - 1)) ELSE 1e6 END AS k FROM q_spread),
q_hosts AS (SELECT source AS host, max((f + m * k) / (n + k)) >= 0.8 AS rejected, 
  max(rule = 'dup_lines' AND (f + m * k) / (n + k) - 2 * sqrt(greatest(0, (f + m * k) / (n + k) * (1 - (f + m * k) / (n + k))) / (n + k + 1)) > m) AS suspect FROM q_long JOIN q_prior USING (rule) GROUP BY source),
q_judged AS (SELECT *, short OR repeats AS base_failed, NOT (short OR repeats OR symbols OR stutter OR coalesce(source IN (SELECT host FROM q_hosts WHERE rejected), false) OR (dup_lines AND coalesce(source IN (SELECT host FROM q_hosts WHERE suspect), false))) AS kept FROM q_failed)
"""
OP7_SQL = "WITH " + JUDGED_SQL.format(docs="documents") + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_judged"
