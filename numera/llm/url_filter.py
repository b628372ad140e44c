"""Filtering of URLs by rules, and by a ratio of two character language models where no rule fits.

URLs that the rules allow train the one model, URLs that they block the other. Both are Markov models of variable order:
the probability of a character after three others backs off through shorter contexts, each smoothed towards the next
shorter one. A URL's log-likelihood difference, divided by its length, is held against a threshold that is calibrated
on ruled URLs left out of training. All of it is built-in column functions, aggregates and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: (rule: host and path together, its host, its path, verdict)
RULES = (
    ("org/", "org", "/", "allow"),
    ("example.org/es/", "example.org", "/es/", "block"),
    ("example.org/en/1", "example.org", "/en/1", "block"),
    ("com/fr/", "com", "/fr/", "allow"),
    ("com/de/", "com", "/de/", "block"),
)
#: Characters are put into 40 classes, so there are at most 40^4 windows, whatever the number of URLs.
OTHER = r"[^a-z0./?=&_%#:^$-]"
ORDER, CLASSES = 4, 40
#: Weight of the shorter context, in characters seen.
BACKOFF = 2.0
#: Each URL whose checksum leaves 0 by this is left out of training, for calibration.
CALIBRATE = 5
#: Windows up to this number (some 30 MB) are broadcast; beyond it Spark joins by shuffle.
BROADCAST_WINDOWS = 500_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_rule(rules, host: Column, path: Column, value: int) -> Column:
    """The longest rule that fits; null where none does."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit((rule, h, p, verdict)[value])) for rule, h, p, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0]))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _windows(text: Column) -> Column:
    """Windows of ORDER characters, one for each character and the end."""
    padded = F.concat(F.lit("^" * (ORDER - 1)), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))


def _window_weights(seen: DataFrame) -> DataFrame:
    """By window g: weight, the log of the ratio of its last character's probabilities. seen: g, a, b (counts in allowed and blocked URLs)."""
    totals = seen.agg(F.sum("a"), F.sum("b")).first()
    p = {}
    for k, c in enumerate(("a", "b")):
        p[c] = F.lit(1.0 / CLASSES)
        for n in range(ORDER):  # n characters of context
            with_char, context = F.substr("g", F.lit(ORDER - n), F.lit(n + 1)), F.substr("g", F.lit(ORDER - n), F.lit(n))
            hits = F.sum(c).over(W.partitionBy(with_char)) if n < ORDER - 1 else F.col(c)
            all_hits = F.sum(c).over(W.partitionBy(context)) if n else F.lit(totals[k] or 0)
            p[c] = (hits + BACKOFF * p[c]) / (all_hits + BACKOFF)
    return seen.select("g", (F.ln(p["a"]) - F.ln(p["b"])).alias("weight"))


def judge_urls(pages: DataFrame, carry: list[str], url_col: str = "url", rules=RULES) -> DataFrame:
    """A struct _page of the carried columns, host, path, rule, verdict, score double and threshold double.

    score: log-likelihood difference for each character, positive where the URL is more like the allowed ones. A null
    URL, or one without ://, has an empty host and path, fits no rule, and is judged by its characters. Without ruled
    URLs of both kinds the threshold is 0. Equal scores get equal verdicts; repeated rows stay repeated. An empty table
    gives an empty result.
    """
    url = F.col("_url")
    rows = pages.select(F.struct(*carry).alias("_page"), F.col(url_col).alias("_url"))
    rows = rows.withColumns({"host": host_of(url), "path": path_of(url)})
    rows = rows.withColumns({"rule": _first_rule(rules, F.col("host"), F.col("path"), 0), "ruled": _first_rule(rules, F.col("host"), F.col("path"), 3)})
    plain = F.regexp_replace(ascii_lower(F.coalesce(F.regexp_replace(url, r"^[^:/?#]*://", ""), F.lit(""))), "[0-9]", "0")
    rows = rows.withColumn("_text", F.regexp_replace(plain, OTHER, "~"))
    held = F.pmod(F.crc32(F.col("_text").cast("binary")), F.lit(CALIBRATE)) == 0
    # one row for each text and verdict of the rules: a URL that fills a third of the rows counts once for each task
    texts = materialize(rows.groupBy("_text", "ruled").agg(F.count("*").alias("n")).withColumn("_held", held), "urls")
    one = lambda verdict: F.sum(F.when((F.col("ruled") == verdict) & ~F.col("_held"), F.col("n")).otherwise(0))
    seen = texts.select("ruled", "_held", "n", F.explode(_windows(F.col("_text"))).alias("g")).groupBy("g").agg(one("allow").alias("a"), one("block").alias("b"))
    seen = materialize(seen, "windows")
    weights = materialize(_window_weights(seen), "weights")
    if weights.count() <= BROADCAST_WINDOWS:
        weights = F.broadcast(weights)
    scored = texts.select("_text").distinct().select("_text", F.explode(_windows(F.col("_text"))).alias("g")).join(weights, "g")
    scored = materialize(scored.groupBy("_text").agg(F.round(F.sum("weight") / F.count("*"), 9).alias("score")), "scores")

    # calibration: of the bins of scores (2,001 at most), the lower end of the one that tells the two kinds apart best
    bins = texts.where("_held AND ruled IS NOT NULL").join(scored, "_text").groupBy(F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "score")), 2).alias("bin"))
    bins = bins.agg(F.sum(F.when(F.col("ruled") == "allow", F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("ruled") == "block", F.col("n")).otherwise(0)).alias("bad"))
    below, every = W.orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = lambda c: F.coalesce(F.sum(c).over(below), F.lit(0)) / F.nullif(F.sum(c).over(every), F.lit(0))
    best = bins.select("bin", F.round(share("bad") - share("good"), 9).alias("gain")).where("gain IS NOT NULL").orderBy(F.desc("gain"), "bin").first()
    threshold = float(best["bin"]) - 0.005 if best else 0.0

    out = rows.join(scored, "_text", "left").withColumn("threshold", F.lit(threshold))
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("_page", "host", "path", "rule", verdict.alias("verdict"), "score", "threshold")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), ["page_id"]).select("_page.page_id", "host", "path", "rule", "verdict", "score")



def _op9_sql() -> str:
    fits = []
    for rule, h, p, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    prob = {}
    for c in "ab":
        prob[c] = "(1.0::DOUBLE / 40)"
        for n in range(ORDER):
            hits = f"sum({c}) OVER (PARTITION BY substr(g, {ORDER - n}, {n + 1}))" if n < ORDER - 1 else c
            total = f"sum({c}) OVER (PARTITION BY substr(g, {ORDER - n}, {n}))" if n else f"(SELECT coalesce(sum({c}), 0) FROM seen)"
            prob[c] = f"(({hits} + 2.0 * {prob[c]}) / ({total} + 2.0))"
    return rf"""WITH parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rows_ AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled, regexp_replace(regexp_replace(translate(coalesce(regexp_replace(url, '^[^:/?#]*://', ''), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0./?=&_%#:^$-]', '~', 'g') AS t FROM parts),
-- the fold is by checksum of the text, which this dialect lacks: crc32 from its definition
crc_table AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)),
crc_list AS (SELECT list(v ORDER BY i) AS v FROM crc_table),
texts AS (SELECT t, ruled, count(*) AS n FROM rows_ GROUP BY ALL),
held AS (SELECT t, ruled, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])::BIGINT)), lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0 AS h FROM texts, crc_list),
grams AS (SELECT t, ruled, n, h, substr('^^^' || t || '$', i, 4) AS g FROM (SELECT *, unnest(range(1, length(t) + 2)) AS i FROM held)),
seen AS (SELECT g, sum(CASE WHEN ruled = 'allow' AND NOT h THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN ruled = 'block' AND NOT h THEN n ELSE 0 END)::DOUBLE AS b FROM grams GROUP BY g),
weights AS (SELECT g, ln({prob["a"]}) - ln({prob["b"]}) AS w FROM seen),
distinct_texts AS (SELECT t, unnest(range(1, length(t) + 2)) AS i FROM (SELECT DISTINCT t FROM texts)),
scores AS (SELECT t, round(sum(w) / count(*), 9) AS score FROM distinct_texts JOIN weights ON g = substr('^^^' || t || '$', i, 4) GROUP BY t),
bins AS (SELECT round(greatest(-10.0, least(10.0, score)), 2) AS bin, sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END)::DOUBLE AS good, sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END)::DOUBLE AS bad FROM held JOIN scores USING (t) WHERE h AND ruled IS NOT NULL GROUP BY 1),
gains AS (SELECT bin, round(coalesce(sum(bad) OVER below, 0) / nullif(sum(bad) OVER (), 0) - coalesce(sum(good) OVER below, 0) / nullif(sum(good) OVER (), 0), 9) AS gain FROM bins WINDOW below AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
threshold AS (SELECT coalesce((SELECT bin - 0.005 FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, bin LIMIT 1), 0.0) AS x)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= x THEN 'allow' ELSE 'block' END) AS verdict, score FROM rows_ JOIN scores USING (t), threshold"""


OP9_SQL = _op9_sql()
