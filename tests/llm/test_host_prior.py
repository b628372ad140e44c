"""The prior decides on hosts of few documents: what it changes is seen by taking it out."""

import pytest
from pyspark.sql import functions as F

from numera.llm import quality_rules

from test_text_operators import DOCS_3, prose


@pytest.fixture(scope="module")
def judged_docs(spark):
    lines = lambda i: "\n".join(x for k in range(5) for x in (prose(100 * i + k, 12), "read on"))
    rows = [(i, lines(i) if i % 2 else prose(i, 60), "loud") for i in range(40)]
    rows += [(100 + i, lines(i) if i == 1 else prose(i, 60), "calm") for i in range(40)]
    rows += [(200 + i, prose(300 + i, 60), f"quiet{i}") for i in range(12)]
    rows += [(300, lines(300), "one page"), (301, lines(301), "two pages"), (302, prose(302, 60), "two pages")]
    return spark.createDataFrame(rows, DOCS_3)


def verdicts(docs):
    return {r["_doc"]["doc_id"]: r["kept"] for r in quality_rules.host_quality(docs, ["doc_id"]).collect()}


def test_small_hosts_are_spared_by_the_prior_alone(judged_docs, monkeypatch):
    with_prior = verdicts(judged_docs)
    shrunk = quality_rules.host_rates

    def raw(judged, host):
        rate = F.col("failed") / F.col("n")
        return shrunk(judged, host).withColumn("rate", rate).withColumn("deviation", F.sqrt(rate * (1 - rate) / (F.col("n") + 1)))

    monkeypatch.setattr(quality_rules, "host_rates", raw)
    without = verdicts(judged_docs)
    assert with_prior[300] and not without[300]  # one page, and that repeats its lines
    assert not with_prior[1] and not without[1] and with_prior[101] and without[101]
    assert all(with_prior[k] for k in range(200, 212))


def test_rates_are_posterior_means(judged_docs):
    text = judged_docs.select(F.col("source").alias("_host"), *(F.lit(False).alias(r) for r in quality_rules.RULES if r != "dup_lines"), (F.col("doc_id") % 2 == 1).alias("dup_lines"))
    rows = [r for r in quality_rules.host_rates(text, "_host").collect() if r["rule"] == "dup_lines"]
    m = rows[0]["mean"]
    for r in rows:
        raw = r["failed"] / r["n"]
        assert min(raw, m) - 1e-12 <= r["rate"] <= max(raw, m) + 1e-12 and 0 <= r["deviation"] < 0.5
