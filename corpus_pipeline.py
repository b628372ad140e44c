"""From documents to packed sequences: quality rules, toxicity, near-duplicates, benchmark decontamination, packing.

Null and empty texts have no words, so the quality rules reject them; a stage that is given one keeps it as its own
docstring says. Rows with a null id or source pass through every stage. Repeated rows are judged alike, and near
duplicates leaves one of them. Other columns of documents, whatever their names, are kept up to packing. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from numera.llm import decontamination, packing, quality_rules, simhash, toxicity
from numera.llm.common import materialize, table

TOKENIZER = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep; a null source is no host, and never rejected or suspect."""
    return quality_rules.kept_documents(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic. Null and empty texts get the score of no words; null ids have no label."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash candidates, verified at a similarity of 0.8
    over 5-word shingles. The smallest id stays, null ids come last; blank texts are alike; equal rows are one."""
    return simhash.first_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not overlap with a benchmark text; null and empty texts overlap with nothing, on either side."""
    return decontamination.without_overlaps(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences. A null text is its end alone; ties of length go by the id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("packing", pack)]

#: Learnt scores, 64-bit hashes of shingles and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
