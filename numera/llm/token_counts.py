"""Token counts through a digest cache.

The digest of the normalised content and the digest of the tokenizer file are the cache's key. Contents whose key is
stored are joined to their counts; of the rest each distinct content is encoded once, and its count is appended.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, materialize, scratch_path, spread_join, table
from .tokenize import encoder

CACHE = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(path: str):
    def batches(it):
        import pyarrow as pa

        ids = encoder(path).ids
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(ids(t)) // 4 for t in b.column(1).to_pylist()], pa.int64())], ["digest", "n_tokens"])

    return batches


def _folder(spark: SparkSession, tokenizer: str, cache: str | None) -> str:
    return f"{cache or scratch_path(spark, 'token-cache')}/tokenizer={tokenizer_version(tokenizer)}"


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def extend_cache(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text") -> None:
    """Counts the tokens of each distinct content of docs that cache does not hold, and appends them to it."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    folder = _folder(spark, tokenizer, cache)
    distinct = docs.select(_digest(text).alias("digest"), text.alias("t"))
    if exists(spark, folder):
        distinct = distinct.join(spark.read.schema(CACHE).parquet(folder), "digest", "left_anti")
    # partial aggregation keeps one text a digest and task, so that a content that fills a third of the rows stays small
    distinct = distinct.groupBy("digest").agg(F.any_value("t").alias("t"))
    distinct.mapInArrow(_count(tokenizer), CACHE).write.mode("append").parquet(folder)


def cached_counts(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text") -> DataFrame:
    """docs without its text, with n_bytes and n_tokens from the cache, null where it does not hold the content."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in docs.columns if c not in (text_col, "n_tokens", "n_bytes")]
    rows = docs.select(F.struct(F.lit(0), *(f"`{c}`" for c in kept)).alias("_doc"), _digest(text).alias("_digest"), F.octet_length(text).cast("long").alias("_bytes"))
    rows = materialize(rows, "digests")
    # two runs may have appended the same content
    stored = spark.read.schema(CACHE).parquet(_folder(spark, tokenizer, cache)).groupBy(F.col("digest").alias("_digest")).agg(F.max("n_tokens").alias("_tokens"))
    counts = materialize(rows.groupBy("_digest").agg(F.count("*").alias("_n")).join(stored, "_digest", "left"), "counts")
    return spread_join(rows, counts, "_digest", "_n").select(*(F.col(f"_doc.`{c}`") for c in kept), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, text_col: str = "text") -> DataFrame:
    """docs without its text, with n_bytes long and n_tokens long.

    tokenizer: path of a .json (tokenizers) or .model (sentencepiece) file, the same on each machine.
    cache: folder of the stored counts, in a store that all machines share; None: one for this call only.
    Normalising keeps every character, as each can change a count; a null text becomes the empty one, of 0 tokens.
    Repeated rows stay repeated; columns of docs named like the results are replaced. Nulls in other columns pass.
    An empty table gives an empty result.
    """
    cache = cache or scratch_path(docs.sparkSession, "token-cache")
    extend_cache(docs, tokenizer, cache, text_col)
    return cached_counts(docs, tokenizer, cache, text_col)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two halves, so that contents of the second half that the first one had are found stored."""
    import public_tokenizers

    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")
    cache = scratch_path(spark, "token-cache")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    for k in (0, 1):
        extend_cache(docs.where(half == k), path, cache)
    return cached_counts(docs, path, cache).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
