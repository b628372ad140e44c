"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous supersteps.

Documents are range-sorted by length, longest first, so that each has a rank among those of its length. Lengths and
gaps are whole numbers up to the capacity, so both sorted lists are runs of equal values: one superstep matches all
documents of one length at once. Its sweep starts at the successor of the length among the gaps and goes up; documents
that want the same gap are served by rank; the gaps shrink and are sorted in again for the next superstep. What a
superstep decides is a few intervals of ranks, and these are joined back to the documents, all of them in parallel.
The lists that the supersteps keep have at most a few entries a length, however many documents there are.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .tokenize import encoder

PIECES = "piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, end_id: int, capacity: int, n_keys: int, keep_ids: bool):
    def batches(it):
        import numpy as np
        import pyarrow as pa

        ids, end = encoder(path).ids, np.array([end_id], "<u4").tobytes()
        for b in it:
            row, piece, start, length, crc, held = [], [], [], [], [], []
            for i, t in enumerate(b.column(n_keys).to_pylist()):
                all_ids = ids(t) + end
                n = len(all_ids) // 4
                at = 0
                for k in range(-(-n // capacity)):
                    to = at + (n % capacity or capacity if k == 0 else capacity)
                    part = all_ids[4 * at : 4 * to]
                    row.append(i), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(part))
                    if keep_ids:
                        held.append(part)
                    at = to
            keys = [b.column(k).take(pa.array(row, pa.int64())) for k in range(n_keys)]
            made = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["piece", "start", "length", "ids_crc32"]
            if keep_ids:
                made.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*keys, *made], [*(b.schema.names[:n_keys]), *names])

    return batches


def supersteps(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit by length. counts: documents by length, each length from 1 to capacity.

    Returns intervals (length, first rank, past rank, documents a sequence, first sequence, offset), and the number of
    sequences. Gaps are kept as runs (gap, first sequence, number of sequences): those of a run have the same gap.
    """
    gaps: list[tuple[int, int, int]] = []
    out, made = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        renewed = []
        at = bisect_left(gaps, (size, -1, -1))  # the successor of this length
        while left:
            if at < len(gaps):
                gap, first, n = gaps.pop(at)
            else:  # no gap is large enough: open sequences
                gap, first, n = capacity, made, -(-left // (capacity // size))
                made += n
            each = gap // size  # best fit keeps a sequence while it fits, as its gap stays the smallest
            full = min(n, left // each)
            if full:
                out.append((size, rank, rank + full * each, each, first, capacity - gap))
                if each * size < gap:
                    renewed.append((gap - each * size, first, full))
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                out.append((size, rank, rank + left, left, first + full, capacity - gap))
                renewed.append((gap - left * size, first + full, 1))
                full, left = full + 1, 0
            if full < n:
                renewed.append((gap, first + full, n - full))
        for run in renewed:
            insort(gaps, run)
    return out, made


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row a piece: keys, piece int, start, length, ids_crc32, sequence_id, offset long (and ids binary).

    A document is its ids and end_id. One longer than capacity is cut into pieces of capacity tokens, its first piece
    being the shorter one; a piece of capacity tokens fills a sequence alone, and all others are packed by best fit.
    A null or empty text is end_id alone. Repeated rows are packed as often as they occur; ties of length go by the
    keys; null keys are kept. Other columns of docs are left out. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kept = docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), PIECES, *["ids binary"] * keep_ids])
    pieces = materialize(kept.mapInArrow(_pieces(tokenizer, end_id, capacity, len(keys), keep_ids), schema), "pieces")

    # range-sort: a length that a third of the documents share is spread over many ranges by the keys
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("length").desc(), *keys]
    ranged = pieces.where(F.col("length") < capacity).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranged")

    # ranges are contiguous in length: all of these rows together are at most lengths plus ranges
    runs = ranged.groupBy("length", "_range").agg(F.count("*").alias("n"), F.min("_at").alias("low")).collect()
    counts: dict[int, int] = {}
    shifts = []
    for r in sorted(runs, key=lambda r: (-r["length"], r["_range"])):
        shifts.append((r["length"], r["_range"], counts.get(r["length"], 0) - r["low"]))
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    intervals, made = supersteps(counts, capacity)
    shift = spark.createDataFrame(shifts, "length long, _range int, _shift long")
    match = spark.createDataFrame(intervals, "length long, _lo long, _hi long, _each long, _first long, _off long")

    # both sides are bounded: the one by lengths and ranges, the other by the capacity
    rank = F.col("_at") + F.col("_shift")
    placed = (
        ranged.join(F.broadcast(shift), ["length", "_range"])
        .withColumn("_rank", rank)
        .join(F.broadcast(match), (ranged["length"] == match["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .drop(match["length"])
    )
    within = F.col("_rank") - F.col("_lo")
    columns = [*keys, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    placed = placed.select(
        *columns,
        (F.col("_first") + F.expr("(_rank - _lo) div _each")).cast("long").alias("sequence_id"),
        (F.col("_off") + F.pmod(within, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )
    whole = pieces.where(F.col("length") == capacity).select(*columns, (F.lit(made) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
