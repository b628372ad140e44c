"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask laid over the words at a place: it hashes the words under its ones and ignores those under its
zeros, so a substituted word there leaves the hash as it was. Hashes of the benchmark's seeds are joined with those of
each training document where the document is, and around each hit the two texts are aligned word by word; an overlap
counts if it is long enough and few of its words differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokenize import release

#: However two substitutions fall among 12 words, one of these masks fits between them.
MASKS = ("111111", "11101011", "101100111")
#: Words that an overlap has at least, and the share of them that agree. Shorter benchmark texts, of 5 words or more,
#: have to be found whole and unchanged.
MIN_WORDS, MIN_EQUAL, SHORTEST = 12, 0.8, 5
#: Characters of the benchmark that are sent to the executors at a time; a larger one is taken in blocks. A word takes
#: two characters at least, so a block holds at most half as many words, in whatever script.
BLOCK_CHARS = 12_000_000
_WORD = r"[^\W_]+"
_BITS = 22


class _Hashes(dict):
    """Word -> hash; the frequent ones are kept."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        h = xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = h
        return h


class Benchmark:
    """The seeds of a block of benchmark texts, and the search for them in a document."""

    def __init__(self, items: list[tuple]):
        import re

        import numpy as np

        self.np, self.find, self.hashes = np, re.compile(_WORD).findall, _Hashes()
        self.keys = [k for k, _ in items]
        self.words = [self.hash_words(t) for _, t in items]
        rng = np.random.default_rng(7)
        self.factors = rng.integers(1 << 62, (1 << 63) - 1, 16, dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.seeds = []
        for mask, wanted in [*((m, lambda n: n >= MIN_WORDS) for m in MASKS), ("1" * SHORTEST, lambda n: SHORTEST <= n < MIN_WORDS)]:
            at = [i for i, c in enumerate(mask) if c == "1"]
            h, item, pos = [], [], []
            for k, w in enumerate(self.words):
                if wanted(len(w)):
                    own = self.seed_hashes(w, at)[: None if len(w) >= MIN_WORDS else 1]
                    h.append(own), item.append(np.full(len(own), k)), pos.append(np.arange(len(own)))
            if h:
                h, item, pos = map(np.concatenate, (h, item, pos))
                order = np.argsort(h, kind="stable")
                present = np.zeros(1 << _BITS, bool)
                present[h >> np.uint64(64 - _BITS)] = True
                self.seeds.append((at, h[order], item[order], pos[order], present))

    def hash_words(self, text: str):
        found = self.find(text.lower())
        return self.np.fromiter(map(self.hashes.__getitem__, found), self.np.uint64, len(found))

    def seed_hashes(self, w, at: list[int]):
        n = len(w) - at[-1]
        if n <= 0:
            return w[:0]
        out = self.np.zeros(n, self.np.uint64)
        for k, i in enumerate(at):
            out += w[i : i + n] * self.factors[k]
        return out

    def overlaps(self, text: str) -> list[tuple]:
        """(item, start in the document, start in the item, words, equal words): the longest overlap with each item found."""
        np = self.np
        w = self.hash_words(text)
        lines = set()
        for at, h, item, pos, present in self.seeds:
            own = self.seed_hashes(w, at)
            near = np.nonzero(present[own >> np.uint64(64 - _BITS)])[0]
            if not len(near):
                continue
            lo, hi = np.searchsorted(h, own[near], "left"), np.searchsorted(h, own[near], "right")
            for p, a, b in zip(near[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                lines.update(zip(item[a:b].tolist(), (p - pos[a:b]).tolist()))
        best: dict[int, tuple] = {}
        for k, shift in lines:
            x = self.words[k]
            start, end = max(0, shift), min(len(w), shift + len(x))
            same = w[start:end] == x[start - shift : end - shift]
            if len(x) < MIN_WORDS:
                got = (len(x), len(x), start, 0) if len(same) == len(x) and same.all() else None
            else:
                got = self.longest(same, start, shift)
            if got and (k not in best or got > best[k]):
                best[k] = got
        return [(k, start, at, n, equal) for k, (n, equal, start, at) in sorted(best.items())]

    def longest(self, same, start: int, shift: int):
        """The longest stretch, equal at both ends, in which enough words are equal."""
        np = self.np
        total = np.concatenate([[0], np.cumsum(np.where(same, 1 - MIN_EQUAL, -MIN_EQUAL))])
        ends = np.nonzero(same)[0]
        low = np.minimum.accumulate(total[ends])  # the lowest total before each possible start
        found = None
        for e in ends[::-1].tolist():
            if found and e + 1 <= found[1]:
                break
            k = int(np.searchsorted(-low, -(total[e + 1] + 1e-9)))
            if k < len(ends) and ends[k] <= e:
                s = int(ends[k])
                if not found or e + 1 - s > found[1] - found[0]:
                    found = (s, e + 1)
        if not found or found[1] - found[0] < MIN_WORDS:
            return None
        s, e = found
        return (e - s, int(same[s:e].sum()), start + s, start + s - shift)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of (id, text), each of a bounded number of characters (or of one text); rows come in one at a time."""
    block, size = [], 0
    for r in benchmark.select(id_col, F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        n = len(r[1])
        if block and size + n > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def _search(block, id_type):
    def batches(it):
        import pyarrow as pa

        release()
        bench = Benchmark(block.value)
        for b in it:
            row, found = [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if t:
                    for x in bench.overlaps(t):
                        row.append(i), found.append(x)
            keep = pa.array(row, pa.int64())
            made = [pa.array([bench.keys[x[0]] for x in found], id_type), *(pa.array([x[k] for x in found], pa.int64()) for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays([*(c.take(keep) for c in b.columns[:-1]), *made], [*b.schema.names[:-1], "_item", "doc_start", "item_start", "n_words", "n_equal"])

    return batches


def _drop(block):
    def batches(it):
        import pyarrow as pa

        release()
        bench = Benchmark(block.value)
        for b in it:
            yield b.filter(pa.array([not (t and bench.overlaps(t)) for t in b.column("_text").to_pylist()], pa.bool_()))

    return batches


def overlaps(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that overlap: a struct _doc of the carried columns, the item's id,
    doc_start, item_start (in words from 0), n_words, n_equal long, and equal_share double, of the longest overlap.

    Words are runs of letters and digits, lower-cased. Null and empty texts overlap with nothing; items of fewer than 5
    words never do. Of equally long overlaps the one with more equal words counts, then the later. Repeated rows on
    either side are reported as often as they occur. An empty table on either side gives an empty result. A benchmark
    of any size works: it is taken in blocks, each against all documents.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    kind = benchmark.schema[item_col].dataType
    rows = docs.select(F.struct(*carry).alias("_doc"), F.col(text_col).alias("_text"))
    schema = f"_doc {rows.schema['_doc'].dataType.simpleString()}, _item {kind.simpleString()}, doc_start long, item_start long, n_words long, n_equal long"
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_col, item_text_col):
        out = out.unionByName(rows.mapInArrow(_search(spark.sparkContext.broadcast(block), to_arrow_type(kind)), schema))
    return out.withColumn("equal_share", F.col("n_equal") / F.col("n_words")).withColumnRenamed("_item", item_col)


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """docs without those that overlap with a benchmark text; see overlaps()."""
    out = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))
    schema = out.schema
    for block in _blocks(benchmark.select(F.lit(0).alias("_id"), F.col(item_text_col).alias("_t")), "_id", "_t"):
        out = out.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(block)), schema)
    return out.select("_doc.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("_doc.doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal", "equal_share")
