"""Bloom filters: made by an aggregate, merged from parts, and used to drop rows before a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits are kept in words of 2^16 bits, so that a filter is a table of rows which tasks make in parts.
WORD = 1 << 16
#: A filter of more words than this (32 MB) is not sent to all tasks; a join then goes without.
BROADCAST_WORDS = 4_096


@dataclass
class Bloom:
    """words: word, bits (binary). Filters of one size and number of hashes can be merged."""

    words: DataFrame
    n_bits: int
    n_hashes: int

    def merge(self, other: Bloom) -> Bloom:
        if (self.n_bits, self.n_hashes) != (other.n_bits, other.n_hashes):
            raise ValueError("filters of different sizes")
        return Bloom(_joined(self.words.unionByName(other.words)), self.n_bits, self.n_hashes)


def size(expected: int, rate: float) -> tuple[int, int]:
    """Bits and hashes for a share of false positives."""
    if not 0 < rate < 1:
        raise ValueError("a rate between 0 and 1")
    bits = max(1, math.ceil(-max(expected, 1) * math.log(rate) / math.log(2) ** 2))
    bits = -(-bits // WORD) * WORD if bits > WORD else bits
    return bits, max(1, round(bits / max(expected, 1) * math.log(2)))


def _places(key: Column, n_bits: int, n_hashes: int) -> Column:
    a, b = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    return F.array(*(F.pmod(F.xxhash64(a, b, F.lit(k)), F.lit(n_bits)) for k in range(n_hashes)))


def _joined(words: DataFrame) -> DataFrame:
    """One row a word: the union of the bits of its parts, in two steps, as many tasks may have made a part."""

    def merged(it):
        found: dict = {}
        for b in it:
            for word, bits in zip(b["word"], b["bits"]):
                one = np.frombuffer(bits, np.uint8)
                found[word] = found[word] | one if word in found else one
        yield pd.DataFrame({"word": list(found), "bits": [v.tobytes() for v in found.values()]})

    return words.mapInPandas(merged, "word long, bits binary").repartition("word").mapInPandas(merged, "word long, bits binary")


def bloom_filter(df: DataFrame, key: str, expected: int, rate: float = 0.01) -> Bloom:
    """The filter of a column's values. Nulls are not members; repeats change nothing; an empty table gives an empty filter.
    A task sets the bits of its own rows, and parts are merged by word: rows are not shuffled."""
    n_bits, n_hashes = size(expected, rate)

    def marked(it):
        found: dict = {}
        for b in it:
            places = np.concatenate([np.zeros(0, np.int64), *b["at"]])
            order = np.unique(places)
            for part in np.split(order, np.flatnonzero(np.diff(order // WORD)) + 1) if len(order) else []:
                bits = found.setdefault(int(part[0] // WORD), np.zeros(WORD, np.bool_))
                bits[part % WORD] = True
            if len(found) > 256:  # 16 MB unpacked
                yield packed(found)
                found = {}
        yield packed(found)

    def packed(found):
        return pd.DataFrame({"word": list(found), "bits": [np.packbits(v, bitorder="little").tobytes() for v in found.values()]})

    at = df.where(F.col(key).isNotNull()).select(_places(F.col(key), n_bits, n_hashes).alias("at"))
    return Bloom(_joined(at.mapInPandas(marked, "word long, bits binary")), n_bits, n_hashes)


def might_contain(df: DataFrame, key: str, bloom: Bloom, out: str = "member") -> DataFrame:
    """df with a boolean: false only where the key is not in the filter; null for a null key. The filter goes to all tasks
    and has to fit there (see BROADCAST_WORDS); of df only the places of the keys' bits leave the JVM."""
    if bloom.n_bits > BROADCAST_WORDS * WORD:
        raise ValueError("a filter of as many bits is not sent to all tasks")
    flat = np.zeros(-(-bloom.n_bits // WORD) * WORD // 8, np.uint8)
    for r in bloom.words.toLocalIterator():  # 8 KB each, BROADCAST_WORDS at most
        flat[r["word"] * WORD // 8 : (r["word"] + 1) * WORD // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(flat)

    @F.pandas_udf("boolean")
    def all_set(at: pd.Series) -> pd.Series:
        places = np.stack(at.to_numpy()) if len(at) else np.zeros((0, 1), np.int64)
        return pd.Series(((sent.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=1))

    return df.withColumn(out, F.when(F.col(key).isNotNull(), all_set(_places(F.col(key), bloom.n_bits, bloom.n_hashes))))


def filtered_join(big: DataFrame, small: DataFrame, key: str, rate: float = 0.01) -> DataFrame:
    """The inner join of big and small on key, which has one name and type in both. Rows of big that have no partner go by a filter of small's
    keys before they are shuffled, if the filter is small enough to be sent to all tasks; results are those of the join."""
    expected = small.where(F.col(key).isNotNull()).count()
    if size(expected, rate)[0] > BROADCAST_WORDS * WORD:
        return big.join(small, key)
    flag = "_member"
    while flag in big.columns:
        flag += "_"
    return might_contain(big, key, bloom_filter(small, key, expected, rate), flag).where(F.col(flag)).drop(flag).join(small, key)
