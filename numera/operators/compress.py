"""Codecs of byte columns, over Arrow batches, and code lengths from corpus counts."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _binary(f):
    import pandas as pd

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else f(bytes(b)))

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")


def _rle(b: bytes) -> bytes:
    x = np.frombuffer(b, np.uint8)
    if not len(x):
        return b""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    n = np.diff(np.append(starts, len(x)))
    pieces = -(-n // 255)
    out = np.empty((pieces.sum(), 2), np.uint8)
    out[:, 0], out[:, 1] = 255, np.repeat(x[starts], pieces)
    out[np.cumsum(pieces) - 1, 0] = n - 255 * (pieces - 1)  # a run's last piece holds what is left
    return out.tobytes()


def _unrle(b: bytes) -> bytes:
    x = np.frombuffer(b, np.uint8)[: len(b) // 2 * 2]
    return np.repeat(x[1::2], x[::2]).tobytes()


def _delta(b: bytes) -> bytes:
    return np.diff(np.frombuffer(b, np.uint8), prepend=np.uint8(0)).tobytes()


def _undelta(b: bytes) -> bytes:
    return np.cumsum(np.frombuffer(b, np.uint8), dtype=np.uint8).tobytes()


def _move_to_front(b: bytes, order: list) -> bytes:
    out = bytearray()
    for x in b:
        i = order.index(x)
        out.append(i)
        order.insert(0, order.pop(i))
    return bytes(out)


def _from_front(b: bytes, order: list) -> bytes:
    out = bytearray()
    for i in b:
        x = order.pop(i)
        out.append(x)
        order.insert(0, x)
    return bytes(out)


def _together(texts: list, one, many) -> list:
    """What one makes of each text, where many does it for some of like length at a time."""
    out: list = [None] * len(texts)
    known = sorted((k for k, b in enumerate(texts) if b is not None), key=lambda k: -len(texts[k]))
    for at in range(0, len(known), TOGETHER):
        some = known[at : at + TOGETHER]
        codes = [np.frombuffer(texts[k], np.uint8) for k in some]
        # steps in which too few texts are left are cheaper one text at a time
        upto = len(codes[FEW - 1]) if len(some) >= FEW else 0
        made, orders = many([c[:upto] for c in codes], upto)
        for k, c, m, order in zip(some, codes, made, orders):
            out[k] = m.tobytes() + (one(c[upto:].tobytes(), order.tolist()) if len(c) > upto else b"")
    return out


#: Texts that are coded together, and the least number of them for which that is worth it.
TOGETHER, FEW = 256, 16


def _step_by_step(codes: list, upto: int, decode: bool):
    """The codes of texts in order of length, all symbols of one place at a time; and the symbols' order at the end."""
    rank = np.tile(np.arange(256, dtype=np.uint8), (len(codes), 1))
    x = np.zeros((upto, len(codes)), np.uint8)
    for k, c in enumerate(codes):
        x[: len(c), k] = c
    out, rows = np.zeros_like(x), np.arange(len(codes))
    alive = np.searchsorted(-np.array([len(c) for c in codes]), -np.arange(1, upto + 1), side="right")
    for t in range(upto):
        n = alive[t]
        now, r, row = x[t, :n], rank[:n], rows[:n]
        if decode:
            symbol, place = (r == now[:, None]).argmax(1), now
            out[t, :n] = symbol
        else:
            symbol, place = now, r[row, now]
            out[t, :n] = place
        r += r < place[:, None]
        r[row, symbol] = 0
    return [out[: len(c), k] for k, c in enumerate(codes)], rank.argsort(1)


def _all(one, decode: bool):
    import pandas as pd

    def run(x: pd.Series) -> pd.Series:
        return pd.Series(_together(x.tolist(), one, lambda codes, upto: _step_by_step(codes, upto, decode)), index=x.index, dtype=object)

    run.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")


def rle_encode(c: Column) -> Column:
    """Pairs of run length (up to 255) and byte."""
    return _binary(_rle)(c)


def rle_decode(c: Column) -> Column:
    return _binary(_unrle)(c)


def delta_encode(c: Column) -> Column:
    return _binary(_delta)(c)


def delta_decode(c: Column) -> Column:
    return _binary(_undelta)(c)


def move_to_front(c: Column) -> Column:
    return _all(_move_to_front, False)(c)


def move_from_front(c: Column) -> Column:
    return _all(_from_front, True)(c)


def symbol_counts(df: DataFrame, c: str) -> DataFrame:
    """byte, n over all rows: each batch counts its own bytes, so at most 256 rows a batch are shuffled."""

    def run(it):
        import pyarrow as pa

        total = np.zeros(256, np.int64)
        for b in it:
            for x in b.column(0).to_pylist():
                total += np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["byte", "n"])

    return df.select(F.col(c).cast("binary").alias("b")).mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))


def huffman_lengths(counts: DataFrame) -> DataFrame:
    """byte, n, bits: code lengths of a Huffman code. At most 256 rows reach the driver."""
    rows = [(r["n"], r["byte"]) for r in counts.collect()]
    heap = [(n, b, [b]) for n, b in rows]
    bits = {b: 1 if len(rows) == 1 else 0 for _, b in rows}
    heapq.heapify(heap)
    while len(heap) > 1:
        n1, k1, a = heapq.heappop(heap)
        n2, k2, b = heapq.heappop(heap)
        for x in a + b:
            bits[x] += 1
        heapq.heappush(heap, (n1 + n2, min(k1, k2), a + b))
    return counts.sparkSession.createDataFrame([(b, n, bits[b]) for n, b in rows], "byte int, n long, bits int")
