"""Windowed aggregates and keyed state over event streams. The same functions take batch DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, by: list[str], value: str, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """start, by, n, mean, low, high of each window; rows more than late behind are dropped from streams."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean", "low", "high")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """start, end, by, n: runs of events with no gap longer than given."""
    rows = events.withWatermark(ts, late) if late and events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def _bucket(capacity: float, rate: float):
    def take(level: float, at: float, now: float, tokens: float) -> tuple[float, bool]:
        level = min(capacity, level + max(0.0, now - at) * rate)
        return (level - tokens, True) if tokens <= level else (level, False)

    return take


def token_bucket(requests: DataFrame, capacity: float, rate: float) -> DataFrame:
    """handle, now, tokens, allowed, level. requests: handle string, now double (seconds), tokens double.

    A bucket starts full and refills at rate. In a stream its level is keyed state, and rows of a batch are taken in
    order of time; in batch a whole history is replayed, streamed in order.
    """
    take, schema = _bucket(capacity, rate), "handle string, now double, tokens double, allowed boolean, level double"
    if requests.isStreaming:
        from pyspark.sql.streaming.state import GroupStateTimeout

        def step(key, parts, state):
            import pandas as pd

            level, at = state.get if state.exists else (capacity, None)
            rows = pd.concat(list(parts)).sort_values("now")
            out = []
            for now, tokens in zip(rows["now"], rows["tokens"]):
                level, ok = take(level, now if at is None else at, now, tokens)
                at = now
                out.append((key[0], now, tokens, ok, level))
            state.update((level, at))
            yield pd.DataFrame(out, columns=["handle", "now", "tokens", "allowed", "level"])

        return requests.groupBy("handle").applyInPandasWithState(step, schema, "level double, at double", "append", GroupStateTimeout.NoTimeout)

    def run(it):
        import pandas as pd

        h, level, at = object(), capacity, None
        for p in it:
            out = []
            for key, now, tokens in zip(p["handle"], p["now"], p["tokens"]):
                if key != h:
                    h, level, at = key, capacity, None
                level, ok = take(level, now if at is None else at, now, tokens)
                at = now
                out.append((key, now, tokens, ok, level))
            yield pd.DataFrame(out, columns=["handle", "now", "tokens", "allowed", "level"])

    return requests.select("handle", "now", "tokens").repartition("handle").sortWithinPartitions("handle", "now").mapInPandas(run, schema)
