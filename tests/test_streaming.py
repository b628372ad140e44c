"""Streams give what batches give."""

import math

import pytest
from pyspark.sql import functions as F

from numera.operators import dynamics
from numera.streaming import windows


@pytest.fixture
def files(spark, tmp_path):
    rows = [(f"h{i % 3}", float(i), 3.0 + i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "handle string, now double, tokens double")
    for k in range(3):
        df.where((F.col("now") >= 20 * k) & (F.col("now") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, str(tmp_path / "in")


def run(spark, stream, mode, name):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def test_token_bucket(spark, files):
    df, path = files
    batch = windows.token_bucket(df, 10.0, 1.0)
    stream = windows.token_bucket(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(path), 10.0, 1.0)
    a, b = (sorted(map(tuple, x.collect())) for x in (batch, run(spark, stream, "append", "buckets")))
    assert a == b and len(a) == 60
    level, at = 10.0, 0.0
    for _, now, tokens, ok, left in [r for r in a if r[0] == "h0"]:
        level = min(10.0, level + now - at)
        at = now
        assert ok == (tokens <= level)
        level -= tokens if ok else 0
        assert math.isclose(left, level)


def test_windows(spark, files):
    df, path = files
    with_ts = lambda d: d.withColumn("ts", F.timestamp_seconds("now"))
    batch = windows.windowed(with_ts(df), "ts", ["handle"], "tokens", "10 seconds")
    stream = windows.windowed(with_ts(spark.readStream.schema(df.schema).parquet(path)), "ts", ["handle"], "tokens", "10 seconds", late="1 minute")
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, run(spark, stream, "complete", "windows").collect()))


def test_filters_keep_series_apart(spark):
    s = spark.createDataFrame([(g, i, float(i + 10 * g)) for g in range(2) for i in range(50)], "g long, idx long, v double")
    got = {(r["g"], r["idx"]): r["v"] for r in dynamics.ema(s, 0.5).collect()}
    for g in range(2):
        y = None
        for i in range(50):
            v = float(i + 10 * g)
            y = v if y is None else 0.5 * v + 0.5 * y
            assert math.isclose(got[g, i], y)
