"""Running totals over a whole table in order, by ranges: no task sees more than its range."""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _folder(df: DataFrame) -> str:
    """The checkpoint folder. On a cluster that has to be one that all machines share, so it is never made up there."""
    spark = df.sparkSession
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, with the partitioning it has."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_folder(df))
    return df.checkpoint()


#: Bytes of a written table from which it is not broadcast unless asked for: its files are compressed, and the driver would
#: hold many times as much.
BROADCAST_FILES = 1 << 16

#: Running totals of more rows are not broadcast unless asked for: their size is guessed from compressed files.
BROADCAST_ROWS = 100_000

#: Rows of a range of running_sums, about: more rows make more ranges, not larger ones.
RANGE = 1_000_000

_written: list = []


def _drop() -> None:
    for spark, path in _written:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder's owner clears it
            return


atexit.register(_drop)


def written(df: DataFrame) -> DataFrame:
    """df, written as a table in the checkpoint folder and read back. Unlike after a checkpoint nothing is known of the
    rows but their columns: what the optimizer infers of them would grow from round to round of a loop."""
    path = f"{_folder(df)}/numera-{uuid.uuid4().hex}"
    _written.append((df.sparkSession, path))
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
    back = back if size <= BROADCAST_FILES else back.hint("merge")
    back._written_at = p
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing will read again."""
    for t in tables:
        t._written_at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(t._written_at, True)


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str], before: str = "_range") -> DataFrame:
    """df with a running total of each column in sums (name of the total -> column), within the groups of by, over the rows
    up to and including this one in the order (columns by name), which should leave no ties.

    Rows are range-sorted by group and order; each range adds up its own rows, and one row a range and group carries what
    the earlier ranges hold. Equal keys share a range, so a value that many rows share has to be counted first.
    """
    df = written(df)  # so that it is made once, to be counted, sampled and dealt
    n = df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    ranged = checkpointed(df.repartitionByRange(parts, *(F.col(b) for b in by), *order).withColumn(before, F.spark_partition_id()))
    dropped(df)
    # only the last group of a range goes on in the next one, so one row a range is all that is carried
    last = ranged
    if by:
        ends = ranged.groupBy(before).agg(F.max(F.struct(*by)).alias("_last"))
        same = reduce(lambda a, b: a & b, [ranged[c].eqNullSafe(F.col("_last")[c]) for c in by])
        last = ranged.join(F.broadcast(ends.withColumnRenamed(before, "_end")), (ranged[before] == F.col("_end")) & same)
    totals = last.groupBy(before).agg(*(F.any_value(c).alias(c) for c in by), *(F.sum(c).alias(t) for t, c in sums.items()))
    upto = W.partitionBy(*by).orderBy(before).rowsBetween(W.unboundedPreceding, 0)
    carry = totals.select(F.lead(before).over(W.orderBy(before)).alias("_next"), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), *(F.sum(t).over(upto).alias(f"_carry{k}") for k, t in enumerate(sums)))
    own = W.partitionBy(before, *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = ranged.withColumns({t: F.sum(c).over(own) for t, c in sums.items()})
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)], local[before] == F.col("_next"))
    joined = local.join(F.broadcast(carry), same, "left")
    out = joined.select(*(local[c] for c in df.columns), *((local[t] + F.coalesce(F.col(f"_carry{k}"), F.lit(0))).alias(t) for k, t in enumerate(sums)))
    return out if n <= BROADCAST_ROWS else out.hint("merge")
