"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own on a local master;
    on a cluster that is an error, as no folder of one machine would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _clean() -> None:
    for spark, path in _made:
        try:
            fs, p = _hadoop(spark, path)
            fs.delete(p, True)
        except Exception:  # the session is gone: the folder's owner clears it
            return


atexit.register(_clean)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/numera-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage so that a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a written table beyond which Spark is not left to choose a broadcast.
GUESSED_ROWS = 100_000


def not_guessed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, a written table, to be joined: with more rows than GUESSED_ROWS it is not broadcast unless asked for. Spark would size
    it by its files, which are compressed, and in memory the driver can hold many times as much. rows: its number, if known."""
    return df if (df.count() if rows is None else rows) <= GUESSED_ROWS else df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts can be long, so Python workers get fewer rows at a time than they do by default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys with more rows than this are joined by broadcast, as long as there are at most so many of them.
HEAVY, BROADCAST_HEAVY = 500, 1_000_000


def spread_join(rows: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to counted on key. counted: a written table with all of the keys, each once, and n, how many rows it has.

    Keys of many rows are broadcast, so that none of them lands in one task. There is at most one of them in HEAVY rows.
    """
    counted = not_guessed(counted)
    heavy = counted.where(F.col(n) > HEAVY).drop(n)
    many = heavy.count()
    if not many:
        return rows.join(counted.drop(n), key)
    few = F.broadcast if many <= BROADCAST_HEAVY else lambda df: df
    rest = rows.join(few(heavy.select(key)), key, "left_anti").join(counted.where(F.col(n) <= HEAVY).drop(n), key)
    return rows.join(few(heavy), key).unionByName(rest)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words of a text in order; null or blank: an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the rule by which rows are held out."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
