"""Order of suffixes and the Burrows-Wheeler transform, of texts of any length as tables of symbols.

A text is a table g, pos (from 0), c (its UTF-8 bytes). No task holds a text: ranks come from range sorts, and a round of
doubling joins only the suffixes that are still tied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .running import running_sums, written

#: Symbols that the first ranking looks at: so many digits of base 257 fit a long.
FIRST = 7
BASE = 257
#: Symbols of a text that are looked at together for the first ranking.
BLOCK = 4096
#: Rows of a tie that meet under one key of a join; larger ties are dealt to several.
TIE = 1_000_000


def symbols(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """g, pos, c of each text. Null ids and null texts are left out; of several texts of one id the greatest counts; an
    empty text has no symbols."""
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(F.col(id_col).alias("g")).agg(F.max(text_col).alias("text"))
    pairs = F.regexp_extract_all(F.hex(F.encode("text", "UTF-8")), F.lit("(..)"), 1)
    bytes_ = texts.select("g", F.posexplode(pairs).alias("pos", "h"))
    return bytes_.select("g", F.col("pos").cast("long").alias("pos"), F.conv("h", 16, 10).cast("int").alias("c"))


def column_symbols(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All texts of a column as one text (g = 0), in the order of their ids, each followed by a line feed. Null ids and
    texts are left out; of several texts of one id the greatest counts."""
    each = symbols(df.select(id_col, F.concat(F.col(text_col), F.lit("\n")).alias("_line")), id_col, "_line").withColumnRenamed("g", "_id")
    sizes = running_sums(each.groupBy("_id").agg(F.count("*").alias("n")).withColumn("g", F.lit(0)), ["g"], [F.col("_id")], {"upto": "n"})
    return each.join(sizes.select("_id", (F.col("upto") - F.col("n")).alias("_from")), "_id").select(F.lit(0).alias("g"), (F.col("_from") + F.col("pos")).alias("pos"), "c")


def lines(s: DataFrame) -> DataFrame:
    """line (from 0), text: the symbols of one text, cut at line feeds. The inverse of column_symbols for texts without line
    feeds, but for ids."""
    counted = running_sums(s.withColumn("_cut", (F.col("c") == 10).cast("long")), ["g"], [F.col("pos")], {"_cuts": "_cut"})
    grouped = counted.groupBy("g", (F.col("_cuts") - F.col("_cut")).alias("line")).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("of"))
    bytes_ = F.array_join(F.transform(F.filter("of", lambda x: x["c"] != 10), lambda x: F.lpad(F.hex(x["c"].cast("long")), 2, "0")), "")
    return grouped.select("g", "line", F.decode(F.unhex(bytes_), "UTF-8").alias("text"))


def _first_keys(s: DataFrame) -> DataFrame:
    """g, pos, key: the first symbols of each suffix, with the end of the text as the least symbol. Blocks see the first
    symbols of the next one."""
    ends = s.groupBy("g").agg((F.max("pos") + 1).alias("pos")).withColumn("code", F.lit(0))
    all_ = s.select("g", "pos", (F.col("c") + 1).alias("code")).unionByName(ends.select("g", "pos", "code"))
    block = F.floor(F.col("pos") / BLOCK)
    halo = (F.col("pos") % BLOCK < FIRST - 1) & (F.col("pos") >= BLOCK)
    dealt = all_.withColumn("_b", F.explode(F.when(halo, F.array(block, block - 1)).otherwise(F.array(block))))
    w = W.partitionBy("g", "_b").orderBy("pos")
    key = F.col("code").cast("long")
    for k in range(1, FIRST):
        key = key * BASE + F.lead("code", k, 0).over(w)
    return dealt.select("g", "pos", "_b", key.alias("key")).where(F.col("_b") == block).select("g", "pos", "key")


def _salts(n):
    return F.ceil(n / TIE).cast("int")


def suffix_ranks(s: DataFrame) -> DataFrame:
    """g, pos, rank: the order of the suffixes of each text, from 0; a suffix that is the start of another comes before it.
    The empty suffix, at the text's length, has rank 0. A text without symbols has no rows.

    A tie's rank is how many suffixes are less; each round ranks the members of ties by the ranks of what follows the
    symbols that they share, twice as many as in the round before. Members of large ties are dealt to several keys, by the
    size of the tie that they come from; before the first round AQE has to split the rows of one key.
    """
    keys = written(_first_keys(s))
    tied = keys.groupBy("g", "key").agg(F.count("*").alias("n"))
    least = running_sums(tied, ["g"], [F.col("key")], {"upto": "n"}).select("g", "key", "n", (F.col("upto") - F.col("n")).alias("rank"))
    ranks, width = written(keys.join(least, ["g", "key"]).select("g", "pos", "rank", "n")), FIRST
    while not (open_ := ranks.where("n > 1")).isEmpty():
        after = ranks.select("g", (F.col("pos") - width).alias("pos"), F.col("rank").alias("r2"))
        pairs = written(open_.join(after, ["g", "pos"]))
        counts = pairs.groupBy("g", "rank", "r2").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        placed = running_sums(counts, ["g", "rank"], [F.col("r2")], {"upto": "m"})
        placed = placed.select("g", "rank", "r2", "m", (F.col("upto") - F.col("m")).alias("less"), F.explode(F.sequence(F.lit(0), _salts(F.col("n")) - 1)).alias("_s"))
        dealt = pairs.withColumn("_s", F.pmod(F.xxhash64("pos"), _salts(F.col("n"))).cast("int"))
        new = dealt.join(placed, ["g", "rank", "r2", "_s"]).select("g", "pos", (F.col("rank") + F.col("less")).alias("rank"), F.col("m").alias("n"))
        ranks, width = written(ranks.where("n = 1").unionByName(new)), 2 * width
    return ranks.select("g", "pos", "rank")


def bwt(s: DataFrame) -> DataFrame:
    """g, row, c, whole, end: the symbol before each suffix, in the order of the suffixes. whole marks the row of the whole
    text (its index is the primary one); before that comes the end of the text, where c is 0 and end is true."""
    ranks = suffix_ranks(s)
    before = s.select("g", (F.col("pos") + 1).alias("pos"), "c")
    first = F.col("pos") == 0
    return ranks.join(before, ["g", "pos"], "left").select("g", F.col("rank").alias("row"), F.coalesce("c", F.lit(0)).alias("c"), first.alias("whole"), first.alias("end"))


def ibwt(b: DataFrame) -> DataFrame:
    """g, pos, c of the texts that bwt was made of; needs g, row, c and end. Each row's place among equal symbols tells the
    row of the suffix that is longer by one; how far a row is from the whole text comes by jumps that double each round.
    No two rows jump to the same one before they arrive, so no key of a join is hot."""
    code = F.when(F.col("end"), -1).otherwise(F.col("c"))
    sorted_ = running_sums(b.select("g", "row", "c", "end", code.alias("code"), F.lit(1).alias("one")), ["g"], [F.col("code"), F.col("row")], {"upto": "one"})
    longer = F.when(F.col("end"), F.lit(None)).otherwise(F.col("upto") - 1)
    root = F.col("end")
    jumps = written(sorted_.select("g", "row", "c", longer.alias("to"), F.when(root, 0).otherwise(1).cast("long").alias("far")))
    while not (open_ := jumps.where("to IS NOT NULL")).isEmpty():
        aim = jumps.select("g", F.col("row").alias("to"), F.col("to").alias("_then"), F.col("far").alias("_more"))
        moved = open_.join(aim, ["g", "to"]).select("g", "row", "c", F.col("_then").alias("to"), (F.col("far") + F.col("_more")).alias("far"))
        jumps = written(jumps.where("to IS NULL").unionByName(moved))
    return jumps.where("far > 0").select("g", (F.col("far") - 1).alias("pos"), "c")
