"""Spelling variants: words that differ by one inserted, deleted or replaced character, grouped under their usual form.

The words form a trie whose edges are a table: a node is the prefix that leads to it, and an edge its parent, its character
and its child. A frontier of states goes down the trie level by level, each level a join with the edges. A state is (word,
position, node, edits): the prefix of the words it stands for (words that share a prefix share its state), its length, the
node that the prefix leads to, and the edit spent. Before its edit a state stands at the node of its own prefix, so these
states are the edge table itself; the edit, at any node, is a replacement (two children of the node) or a deletion (a child
and the node), and insertions are deletions seen from the other word. After it both sides have to take the same character:
a join with the edges below the word's prefix and one with those below the node. States in which both sides are words are
neighbours. Nothing grows with the square of a group: a node has no more children than there are characters.

Words longer than LONG would make as many levels. They meet by keys instead: for each of its places a word has a key of what
is left without it, so words with one key differ in that place alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path, table
from .tokenize import release

#: Words of more code points than this meet by keys, others in the trie.
LONG = 32
#: Distinct words that a task holds before it hands their counts on.
WORDS_HELD = 400_000
DAMAGE = 97
SHORTEST, LEAST = 5, 3


def _letters() -> bytes:
    """Latin-1: A-Z to a-z, a-z and U+00C0 to U+00FF as they are, all else to a space."""
    return bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))


def damaged(word: bytes, mark: int, damage: int = DAMAGE) -> bytes:
    """The word (Latin-1), less one code point if the mark is divisible by damage."""
    if mark % damage:
        return word
    at = mark % len(word)
    return word[:at] + word[at + 1 :]


def _counts(damage: int, shortest: int):
    """Counts of a task's words, handed on whenever many are held: pre-aggregated before they are shuffled."""

    def batches(it):
        import zlib
        from collections import Counter

        import pyarrow as pa

        release()
        letters = _letters()
        total: dict[bytes, int] = {}

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return made

        for b in it:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                # a character beyond U+00FF becomes a question mark, which ends a run as it does
                for w, n in Counter((t or "").encode("latin-1", "replace").translate(letters).split()).items():
                    mark = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if mark % damage == 0:
                        w = damaged(w, mark, damage)
                    if len(w) >= shortest:
                        total[w] = total.get(w, 0) + n
                if len(total) > WORDS_HELD:
                    yield batch()
        yield batch()

    return batches


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: runs of Latin letters, some of them damaged by a rule, that are long and frequent enough. A null id counts
    as an empty one, a null text has no runs; repeated rows count each time."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_counts(damage, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _trie(words: DataFrame) -> str:
    """Writes the edge table, one folder a depth: node, parent, c (the edge's character), n (the word's count, null where
    the node is only a prefix). Returns its path."""
    spark = words.sparkSession
    places = F.explode(F.sequence(F.lit(1), F.length("word")))
    nodes = words.select("word", "n", places.alias("depth")).select("depth", F.substring("word", F.lit(1), F.col("depth")).alias("node"), F.when(F.col("depth") == F.length("word"), F.col("n")).alias("n"))
    nodes = nodes.groupBy("depth", "node").agg(F.max("n").alias("n"))
    edges = nodes.select("depth", "node", F.expr("substring(node, 1, depth - 1)").alias("parent"), F.expr("substring(node, depth, 1)").alias("c"), "n")
    path = scratch_path(spark, "trie")
    edges.write.partitionBy("depth").parquet(path)
    return path


_EDGE = "node string, parent string, c string, n long"
_STATE = "word string, n long, node string, m long, deleted string"


def trie_neighbours(words: DataFrame) -> DataFrame:
    """a, na, b, nb: pairs of neighbours among words of at most LONG code points, each pair once."""
    spark = words.sparkSession
    words = words.where(F.length("word") <= LONG)
    deepest = words.agg(F.max(F.length("word"))).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "a string, na long, b string, nb long")
    trie, states = _trie(words), scratch_path(spark, "frontier")
    level = lambda depth: spark.read.schema(_EDGE).parquet(f"{trie}/depth={depth}")
    root = spark.createDataFrame([("", None, None, None)], _EDGE)
    written, front = [], spark.createDataFrame([], _STATE)
    for depth in range(1, deepest + 1):
        edges, above = level(depth), level(depth - 1) if depth > 1 else root
        # edits spent at this level: two children of one node, or a child and the node itself
        child = edges.select("parent", F.col("node").alias("word"), "n", F.col("c").alias("c1"))
        replaced = child.join(edges.select("parent", "node", F.col("n").alias("m"), "c"), "parent").where("c1 < c").select("word", "n", "node", "m", F.lit(None).cast("string").alias("deleted"))
        deleted = child.join(above.select(F.col("node").alias("parent"), F.col("n").alias("m")), "parent").select("word", "n", F.col("parent").alias("node"), "m", F.col("c1").alias("deleted"))
        # edits spent above: both sides take the same character. Of a run of one character the last is the one deleted, so
        # that a pair is reached in one way only
        step = front.select(F.col("word").alias("parent"), "node", "deleted").join(child, "parent").where("deleted IS NULL OR deleted <> c1")
        step = step.select("word", "n", F.concat("node", "c1").alias("node"))
        other = edges.select("node", F.col("n").alias("m"))
        if depth > 1:
            other = other.unionByName(above.select("node", F.col("n").alias("m")))
        step = step.join(other, "node").select("word", "n", "node", "m", F.lit(None).cast("string").alias("deleted"))
        replaced.unionByName(deleted).unionByName(step).write.parquet(f"{states}/{depth}")
        written.append(f"{states}/{depth}")
        front = spark.read.schema(_STATE).parquet(written[-1])
    found = spark.read.schema(_STATE).parquet(*written).where("n IS NOT NULL AND m IS NOT NULL")
    return found.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("node").alias("b"), F.col("m").alias("nb"))


def _keys(shortest_long: int):
    """Of each long word (id, word): a row for the whole and one for each place, with a 128-bit key of what is left without
    it, made of the keys of what stands before and after. kind: 'w' whole, 'd' place deleted, 'r' place replaced."""

    def batches(it):
        import hashlib

        import numpy as np
        import pyarrow as pa

        # polynomials by two moduli
        moduli, base = (2**61 - 1, 2**61 - 31), (1_000_003, 998_244_353)
        for b in it:
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                codes = [ord(c) + 1 for c in w]
                n = len(codes)
                parts = []
                for p, x in zip(moduli, base, strict=True):
                    before, power = [0], [1]
                    for c in codes:
                        before.append((before[-1] * x + c) % p)
                        power.append(power[-1] * x % p)
                    whole = before[n]
                    # the part after place k is whole - before[k + 1] * x^(n - 1 - k)
                    parts.append([(before[k] * power[n - 1 - k] + whole - before[k + 1] * power[n - 1 - k]) % p for k in range(n)] + [whole])
                keys = [f"{u:x}.{v:x}" for u, v in zip(*parts, strict=True)]
                rows = [("w", -1, keys[n])]
                if n > shortest_long:
                    rows += [("d", k, keys[k]) for k in range(n) if k == n - 1 or codes[k + 1] != codes[k]] + [("r", k, keys[k]) for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), b.schema.field(0).type), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows])], ["id", "kind", "place", "key"])

    return batches


def long_neighbours(words: DataFrame) -> DataFrame:
    """a, na, b, nb: pairs of neighbours of which one at least has more than LONG code points, each pair once."""
    spark = words.sparkSession
    kept = words.where(F.length("word") >= LONG)
    if kept.where(F.length("word") > LONG).isEmpty():
        return spark.createDataFrame([], "a string, na long, b string, nb long")
    kept = materialize(kept.withColumn("id", F.monotonically_increasing_id()), "long-words")
    keys = materialize(kept.select("id", "word").mapInArrow(_keys(LONG), "id long, kind string, place int, key string"), "long-keys")
    replaced = keys.where("kind = 'r'").alias("x").join(keys.where("kind = 'r'").alias("y"), ["place", "key"]).where("x.id < y.id").select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    deleted = keys.where("kind = 'd'").alias("x").join(keys.where("kind = 'w'").alias("y"), "key").select(F.col("x.id").alias("i"), F.col("y.id").alias("j"))
    pairs = replaced.unionByName(deleted).distinct()
    one = kept.select(F.col("id").alias("i"), F.col("word").alias("a"), F.col("n").alias("na"))
    two = kept.select(F.col("id").alias("j"), F.col("word").alias("b"), F.col("n").alias("nb"))
    # the keys decide where words meet, the words themselves whether they are neighbours
    return pairs.join(one, "i").join(two, "j").where("a <> b AND levenshtein(a, b, 1) = 1").select("a", "na", "b", "nb")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word. words: word (distinct), n.

    A word's form is its most frequent neighbour (ties: the first in code-point order), if that is ratio times as frequent
    at least; its root is the last of its form's forms, itself if it has none. Counts grow along forms, so they end. An
    empty table gives an empty result; null words are left out.
    """
    words = materialize(words.where("word IS NOT NULL").select("word", "n"), "words")
    pairs = trie_neighbours(words).unionByName(long_neighbours(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("w"))).alias("best"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.w").alias("form"), (-F.col("best.k")).alias("form_n"))
    usual = F.col("form_n") >= ratio * F.col("n")
    formed = materialize(joined.select("word", "n", "n_near", F.when(usual, F.col("form")).alias("form"), F.when(usual, F.col("form_n")).alias("form_n")), "forms")
    # each round doubles how far along its forms a word looks
    ahead = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        jump = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialize(ahead.join(jump, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if ahead.where("moved").isEmpty():
            break
        ahead = ahead.drop("moved")
    return formed.join(ahead.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words_of(table(spark, sf_dir, "documents")))
