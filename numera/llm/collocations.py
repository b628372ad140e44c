"""Phrase collocations, mined best-first by branch and bound.

A phrase grows word by word from its first word. Cut after its first word, a phrase e has a score of 1000 a n / (l r) with
l = f(first word) and r >= a, so no phrase that starts with a word of count f scores above 1000 n / f: prefix counts bound
what can still grow. The frontier holds each language's first words by that bound. Each wave expands the best part of it,
length by length, and a language is settled once its 2000th surviving score lies above the bound of all that is left.

Texts are split into words once and written as chunks: the distinct words of a chunk, and codes into them. Once the frequent
words are known, the chunks are written again without the others, which no candidate holds. A pass over these counts phrases of one length in each task, and only counts are shuffled. Which phrases a pass looks for is told by
bitmaps of their hashes, whose size is bounded; a bitmap lets some others through, which a join with the exact phrases
removes. So a bitmap that is too full costs time and never a result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, table
from .tokenize import release

LONGEST, LEAST, FIRST = 5, 100, 2000
#: The first wave takes the first words whose counts are within this factor of the least, later ones those within its square.
WAVE = 16
#: Bits of a bitmap: 16 for each phrase, between these powers of 2 (at most 32 MB).
BITS_LEAST, BITS_MOST = 16, 28
#: Code positions of a chunk, and those that a task puts together before it counts.
CHUNK, HELD = 10_000, 600_000

_PHRASE = "lang string, phrase string"


def _bytes_table() -> bytes:
    """A-Z to a-z, the characters that end a piece to a full stop, tabs to spaces: of what bytes.split() splits at, only
    spaces are left."""
    t = bytearray(range(256))
    for c in range(65, 91):
        t[c] = c + 32
    for c in (*b".,;:!?", 10, 11, 12, 13):
        t[c] = ord(".")
    t[9] = 32
    return bytes(t)


def _chunks(it):
    """lang, words (joined by spaces), codes (little-endian 32-bit): 0 ends a piece, k stands for the k-th word."""
    from array import array
    from collections import defaultdict
    from itertools import count

    import pyarrow as pa

    release()
    swap = _bytes_table()
    open_ones: dict = {}

    def fresh():
        ids = defaultdict(count().__next__)
        ids[b"."]
        return ids, array("i", [0])

    def batch(lang):
        ids, codes = open_ones.pop(lang)
        words = b" ".join(list(ids)[1:])
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([words], pa.binary()), pa.array([codes.tobytes()], pa.binary())], ["lang", "words", "codes"])

    for b in it:
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = (t or "").encode("utf-8", "surrogatepass").translate(swap).replace(b".", b" . ")
            # a very long text is dealt to several chunks, which end where a piece does
            at = 0
            while at < len(data):
                to = len(data) if len(data) - at <= 8 * CHUNK else data.find(b" . ", at + 4 * CHUNK)
                to = len(data) if to < 0 else to
                if lang not in open_ones:
                    open_ones[lang] = fresh()
                ids, codes = open_ones[lang]
                codes.extend(map(ids.__getitem__, data[at:to].split()))
                codes.append(0)
                at = to
                if len(codes) >= CHUNK:
                    yield batch(lang)
    for lang in list(open_ones):
        yield batch(lang)
    _hand_back()


def _hash(words: list[bytes], lang: str):
    """64-bit hashes of words, by language; place 0 is no word."""
    import numpy as np
    import xxhash

    key = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, key) for w in words), np.uint64, len(words))


def _roll(h, w):
    """The hash of a phrase and one more word."""
    import numpy as np

    return (h * np.uint64(0x9E3779B97F4A7C15) + w) ^ (h >> np.uint64(29))


class Bitmap:
    """Hashes of phrases: certain where it says no."""

    def __init__(self, bits: int, slots):
        self.bits, self.slots = bits, slots

    def has(self, h):
        import numpy as np

        at = _place(h, self.bits)
        return (self.slots[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _place(h, bits: int):
    import numpy as np

    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def bitmap(phrases: DataFrame, n: int) -> Bitmap:
    """Of n phrases (lang, phrase, ...): each task sets its bits, which Spark puts together slot by slot."""
    import numpy as np

    bits = min(max(int(16 * max(n, 1)).bit_length(), BITS_LEAST), BITS_MOST)

    def slots(it):
        import pyarrow as pa

        for b in it:
            seen: dict[int, int] = {}
            for lang, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hs = _hash(p.encode("utf-8", "surrogatepass").split(b" "), lang)
                h = hs[:1]
                for x in hs[1:]:
                    h = _roll(h, x)
                at = int(_place(h, bits)[0])
                seen[at >> 6] = seen.get(at >> 6, 0) | 1 << (at & 63)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(np.fromiter(seen.values(), np.uint64, len(seen)).view(np.int64))], ["slot", "v"])

    got = phrases.select("lang", "phrase").mapInArrow(slots, "slot long, v long").groupBy("slot").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["slot"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return Bitmap(bits, out)


def _hand_back() -> None:
    """Gives freed memory back to the system; a Python worker outlives its task and would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def _tasks(it):
    """(lang, words, codes) of what a task holds at a time: chunks of one language put together under common codes."""
    from collections import defaultdict
    from itertools import count

    import numpy as np

    release()
    open_ones: dict = {}

    def fresh():
        ids = defaultdict(count().__next__)
        ids[b"."]
        return ids, [np.zeros(1, np.int32)]

    def whole(lang):
        ids, parts = open_ones.pop(lang)
        _hand_back()
        return lang, list(ids), np.concatenate(parts)

    for b in it:
        for lang, words, codes in zip(*b.columns, strict=True):  # Arrow's values: codes are not copied
            lang, words = lang.as_py(), words.as_py()
            if lang not in open_ones:
                open_ones[lang] = fresh()
            ids, parts = open_ones[lang]
            own = np.fromiter(map(ids.__getitem__, [b".", *(words.split(b" ") if words else [])]), np.int32)
            parts.append(own[np.frombuffer(codes.as_buffer(), "<i4")])
            if sum(map(len, parts)) > HELD:
                yield whole(lang)
    for lang in list(open_ones):
        yield whole(lang)
    _hand_back()


def _unigrams(it):
    import numpy as np
    import pyarrow as pa

    for lang, words, w in _tasks(it):
        n = np.bincount(w, minlength=len(words))[1:]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([x.decode("utf-8", "surrogatepass") for x in words[1:]], pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _usable(shared):
    """Chunks as before, of frequent words alone: one 0 stands for all others in a row and for the ends of pieces."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        frequent = shared.value[0]
        for lang, words, w in _tasks(it):
            usable = frequent.has(_hash(words, lang))
            usable[0] = False
            w = np.where(usable[w], w, 0)
            w = w[(w != 0) | (np.concatenate([[1], w[:-1]]) != 0)]
            ends, at = np.flatnonzero(w == 0), 0
            while at < len(w) - 1:
                to = ends[min(np.searchsorted(ends, at + CHUNK), len(ends) - 1)]
                used, codes = np.unique(w[at : to + 1], return_inverse=True)
                own = b" ".join([words[k] for k in used[1:].tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([own], pa.binary()), pa.array([codes.astype("<i4").tobytes()], pa.binary())], ["lang", "words", "codes"])
                at = to

    return batches


def _ids(w, pos, m: int, size: int):
    """Ids of the m words from each of the positions on: equal where the words are, without hashing."""
    import numpy as np

    ids, top = w[pos].astype(np.int64), size
    for j in range(1, m):
        if top * size >= 1 << 63:
            ids, top = np.unique(ids, return_inverse=True)[1], len(pos)
        ids, top = ids * size + w[pos + j], top * size
    return ids


def _alike(ids):
    """The places of ids, equal ones together, and where each id begins among them."""
    import numpy as np

    order = np.argsort(ids)
    ordered = ids[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ids)])


def _phrases(vocabulary, w, at, m: int):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.binary_join_element_wise(*(vocabulary.take(pa.array(w[at + j])) for j in range(m)), pa.scalar(" ", pa.large_string())).cast(pa.string())


def _grown(m: int, shared):
    """Counts of the phrases of m words that may be frequent: of frequent words, with a prefix that is frequent and starts
    with a word of this wave, and a rest that is frequent or not counted yet."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        known, wave, later = shared.value
        for lang, words, w in _tasks(it):
            word_hash = _hash(words, lang)
            last = len(w) - m + 1
            if last <= 0:
                continue
            # positions whose words are all frequent, and whose first word is in this wave of the frontier
            starts = wave.has(word_hash)
            starts[0] = False
            pos = np.flatnonzero(starts[w[:last]])
            for j in range(1, m):
                pos = pos[w[pos + j] != 0]
            if m > 2:
                h = word_hash[w[pos]]
                for j in range(1, m - 1):
                    h = _roll(h, word_hash[w[pos + j]])
                pos = pos[known.has(h)]
                h = word_hash[w[pos + 1]]
                for j in range(2, m):
                    h = _roll(h, word_hash[w[pos + j]])
                pos = pos[known.has(h) | later.has(word_hash[w[pos + 1]])]
            order, first = _alike(_ids(w, pos, m, len(words)))
            n = np.diff(first, append=len(order))
            pos = pos[order[first]]
            del order, first
            vocabulary = pa.array([x.decode("utf-8", "surrogatepass") for x in words], pa.large_string())
            for k in range(0, len(n), 100_000):
                some = _phrases(vocabulary, w, pos[k : k + 100_000], m)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, pa.array(n[k : k + 100_000].astype(np.int64))], ["lang", "phrase", "n"])

    return batches


def _looked(shared):
    """Counts of the phrases in the bitmap, of 2 words and more, and the word that stands before (after) all their
    occurrences of a task, or an empty text where there is none or are several."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        wanted = shared.value[0]
        for lang, words, w in _tasks(it):
            word_hash = _hash(words, lang)
            w = np.concatenate([w, [0]])
            pos = np.flatnonzero(w[:-1])
            h = word_hash[w[pos]]
            text = pa.array(["", *(x.decode("utf-8", "surrogatepass") for x in words[1:])], pa.large_string())
            for m in range(2, LONGEST + 1):
                # w ends with 0, so no phrase runs over its end
                going = w[np.minimum(pos + m - 1, len(w) - 1)] != 0
                pos, h = pos[going], h[going]
                h = _roll(h, word_hash[w[pos + m - 1]])
                hit = pos[wanted.has(h)]
                if not len(hit):
                    continue
                order, first = _alike(_ids(w, hit, m, len(words)))
                n = np.diff(first, append=len(order))
                found = []
                for beside in (w[hit - 1], w[hit + m]):
                    low, high = np.minimum.reduceat(beside[order], first), np.maximum.reduceat(beside[order], first)
                    found.append(text.take(pa.array(np.where(low == high, low, 0))).cast(pa.string()))
                phrases = _phrases(text, w, hit[order[first]], m)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases, pa.array(n.astype(np.int64)), *found], ["lang", "phrase", "n", "before", "after"])

    return batches


def _shared(spark: SparkSession, *bitmaps):
    return spark.sparkContext.broadcast(bitmaps)


def _cuts(phrases: DataFrame) -> DataFrame:
    """phrases with first and rest of each of their cuts, and k, the words before the cut."""
    words = F.split("phrase", " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(words) - 1)))
    return cut.withColumns({"first": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, LONGEST), " ")})


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", first: int = FIRST, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score, as the module's query defines them.

    A null language is und, a null or empty text has no words, repeated rows count each time, and ties go by count and
    then by the phrase's bytes. Other columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks, "lang string, words binary, codes binary"), "chunks")
    words = materialize(chunks.mapInArrow(_unigrams, _PHRASE + ", n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = materialize(words.where(F.col("n") >= least), "frequent")
    most = frequent.agg(F.max("n")).first()[0]
    none = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
    if most is None:
        return spark.createDataFrame([], none)
    shared = _shared(spark, bitmap(frequent, frequent_n := frequent.count()))
    chunks = materialize(chunks.mapInArrow(_usable(shared), "lang string, words binary, codes binary"), "usable")
    shared.unpersist()
    n_known = frequent_n
    done = spark.createDataFrame([], _PHRASE + ", a long, l long, r long, total long, score long")
    counted = frequent  # all phrases of known count, 1 word and more
    active = totals.select("lang", "total")
    low, high = least, least * WAVE
    while True:
        wave = frequent.where((F.col("n") >= low) & (F.col("n") < high)).join(active.select("lang"), "lang", "left_semi")
        # first words of later waves: how frequent a rest is that starts with one is not known yet. A bitmap may only err
        # towards looking further, so it holds these and not those that have been expanded
        later = frequent.where(F.col("n") >= high)
        maps = bitmap(wave, frequent_n), bitmap(later, frequent_n)
        prefixes, grown = wave, []
        for m in range(2, LONGEST + 1):
            known = bitmap(counted.where(F.size(F.split("phrase", " ")) == m - 1), n_known) if m > 2 else None
            shared = _shared(spark, known, *maps)
            counts = chunks.mapInArrow(_grown(m, shared), _PHRASE + ", n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
            # what a bitmap let through beyond the frontier's own
            starts = F.substring_index("phrase", " ", m - 1) if m > 2 else F.substring_index("phrase", " ", 1)
            prefixes = materialize(counts.withColumn("_start", starts).join(prefixes.select("lang", F.col("phrase").alias("_start")), ["lang", "_start"], "left_semi").drop("_start"), "grown")
            shared.unpersist()
            n_grown = prefixes.count()
            if not n_grown:
                break
            n_known += n_grown
            grown.append(prefixes)
            counted = counted.unionByName(prefixes)
        if grown:
            found = _scored(spark, chunks, reduce(DataFrame.unionByName, grown), counted, totals)
            done = materialize(done.unionByName(found), "scored")
        # settled: as many survivors as are asked for lie above the bound of all that is left
        left = frequent.where(F.col("n") >= high).join(active, "lang").groupBy("lang", "total").agg(F.min("n").alias("next"))
        bound = left.select("lang", "total", F.expr("CAST(1000BD * total AS DECIMAL(38,0)) div next").alias("bound"))
        above = bound.join(done.select("lang", "score"), "lang", "left").groupBy("lang", "total").agg(F.count_if(F.col("score") > F.col("bound")).alias("above"))
        active = materialize(above.where(F.col("above") < first).select("lang", "total"), "unsettled")
        if active.isEmpty():
            break
        low, high = high, high * WAVE**2
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _scored(spark: SparkSession, chunks: DataFrame, found: DataFrame, counted: DataFrame, totals: DataFrame) -> DataFrame:
    """The survivors among new candidates, with the cut that counts. A pass over the chunks counts the rests that no wave
    has counted yet, and sees which candidates always stand beside the same word: those lie inside a longer candidate."""
    rests = _cuts(found).select("lang", F.col("rest").alias("phrase")).where(F.instr("phrase", " ") > 0).distinct().join(counted, ["lang", "phrase"], "left_anti")
    wanted = materialize(found.select("lang", "phrase").unionByName(rests).distinct(), "wanted")
    shared = _shared(spark, bitmap(wanted, wanted.count()))
    steady = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("") != ""
    looked = chunks.mapInArrow(_looked(shared), _PHRASE + ", n long, before string, after string").groupBy("lang", "phrase").agg(F.sum("n").alias("n"), (steady("before") | steady("after")).alias("inside"))
    looked = materialize(looked.join(wanted, ["lang", "phrase"], "left_semi"), "looked")
    shared.unpersist()
    counts = counted.select("lang", "phrase", "n").unionByName(looked.join(rests, ["lang", "phrase"], "left_semi").select("lang", "phrase", "n"))
    inside = looked.where(F.col("inside") & (F.size(F.split("phrase", " ")) < LONGEST)).select("lang", "phrase")
    alive = found.join(inside, ["lang", "phrase"], "left_anti").select("lang", "phrase", F.col("n").alias("a"))
    cuts = _cuts(alive).join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    score = F.expr(f"(1000BD * {wide('a')} * {wide('total')}) div ({wide('l')} * {wide('r')})")
    best = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "total", F.col("best.score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS d, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
 p AS (SELECT lang, row_number() OVER () AS piece, s FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS s FROM t)),
 w AS (SELECT lang, list_filter(regexp_split_to_array(s, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
 g AS (SELECT lang, m, list_slice(ws, i, i + m - 1) AS ph FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3, 4, 5]) AS m FROM w) WHERE len(ws) >= m)),
 c AS (SELECT lang, m, ph, count(*) AS f FROM g GROUP BY ALL),
 n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
 f AS (SELECT * FROM c WHERE f >= 100),
 a AS (SELECT lang, m, ph, f AS a FROM f WHERE m >= 2),
 longer AS (SELECT lang, m - 1 AS m, ph[1:m - 1] AS ph, a FROM a UNION ALL SELECT lang, m - 1, ph[2:m], a FROM a),
 alive AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM longer WHERE longer.lang = a.lang AND longer.m = a.m AND longer.ph = a.ph AND longer.a >= a.a)),
 cut AS (SELECT lang, m, ph, a, k, ph[1:k] AS x, ph[k + 1:m] AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM alive)),
 scored AS (SELECT cut.lang, cut.ph, a, k, u.f AS l, v.f AS r, n.n, (1000::HUGEINT * a * n.n) // (u.f::HUGEINT * v.f) AS score FROM cut JOIN f u ON u.lang = cut.lang AND u.ph = x JOIN f v ON v.lang = cut.lang AND v.ph = y JOIN n ON n.lang = cut.lang),
 best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ph, ' ')) AS rank FROM best)
 SELECT lang, rank, array_to_string(ph, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""
