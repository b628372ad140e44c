"""Language-model scoring of whole texts.

A word count over all training texts gives the base model, and, through the subword ids of each distinct word, what the
neural model needs of the corpus: how often ids occur and follow each other. The ids of a frequent word are predicted in
one step, those of other words one by one. The neural model is then trained on all training texts: they are dealt by
hash to shards of a fixed size, each starts from the same weights, and the shards' weights are averaged after each round.
So the result does not depend on partitions.
Scoring cuts each text's ids into overlapping context windows and scores each id in one of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import log10

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table

#: Rows whose checksum leaves 2 by 7 are never learnt from.
FOLDS, HELD_OUT = 7, 2
#: Corpora of fewer tokens are gone through several times by the neural model, larger ones once.
TRAIN_TOKENS = 3_000_000
#: Texts are trained on in so many rounds, after each of which the tasks' weights are averaged.
ROUNDS, PASSES = 2, 5
#: Words that make up at least one in so many tokens are sent to the executors with their counts: no more words than this.
FREQUENT = 1_000_000
RATE, TRAIN_WINDOWS, SCORE_WINDOWS = 0.015, 64, 64
#: Tokens of a training shard, about.
SHARD_TOKENS = 400_000
#: Words that occur so often, and at least once in so many tokens, are one step of the neural model: no more than these.
STEP_TIMES, STEPS = 10, 1_000_000
#: Ids of one text that are scored at a time; windows overlap across the cut.
STRETCH = 1_000_000


@dataclass
class Shared:
    """What scoring tasks need: bounded by the vocabulary and by FREQUENT."""

    key: str
    path: str
    end_id: int
    n_ids: int
    words: list[bytes]
    n_steps: int
    vocabulary: object
    logs: object
    train_tokens: int
    types: int
    ends: int


class _Codes:
    """Word -> its place among shared.words (steps come first), and the subword ids of other words, of which some are kept."""

    def __init__(self, shared: Shared):
        from .tokenize import encoder

        self.code = {w: i for i, w in enumerate(shared.words)}
        self.encode, self.spelt = encoder(shared.path).word, {}

    def spell(self, word: bytes) -> bytes:
        out = self.spelt.get(word)
        if out is None:
            out = self.encode(word.decode("utf-8", "replace"))
            if len(self.spelt) < 200_000:
                self.spelt[word] = out
        return out


_codes: dict[str, _Codes] = {}


def _table(shared: Shared) -> _Codes:
    """One table a worker process; that of an earlier call is let go."""
    if shared.key not in _codes:
        _codes.clear()
        _codes[shared.key] = _Codes(shared)
    return _codes[shared.key]


def _words(texts, shared: Shared):
    """Of all texts end to end: words, their codes (-1: not frequent), and the text of each."""
    import numpy as np
    from itertools import chain, repeat

    found = [t.lower().split() for t in texts]
    flat = list(chain.from_iterable(found))
    code = np.fromiter(map(_table(shared).code.get, flat, repeat(-1)), np.int64, len(flat))
    return flat, code, np.repeat(np.arange(len(found)), list(map(len, found)))


def _sequences(flat, code, text, n_texts: int, shared: Shared):
    """Of each text: the end as the symbol given at first, its symbols, and the end. A step is one symbol, other words
    are their subword ids."""
    import numpy as np

    step = (code >= 0) & (code < shared.n_steps)
    other = np.flatnonzero(~step)
    spell = _table(shared).spell
    parts = [spell(flat[i]) for i in other.tolist()]
    size = np.ones(len(code), np.int64)
    size[other] = [len(x) // 4 for x in parts]
    length = np.bincount(text, size, n_texts).astype(np.int64) + 2
    ends = np.cumsum(length)
    place = np.cumsum(size) - size + 1 + 2 * text  # an end before and one after each earlier text
    out = np.full(ends[-1] if n_texts else 0, shared.end_id, np.int64)
    out[place[step]] = shared.n_ids + code[step]
    n = size[other]
    out[np.repeat(place[other], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.frombuffer(b"".join(parts), "<u4")
    return np.split(out, ends[:-1]) if n_texts else []


def _count_words(it):
    import pyarrow as pa
    from collections import Counter

    counts: Counter = Counter()

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return made

    for b in it:
        for t in b.column(0).to_pylist():
            counts.update(t.lower().split())
            if len(counts) > 500_000:
                yield batch()
    yield batch()


def _pairs(path: str, n_ids: int):
    """Pairs of ids within words; n_ids before the first and after the last id of a word."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        from .tokenize import encoder

        spell, edge = encoder(path).word, np.array([n_ids], "<u4").tobytes()
        for b in it:
            parts = [spell(w.decode("utf-8", "replace")) + edge for w in b.column(0).to_pylist()]
            if not parts:
                continue
            n = np.repeat(b.column(1).to_numpy(), [len(p) // 4 for p in parts])
            flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
            before = np.concatenate([[n_ids], flat[:-1]])
            key, where = np.unique(before * (n_ids + 1) + flat, return_inverse=True)
            total = np.bincount(where, n, len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key // (n_ids + 1), pa.int32()), pa.array(key % (n_ids + 1), pa.int32()), pa.array(total, pa.int64())], ["a", "b", "n"])

    return batches


def _company(shared):
    """How often each leader and each symbol with a class of its own share a text, by whole words that are steps."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        from . import causal

        s = shared.value
        v = s.vocabulary
        total = np.zeros((causal.LEADERS, causal.OWN_CLASS))
        for b in it:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 200):
                some = texts[at : at + 200]
                _, code, text = _words(some, s)
                step = (code >= 0) & (code < s.n_steps)
                x, text = s.n_ids + code[step], text[step]
                own, lead = v.own[x], v.leader[x]
                o = np.bincount(text[own >= 0] * causal.OWN_CLASS + own[own >= 0], minlength=len(some) * causal.OWN_CLASS).reshape(len(some), -1)
                o = o / np.maximum(o.sum(1, keepdims=True), 1)
                text, lead = text[lead >= 0], lead[lead >= 0]
                here = np.zeros(causal.LEADERS, bool)
                here[lead] = True
                row = np.cumsum(here) - 1
                met = np.bincount(row[lead] * len(some) + text, minlength=int(here.sum()) * len(some)).reshape(-1, len(some))
                total[here] += np.minimum(met, 5).astype(float) @ o
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.float64())], ["k", "x"])

    return batches


def _learn_vocabulary(shared: Shared, pairs: DataFrame, step_counts: list[int], n_docs: int, texts: DataFrame) -> None:
    """Fills in shared.vocabulary. The tables that reach the driver have at most so many entries as there are pairs of
    leaders and own classes, of slots and classes, and of classes and ids, however large the corpus is."""
    import numpy as np

    from . import causal
    from .tokenize import encoder

    spark, n_ids, n = pairs.sparkSession, shared.n_ids, shared.n_ids + len(step_counts)
    counts, first, last = np.zeros(n), np.zeros(n), np.zeros(n)
    inside = pairs.where(F.col("b") < n_ids).groupBy("b").agg(F.sum("n").alias("n"))
    for sums, out in ((inside, counts), (pairs.where(F.col("a") == n_ids).select("b", "n"), first), (pairs.where(F.col("b") == n_ids).select("a", "n"), last)):
        for r in sums.collect():
            if r[0] < n_ids:
                out[r[0]] = r[1]
    for x in (counts, first, last):
        x[shared.end_id] += n_docs
        x[n_ids:] = step_counts
    starts = first > 0
    v = shared.vocabulary = causal.Vocabulary(counts, starts, n_ids)

    sent = spark.sparkContext.broadcast(shared)
    got = texts.mapInArrow(_company(sent), "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    sent.unpersist()
    company = np.zeros(causal.LEADERS * causal.OWN_CLASS)
    if got.num_rows:
        company[got.column(0).to_numpy()] = got.column(1).to_numpy()
    spell = encoder(shared.path).word
    begin = np.concatenate([np.arange(n_ids), np.array([np.frombuffer(spell(w.decode("utf-8", "replace"))[:4], "<u4")[0] for w in shared.words[: shared.n_steps]], np.int64)]).astype(np.int64)
    v.group(company.reshape(causal.LEADERS, -1)[: min(causal.LEADERS, n)], begin)

    kinds = F.broadcast(spark.createDataFrame([(i, int(v.slot[i]), int(v.klass[i])) for i in range(n_ids)], "id int, slot int, klass int"))
    inner = pairs.where((F.col("a") < n_ids) & (F.col("b") < n_ids))
    inner = inner.join(kinds.select(F.col("id").alias("a"), F.col("slot").alias("slot_a"), F.col("klass").alias("class_a")), "a").join(kinds.select(F.col("id").alias("b"), F.col("klass").alias("class_b")), "b")
    slot_class = np.zeros((causal.SLOTS + causal.CLASSES, causal.CLASSES))
    class_id = np.zeros((causal.CLASSES, n_ids))
    for keys, out in ((("slot_a", "class_b"), slot_class), (("class_a", "b"), class_id)):
        got = inner.groupBy(*keys).agg(F.sum("n").alias("n")).toArrow()
        if got.num_rows:
            out[got.column(0).to_numpy(), got.column(1).to_numpy()] = got.column(2).to_numpy()
    opening = np.bincount(v.klass, first, causal.CLASSES)
    slot_class += np.bincount(v.slot, last, len(slot_class))[:, None] * (opening / max(opening.sum(), 1))[None]
    v.learn(slot_class, class_id)


def _train(shared, weights, round_: int):
    """Rows come by shard. Sums over the shards of weights and tokens."""

    def batches(it):
        import numpy as np
        import pyarrow as pa

        from . import causal

        s = shared.value
        total, tokens = 0, 0

        def learn(p, opt, texts):
            n = 0
            for slots, at, classes, _, _ in causal.batches(_sequences(*_words(texts, s), len(texts), s), s.vocabulary, TRAIN_WINDOWS):
                if len(at):
                    opt.update(causal.step(p, s.vocabulary.prior, slots, at, classes)[1], 1 / (1 + 0.01 * opt.t) ** 0.5)
                    n += len(at)
            return n

        def closed():
            nonlocal total, tokens
            n = seen + (learn(p, opt, held) if held else 0)
            if n:
                total, tokens = total + causal.flatten(p) * np.float64(n), tokens + n

        shard = None
        for b in it:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != shard:
                    if shard is not None:
                        closed()
                    shard, seen, held, size = k, 0, [], 0
                    p = causal.unflatten(weights.value)
                    opt = causal.Adam(p, RATE / (1 + round_))
                held.append(t)
                size += len(t)
                if size > 200_000:
                    seen, held, size = seen + learn(p, opt, held), [], 0
        if shard is not None:
            closed()
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array(np.concatenate([[tokens], total]), pa.float64())], ["k", "x"])

    return batches


def _trained(spark: SparkSession, texts: DataFrame, shared, train_tokens: int):
    """The averaged weights after all rounds. texts: _text, _h (uniform in 0..1 by row); shared: as a broadcast."""
    import numpy as np

    from . import causal

    flat = causal.flatten(causal.fresh())
    # small corpora are gone through several times
    passes = max(1, min(PASSES, round(TRAIN_TOKENS / max(train_tokens, 1))))
    shards = max(1, round(train_tokens / ROUNDS / SHARD_TOKENS))
    parts = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = texts.select((F.col("_h") * ROUNDS).cast("int").alias("_round"), F.pmod(F.xxhash64("_h"), F.lit(shards)).alias("_shard"), "_h", "_text")
    dealt = materialize(dealt, "training")
    for r in range(ROUNDS * passes):
        some = dealt.where(F.col("_round") == r % ROUNDS).repartition(parts, "_shard").sortWithinPartitions("_shard", "_h", "_text").select("_shard", "_text")
        weights = spark.sparkContext.broadcast(flat)
        sums = some.mapInArrow(_train(shared, weights, r), "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).toArrow()
        weights.unpersist()
        if sums.num_rows:
            k, x = sums.column(0).to_numpy(), sums.column(1).to_numpy()
            flat = np.zeros(len(x) - 1)
            flat[k[k >= 0]] = x[k >= 0] / x[k == -1][0]
            flat = flat.astype(np.float32)
    return flat


def _score(shared, weights, n_keys: int):
    def batches(it):
        import numpy as np
        import pyarrow as pa
        from math import log

        from . import causal

        s = shared.value
        p, v = causal.unflatten(weights.value), s.vocabulary
        floor, end = log10(s.train_tokens + s.types + 1), log10(s.ends + 1)
        names = ["n_tokens", "n_known", "part", "score", "rare"]

        def scored(seqs):
            """Log10 of each sequence's probability; long ones are cut into stretches that overlap by a window."""
            pieces, owner = [], []
            for k, x in enumerate(seqs):
                if len(x) <= STRETCH:
                    pieces.append((x, 0)), owner.append(k)
                else:
                    for a in range(0, len(x) - 1, STRETCH):
                        lead = min(a, causal.OVERLAP)
                        pieces.append((x[a - lead : a + STRETCH + 1], lead)), owner.append(k)
            out = np.zeros(len(seqs))
            plain = [k for k, (_, lead) in enumerate(pieces) if not lead]
            for slots, at, classes, share, which in causal.batches([pieces[k][0] for k in plain], v, SCORE_WINDOWS):
                if len(at):
                    out += np.bincount(np.array(owner)[np.array(plain)[which]], causal.log_probs(p, v.prior, slots, at, classes) + share, len(out))
            for k, (x, lead) in enumerate(pieces):
                if lead:  # the first targets were scored at the end of the stretch before
                    done = 0
                    for slots, at, classes, share, which in causal.batches([x], v, SCORE_WINDOWS):
                        y = causal.log_probs(p, v.prior, slots, at, classes) + share
                        out[owner[k]] += y[max(0, lead - done) :].sum()
                        done += len(y)
            return out / log(10)

        for b in it:
            texts = b.column(n_keys).to_pylist()
            n_tokens, n_known, part, score, rare = [], [], [], [], []
            for at in range(0, len(texts), 200):
                n = len(texts[at : at + 200])
                flat, code, text = _words(texts[at : at + 200], s)
                score.append(scored(_sequences(flat, code, text, n, s)))
                known, words = code >= 0, np.bincount(text, minlength=n)
                n_tokens.append(words + 1)
                n_known.append(np.bincount(text[known], minlength=n) + (s.ends > 0))
                part.append(np.bincount(text[known], s.logs[code[known]], n) + end - floor * (words + 1))
                strange: list[list[bytes]] = [[] for _ in range(n)]
                for i in np.flatnonzero(~known).tolist():
                    strange[text[i]].append(flat[i])
                rare.extend(strange)
            joined = lambda parts, kind: pa.array(np.concatenate([np.zeros(0), *parts]).astype(kind))
            made = [joined(n_tokens, np.int64), joined(n_known, np.int64), joined(part, np.float64), joined(score, np.float64), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], *made], [*b.schema.names[:n_keys], *names])

    return batches


def lm_scores(docs: DataFrame, tokenizer: str, carry: list[str], train: Column, n_ids: int = 50_257, end_id: int = 50_256, text_col: str = "text") -> DataFrame:
    """A struct _doc of the carried columns, n_tokens, n_known, train_tokens long, base_score and score double.

    train: whether a row may be learnt from. tokenizer: a byte-level .json file of n_ids ids, of which end_id ends a
    text. Tokens are words, lower-cased in A-Z, and an end. score is the neural model's log10 probability of the words'
    ids and the end. A null text is an empty one: its end alone is scored. Without training rows every word is unknown,
    and the neural model is its starting point. Repeated rows stay repeated. An empty table gives an empty result.
    """
    import numpy as np

    spark = docs.sparkSession
    rows = docs.select(F.struct(*carry).alias("_doc"), F.coalesce(train, F.lit(False)).alias("_train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))
    learn = rows.where("_train")
    words = materialize(learn.select("_text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    n_docs = learn.count()
    train_tokens, types = (total["n"] or 0) + n_docs, total["types"] + (n_docs > 0)
    frequent = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") * FREQUENT >= train_tokens).collect()}
    least = max(STEP_TIMES, -(-train_tokens // STEPS))
    ordered = sorted(frequent, key=lambda w: (frequent[w] < least, w))  # steps come first
    n_steps = sum(n >= least for n in frequent.values())
    # the other words are spelt, and show how words that are new are spelt
    pairs = materialize(words.where(F.col("n") < least).mapInArrow(_pairs(tokenizer, n_ids), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    logs = np.log10(np.array([frequent[w] for w in ordered], float) + 1)
    shared = Shared(uuid.uuid4().hex, tokenizer, end_id, n_ids, ordered, n_steps, None, logs, train_tokens, types, n_docs)
    _learn_vocabulary(shared, pairs, [frequent[w] for w in ordered[:n_steps]], n_docs, learn.select("_text"))
    chosen = learn.withColumn("_h", F.pmod(F.xxhash64(F.to_json("_doc"), "_text"), F.lit(1_000_003)) / 1_000_003)
    sent = spark.sparkContext.broadcast(shared)  # once: training and scoring differ in the weights alone
    weights = spark.sparkContext.broadcast(_trained(spark, chosen, sent, train_tokens))

    schema = f"_doc {rows.schema['_doc'].dataType.simpleString()}, n_tokens long, n_known long, part double, score double, rare array<binary>"
    scored = materialize(rows.select("_doc", "_text").mapInArrow(_score(sent, weights, 1), schema).withColumn("_row", F.monotonically_increasing_id()), "scored")
    # words that are not frequent meet their counts by shuffle; those never trained on add nothing
    rare = scored.select("_row", F.explode("rare").alias("word"))
    rare = rare.join(words.where(F.col("n") * FREQUENT < train_tokens), "word").groupBy("_row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("known"))
    out = scored.drop("rare").join(rare, "_row", "left")
    return out.select(
        "_doc", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    out = lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"], ~held)
    return out.select("_doc.doc_id", (fold(F.col("_doc.doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
