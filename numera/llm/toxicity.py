"""Toxicity by weak supervision.

Many voters look at a text: lexicons written by hand, lexicons learnt from labelled texts, and patterns. A generative
model of the votes estimates how often each voter fires on toxic and on other texts, and how votes depend on each other
beyond that; its posterior gives soft labels. A linear classifier over the lexicon entries and votes is trained on them.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table
from .tokenize import release

#: Words that insult, by voter.
LEXICONS = (
    "idiot idiots moron morons imbecile cretin fool foolish stupid dumb dimwit halfwit",
    "loser losers pathetic worthless useless failure nobody clown clowns joke",
    "scum trash garbage vermin filth filthy disgusting vile repulsive swine pig rat",
    "hate despise kill die hurt destroy shut bastard jerk creep freak coward liar",
    "dummkopf trottel depp vollidiot blödmann arschloch abschaum versager dreck widerlich idioten hässlich",
    "imbécile crétin connard ordure débile abruti nul salaud pourriture dégoûtant stupide raclure estúpido imbécil basura asqueroso inútil patético escoria tonto cretino payaso miserable",
)
#: Learnt entries are dealt to so many voters, and patterns make up the rest of the 16: at most 2^16 vote patterns.
LEARNT_VOTERS, PATTERNS = 7, 3
VOTERS = len(LEXICONS) + LEARNT_VOTERS + PATTERNS
#: How many times greater the odds of toxic are among texts with a learnt entry than among all.
ODDS = 3
#: Labelled rows that the linear classifier is fitted on, at most; those with the smallest hashes.
FIT_ROWS = 40_000
#: Distinct entries that a task holds before it hands their counts on.
ENTRIES_HELD = 500_000
#: Rows whose checksum leaves 0 by this are held out: their labels are never looked at.
HELD_OUT = 5
#: Labels up to this number are broadcast.
BROADCAST_LABELS = 1_000_000
#: How sure the label model takes a given label to be.
LABEL_TRUST = 0.98

_WORD = re.compile(r"[^\W\d_]+")
_AGAIN = re.compile(r"[!?]{3,}")


def _entries(text: str) -> set[str]:
    """Words, and the first 4 and 5 letters of longer words with a star."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:4] + "*" for w in found if len(w) > 5} | {w[:5] + "*" for w in found if len(w) > 5}


def _hand_written() -> dict[str, int]:
    return {w: k for k, words in enumerate(LEXICONS) for w in words.split()}


@dataclass
class Model:
    """entries: lexicon entry -> (its place among the classifier's inputs, its voter)."""

    entries: dict[str, tuple[int, int]]
    weights: list[float] | None = None
    bias: float = 0.0

    def look(self, text: str) -> tuple[int, list[int]]:
        """The vote pattern, and the inputs of the classifier that are on (entries first, then votes)."""
        if not text:
            return 0, []
        found = set(_WORD.findall(text.lower()))
        hits = found & self.words
        hits |= ({w[:4] + "*" for w in found if len(w) > 5} | {w[:5] + "*" for w in found if len(w) > 5}) & self.stems
        places = [self.entries[e] for e in hits]
        votes = {v for _, v in places}
        first = VOTERS - PATTERNS
        if len(text) >= 20 and text.isupper():
            votes.add(first)
        if _AGAIN.search(text):
            votes.add(first + 1)
        if len(hits) >= 3:
            votes.add(first + 2)
        return sum(1 << v for v in votes), sorted([p for p, _ in places] + [len(self.entries) + v for v in votes])

    def score(self, text: str) -> float:
        from math import exp

        z = self.bias + sum(self.weights[i] for i in self.look(text)[1])
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))

    def __post_init__(self):
        self.words = {e for e in self.entries if e[-1] != "*"}
        self.stems = {e for e in self.entries if e[-1] == "*"}


def _explode(it):
    """Entry counts of each task, or of each half million distinct entries: pre-aggregated before they are shuffled."""
    import pyarrow as pa
    from collections import Counter

    release()
    every, toxic = Counter(), Counter()

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[e] for e in every], pa.int64())], ["entry", "n", "toxic"])
        every.clear(), toxic.clear()
        return made

    for b in it:
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = _entries(t or "")
            every.update(found)
            if y:
                toxic.update(found)
            if len(every) > ENTRIES_HELD:
                yield batch()
    yield batch()


def learn_entries(labelled: DataFrame) -> list[str]:
    """All entries tied to the label beyond chance, allowing for how many were tried, whatever share of the rows is toxic.
    labelled: toxic 0/1, text."""
    totals = labelled.agg(F.count("*"), F.sum("toxic")).first()
    n, t = totals[0], totals[1] or 0
    if not t or t == n:
        return []
    counts = materialize(labelled.select("toxic", "text").mapInArrow(_explode, "entry string, n long, toxic long").groupBy("entry").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where("toxic >= 3"), "entries")
    tried = counts.count()
    base = t / n
    p = F.col("toxic") / F.col("n")
    part = lambda k, share, of: F.when(k > 0, k * F.ln(share / of)).otherwise(0.0)
    surprise = 2 * (part(F.col("toxic"), p, base) + part(F.col("n") - F.col("toxic"), 1 - p, 1 - base))
    from math import log

    clear = counts.where(p * (1 - base) > ODDS * (1 - p) * base).withColumn("g", F.round(surprise, 6)).where(F.col("g") >= 2 * log(tried + 1))
    return [r["entry"] for r in clear.orderBy(F.desc("g"), "entry").collect()]


def label_model(counts: list[tuple[int, int | None, int]], rounds: int = 100):
    """Posterior of toxic by vote pattern, a dict. counts: (pattern, label or None, rows).

    Expectation-maximisation over a latent class: each voter fires with one rate on toxic and another on other rows. Of
    the covariance of two votes, what the classes do not explain is their correlation; votes that are correlated with
    others count for less.
    """
    import numpy as np

    if not counts:
        return {}
    patterns = np.array([c[0] for c in counts], np.int64)
    votes = ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    n = np.array([c[2] for c in counts], float)
    known = np.array([-1.0 if c[1] is None else float(c[1]) for c in counts])
    given = np.where(known == 1, LABEL_TRUST, 1 - LABEL_TRUST)
    fired = votes.any(1)
    q = np.where(known >= 0, given, np.where(fired, 0.5, 0.02))
    weight = np.ones(VOTERS)
    for _ in range(rounds):
        a, b = n * q, n * (1 - q)
        share = (a.sum() + 1) / (n.sum() + 2)
        on = (votes.T @ a + 0.1) / (a.sum() + 1)
        off = (votes.T @ b + 0.1) / (b.sum() + 10)
        z = np.log(share / (1 - share)) + votes @ (weight * np.log(on / off)) + (1 - votes) @ (weight * np.log((1 - on) / (1 - off)))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        # a given label is one more vote, of known accuracy
        odds = np.where(known == 1, LABEL_TRUST / (1 - LABEL_TRUST), np.where(known == 0, (1 - LABEL_TRUST) / LABEL_TRUST, 1.0))
        new = np.where(known >= 0, new * odds / (new * odds + 1 - new), new)
        # correlations within the classes
        total = n.sum()
        both = (votes * n[:, None]).T @ votes / total
        explained = share * np.outer(on, on) + (1 - share) * np.outer(off, off)
        var = share * on * (1 - on) + (1 - share) * off * (1 - off)
        rho = (both - explained) / np.sqrt(np.outer(var, var) + 1e-12)
        np.fill_diagonal(rho, 0)
        weight = 1 / (1 + np.clip(rho, 0, 1).sum(1))
        done = np.abs(new - q).max() < 1e-6
        q = new
        if done:
            break
    return {(int(p), None if k < 0 else int(k)): float(x) for p, k, x in zip(patterns, known, q)}


def fit_linear(inputs: list[list[int]], targets: list[float], width: int, rounds: int = 400, penalty: float = 1e-3) -> tuple[list[float], float]:
    """Logistic regression on soft labels: weights and bias."""
    import numpy as np

    w, bias = np.zeros(width), -2.0
    if inputs:
        col = np.array([c for x in inputs for c in x], np.int64)
        row = np.repeat(np.arange(len(inputs)), [len(x) for x in inputs])
        y, n = np.array(targets), len(inputs)
        sq, sq_b = np.full(width, 1e-8), 1e-8
        for _ in range(rounds):
            z = bias + np.bincount(row, w[col], n)
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            g, g_b = np.bincount(col, d[row], width) / n + penalty * w * 0.01, d.mean()
            sq, sq_b = sq + g * g, sq_b + g_b * g_b
            w -= 0.5 * g / np.sqrt(sq)
            bias -= 0.5 * g_b / np.sqrt(sq_b)
    return w.tolist(), float(bias)


def _looks(shared):
    def batches(it):
        import pyarrow as pa

        for b in it:
            got = [shared.value.look(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in got], pa.int32()), pa.array([x for _, x in got], pa.list_(pa.int32()))], ["_id", "pattern", "inputs"])

    return batches


def _scores(shared):
    def batches(it):
        import pyarrow as pa

        for b in it:
            made = pa.array([shared.value.score(t or "") for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], [*b.schema.names[:-1], "score"])

    return batches


def _drop(shared, limit):
    def batches(it):
        import pyarrow as pa

        for b in it:
            yield b.filter(pa.array([shared.value.score(t or "") < limit for t in b.column("_text").to_pylist()], pa.bool_()))

    return batches


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model, from all texts and the labels that are not held out. Null labels and ids tell nothing; of several
    labels of one id the largest counts. Without labels of both kinds there are no learnt entries, and the hand-written
    lexicons stand alone."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("toxic"))
    given = materialize(given.where(fold(F.col("_id"), HELD_OUT) != 0), "labels")
    if given.count() <= BROADCAST_LABELS:
        given = F.broadcast(given)
    labelled = rows.join(given, "_id").select("toxic", "text")

    hand = _hand_written()
    learnt = [e for e in learn_entries(labelled) if e not in hand]
    places = {e: (i, v) for i, (e, v) in enumerate(hand.items())}
    places |= {e: (len(hand) + i, len(LEXICONS) + zlib.crc32(e.encode()) % LEARNT_VOTERS) for i, e in enumerate(learnt)}
    model = Model(places)

    looks = materialize(rows.mapInArrow(_looks(spark.sparkContext.broadcast(model)), f"_id {rows.schema['_id'].dataType.simpleString()}, pattern int, inputs array<int>"), "votes")
    marked = looks.join(given, "_id", "left")
    # at most 2^16 patterns and 3 kinds of label
    counts = marked.groupBy("pattern", "toxic").agg(F.count("*").alias("n")).collect()
    posterior = label_model([(r["pattern"], r["toxic"], r["n"]) for r in counts])
    sample = marked.where("toxic IS NOT NULL").orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS).select("pattern", "toxic", "inputs").collect()
    model.weights, model.bias = fit_linear([r["inputs"] for r in sample], [posterior[(r["pattern"], r["toxic"])] for r in sample], len(places) + VOTERS)
    if not sample:  # no labels: a vote of a hand-written lexicon decides
        model.weights = [4.0 if i < len(hand) else 0.0 for i in range(len(places) + VOTERS)]
    return model


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """A struct _doc of the carried columns and score double, from 0 to 1; higher: more likely toxic.

    Only the text is an input of the score. A null text scores as an empty one does, by the bias alone. Repeated rows
    stay repeated and score alike. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.struct(*carry).alias("_doc"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_scores(shared), f"_doc {rows.schema['_doc'].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: float = 0.5) -> DataFrame:
    """docs without those that score limit or more; see toxicity()."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col))
    rows = docs.select(F.struct("*").alias("_doc"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_drop(shared, limit), rows.schema).select("_doc.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("_doc.doc_id", "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), HELD_OUT) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
