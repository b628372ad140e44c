"""Collocations and spelling variants against brute force, the quality classifier by held-out accuracy and its algebra."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from numera.llm import collocations, quality_classifier, spelling

DOCS = "doc_id long, text string, lang string"


def brute_variants(words):
    near = defaultdict(set)
    for a in words:
        for i in range(len(a)):
            b = a[:i] + a[i + 1 :]
            if b in words:
                near[a].add(b), near[b].add(a)
    holes = defaultdict(set)
    for a in words:
        for i in range(len(a)):
            holes[a[:i], a[i + 1 :]].add(a)
    for group in holes.values():
        for a in group:
            near[a] |= group - {a}
    form = {a: min(near[a], key=lambda b: (-words[b], b)) if near[a] else None for a in words}
    form = {a: b if b and words[b] >= 2 * words[a] else None for a, b in form.items()}
    out = {}
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, words[a], len(near[a]), words[form[a]] if form[a] else None)
    return out


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def test_spelling_variants(spark):
    rng = random.Random(5)
    stock = ["harbour", "harbor", "colour", "color", "éclair", "eclair", "Straße", "letter", "leter", "lettter", "aaaaa", "aaaaaa", "aaaab"]
    stock += ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(stock, k=200)), "en") for i in range(40)] + [(None, "harbour " * 9, None), (1, None, None), (2, "", "en"), (3, "harbour " * 9, "en"), (3, "harbour " * 9, "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("word", "n", "_id", "node")})
    words = brute_words([r[:2] for r in rows])
    got = {r[0]: tuple(r)[1:] for r in spelling.variants(spelling.words_of(docs)).collect()}
    assert got == brute_variants(words)
    assert spelling.variants(spelling.words_of(docs.limit(0))).count() == 0


def test_long_words_meet_by_keys(spark):
    rng = random.Random(6)
    words = {}
    for size in (31, 32, 33, 34, 60, 500):
        base = "".join(rng.choice("ab") for _ in range(size))
        words[base] = 40
        for _ in range(5):
            k = rng.randrange(size)
            words.setdefault(base[:k] + base[k + 1 :], rng.randint(3, 30))
            words.setdefault(base[:k] + "c" + base[k + 1 :], rng.randint(3, 30))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {r[0]: tuple(r)[1:] for r in spelling.variants(df).collect()} == brute_variants(words)


def by_sql(rows, first, least):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return set(db.sql(collocations.OP11_SQL.replace("f >= 100", f"f >= {least}").replace("rank <= 2000", f"rank <= {first}")).fetchall())


@pytest.mark.parametrize(("first", "least"), [(2000, 5), (7, 5)])
def test_collocations(spark, first, least, monkeypatch):
    rng = random.Random(7)
    stock = "the of and to a mill river quiet stone harbour öl é naïve x y".split()
    weights = [60, 40, 30, 20, 15, 6, 5, 4, 3, 3, 2, 2, 2, 1, 1]
    fixed = ["new york city hall", "as well as", "the quick brown fox jumps over", "a a a a a a a"]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(stock, weights, k=rng.randint(1, 12))) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(20)]
        rows.append((i, "".join(p.title() + rng.choice([" ", ", ", ".\n", "\t", ";;", "  ", ":x!"]) for p in parts), rng.choice(["en", "en", "fr", None])))
    rows += [(None, "As Well As", "en"), (1, None, "en"), (2, "", None), (3, " . ", "de")]
    monkeypatch.setattr(collocations, "CHUNK", 50)
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("phrase", "n", "total", "rank")})
    got = [tuple(r) for r in collocations.collocations(docs, first=first, least=least).collect()]
    assert len(got) == len(set(got)) and set(got) == by_sql(rows, first, least)


def test_collocations_settle_before_the_frontier_is_used_up(spark, monkeypatch):
    rows = [(i, ("rare pair. " * 3 + "common word " * 400), "en") for i in range(4)]
    seen = []
    grown = collocations._grown
    monkeypatch.setattr(collocations, "_grown", lambda m, shared: seen.append(m) or grown(m, shared))
    got = collocations.collocations(spark.createDataFrame(rows, DOCS), first=1, least=10).collect()
    assert [r["phrase"] for r in got] == ["rare pair"] and seen.count(2) == 1
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_a_full_bitmap_costs_no_result(spark, monkeypatch):
    rows = [(i, "one two three four. five two three six", "en") for i in range(6)]
    docs = spark.createDataFrame(rows, DOCS)
    right = set(map(tuple, collocations.collocations(docs, least=3).collect()))
    monkeypatch.setattr(collocations, "BITS_LEAST", 6)
    monkeypatch.setattr(collocations, "BITS_MOST", 6)
    assert set(map(tuple, collocations.collocations(docs, least=3).collect())) == right == by_sql(rows, 2000, 3)


def test_quality_classifier(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice("stone river harbour quiet engine mill lamp cloud".split()) for _ in range(rng.randint(5, 200))) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "buy###", "a|b", "%%%%"]) for _ in range(rng.randint(5, 200)))
    rows = [(i, good() if i % 3 else bad(), "en") for i in range(400)] + [(900, None, "en"), (901, "", "en"), (None, "no id", "en"), (902, "é" * 200_000, "en"), (3, "twice", "en")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("score", "_x", "label", "quality")})
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = [(r["doc_id"], r["score"]) for r in quality_classifier.quality(docs, labels, ["doc_id"]).select("_doc.doc_id", "score").collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    wrong = [i for i, s in got if i is not None and i < 400 and i != 3 and zlib.crc32(str(i).encode()) % 4 == 2 and (s >= 0.7) != (i % 3 > 0)]
    assert not wrong
    one = quality_classifier.quality(docs, labels.where("quality = 1"), ["doc_id"])
    assert {r["score"] for r in one.collect()} == {1.0}
    assert {r["score"] for r in quality_classifier.quality(docs, labels.limit(0), ["doc_id"]).collect()} == {0.5}
    assert quality_classifier.quality(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_discriminant_is_the_difference_of_two_normal_densities():
    rng = np.random.default_rng(9)
    p = len(quality_classifier.STATISTICS)
    x = {k: rng.normal(k, 1 + k, (300, p)) * 1024 for k in (0, 1)}
    whole = {k: np.round(v).astype(np.int64) for k, v in x.items()}
    m = quality_classifier.discriminant({k: (len(v), v.sum(0), (v.T @ v).ravel()) for k, v in whole.items()})
    z = (whole[1][:5] / 1024 - m.centre) / m.scale
    far = []
    for mean, factor in zip(m.means, m.factors, strict=True):
        cov = np.linalg.inv(factor.T @ factor)
        d = z - mean
        far.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(m.difference(whole[1][:5]), far[1] - far[0])


def test_passes_over_the_chunks_see_frequent_words_alone(spark, monkeypatch):
    """Words that are not frequent are dropped once, not hashed and looked up again in each pass."""
    seen, plain = {}, collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, label: seen.setdefault(label, plain(df, label)))
    monkeypatch.setattr(collocations, "CHUNK", 60)
    docs = spark.createDataFrame([(i, f"red apple rare{i}a rare{i}b green pear. red apple green", "en") for i in range(40)], "doc_id long, text string, lang string")
    collocations.collocations(docs, least=20)
    rows = seen["usable"].collect()
    texts = []
    for r in rows:
        words, codes = [".", *bytes(r["words"]).decode().split(" ")], np.frombuffer(bytes(r["codes"]), "<i4")
        assert codes[0] == codes[-1] == 0 and len(codes) < 70
        texts.append(" ".join(words[k] for k in codes))
    assert len(rows) > 2 and {w for t in texts for w in t.split()} == {".", "red", "apple", "green", "pear"}
    assert sum(t.count("red apple . green pear .") for t in texts) == 40 and sum(t.count(". red apple green .") for t in texts) == 40
