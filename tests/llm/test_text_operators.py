"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing names."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from numera.llm import decontamination, licenses, packing, quality_rules, scoring, simhash, token_counts, tokenize, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("the of reader stone harbour willow engine quiet anders lamp öffnen été mill river cloud seven gate".split()) + rng.choice(["", "", "", ",", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long = prose(1, 30_000)
    given = ["", None, "  \n\t ", "one", "Hello <|endoftext|> there", prose(2, 300), prose(2, 300), prose(3, 2_500), long, "naïve 　 ключ 鍵 \x0b\x0c x", "a\n\nb \n c", "<|end", "ünï ©®½ ²x"]
    return [(i, t, None if i == 3 else f"s{i % 3}") for i, t in enumerate(given)] + [(5, prose(2, 300), "s2"), (None, "no id", "s1")]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def clashing(docs):
    names = ["n", "fp", "piece", "length", "score", "_text", "_doc", "_row", "_id", "t", "digest", "n_tokens", "word", "kept", "_host", "segment", "root"]
    return docs.withColumns({n: F.lit("x") for n in names})


def test_encoder_agrees_with_the_library(texts, library):
    e = tokenize.encoder(BPE)
    assert e.units is not None
    for _, t, _ in texts:
        assert np.frombuffer(e.ids(t or ""), "<u4").tolist() == library(t)
    for c in map(chr, range(1, 0x250)):
        for before in ("", "a", "1", " ", "\n", "!"):
            s = f"{before}{c}b 1"
            assert np.frombuffer(e.ids(s), "<u4").tolist() == library(s), repr(s)


def test_token_counts(spark, docs, empty, texts, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all counts are stored
        got = token_counts.token_counts(clashing(docs), BPE, cache).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == sorted((str(i), len((t or "").encode()), len(library(t))) for i, t, _ in texts)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in texts})
    assert token_counts.token_counts(empty, BPE).count() == 0


def test_packing(docs, empty, texts, library):
    got = packing.pack(clashing(docs), BPE, keep_ids=True).collect()
    want = []
    for i, t, _ in texts:
        ids = [*library(t), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(empty, BPE).count() == 0


def test_supersteps_are_best_fit():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.choice([7, 20, 100])
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 200))), reverse=True)
        intervals, made = packing.supersteps(dict(Counter(sizes)), capacity)
        gaps: list[int] = []
        for s in sizes:  # one by one
            fits = [g for g in gaps if g >= s]
            g = min(fits) if fits else capacity
            if fits:
                gaps.remove(g)
            gaps.append(g - s)
        assert made == len(gaps)
        used = Counter()
        for size, lo, hi, each, first, off in intervals:
            for r in range(lo, hi):
                used[first + (r - lo) // each] += size
        assert sum(used.values()) == sum(sizes) and max(used.values()) <= capacity
        assert sorted(capacity - u for u in used.values()) == sorted(gaps)


def test_license_scan(spark, docs, empty):
    cases = [
        ("Under the GNU General Public License, version 3 or later", ["gpl"], {"gpl", "gpl-3-or-later"}),
        ("MIT-License mit license", ["mit", "mit"], {"mit"}),
        ("Apache License 2.0 (apache license)", ["apache", "apache"], {"apache", "apache-2.0"}),
        ("(c) CC BY-SA 4.0 International", ["cc-by"], {"cc-by", "cc-by-sa-4.0"}),
        ("a licensed driver of the commons", [], set()),
    ]
    got = {r["_doc"]["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "doc_id long, text string"), ["doc_id"]).collect()}
    for i, (_, base, labels) in enumerate(cases):
        assert [p["label"] for p in got[i]["base"]] == base
        assert {p["label"] for p in got[i]["base"]} | {p["label"] for p in got[i]["found"]} == labels
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = licenses.license_scan(clashing(docs), ["doc_id", "text"]).collect()
    assert all(r["n_words"] == len(words.findall((r["_doc"]["text"] or "").translate(lower))) for r in rows) and len(rows) == docs.count()
    assert licenses.license_scan(empty, ["doc_id"]).count() == 0 and len(licenses.rules()) > 200


def test_contained_places_are_suppressed():
    keep = licenses.Scanner.resolve([(60, 0, 5, "long", 0.9), (40, 1, 3, "short", 0.5), (60, 4, 8, "other", 0.9), (70, 2, 4, "strong", 0.9)])
    assert [k[0] for k in keep] == ["long", "strong", "other"]


def test_simhash(spark, empty):
    base = prose(7, 400).split()
    rows = [(i, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for i, k in enumerate(range(0, 400, 40), 100)]
    rows += [(3, " ".join(base)), (50, " ".join(base)), (50, " ".join(base)), (1, None), (2, " "), (None, "alone in here"), (7, "A b"), (8, "a B")]
    rows += [(200 + i, prose(100 + i, 50 + i)) for i in range(40)]
    got = simhash.near_duplicates(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(got) == len(rows)
    fp = {t: simhash._fingerprint((t or "").encode(), 4) & (2**64 - 1) for _, t in rows}
    ids = {}
    for i, t in rows:
        reach, new = {fp[t]}, True
        while new:
            new = {f for f in fp.values() if f not in reach and any((f ^ g).bit_count() <= 4 for g in reach)}
            reach |= new
        ids[i] = min((k for k, u in rows if fp[u] in reach and k is not None), default=None)
    for r in got:
        assert r["component_id"] == ids[r["doc_id"]] and len(r["fingerprint"]) == 16
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_is_the_majority_of_shingle_hashes():
    from xxhash import xxh64_intdigest

    words = [w for w in prose(9, 60).encode().lower().split() if w.isascii()]
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash._fingerprint(b" ".join(words).upper(), 4) & (2**64 - 1) == want


def test_thresholds_and_large_buckets(spark, monkeypatch):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for v in list(values)[:60]:
        for _ in range(3):
            x = v
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            values.add(x)
    for total in (1000, 10**9):
        parts = simhash.choose_partitions([v - (1 << 64) if v >> 63 else v for v in values], total)
        assert sorted(b for g, _ in parts for b in g) == sorted(set(b for g, _ in parts for b in g))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    want = {tuple(sorted((a, b))) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    nodes = spark.createDataFrame(signed, "node long").selectExpr("node", "node AS fp")
    pairs = lambda: {tuple(sorted((r["u"], r["v"]))) for r in simhash.near_links(nodes).collect()}
    assert pairs() == want
    monkeypatch.setattr(simhash, "BUCKET", 1)
    monkeypatch.setattr(simhash, "SHARED", 1)
    some = pairs()
    assert some <= want
    root = {v: v for (v,) in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in some:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in want)
    assert simhash.allocate([[0, 1, 9, 9, 9, 9], [0, 2, 3, 9, 9, 9]], 4)[1].count(-1) <= 1


def test_decontamination(spark, empty):
    item = prose(11, 60)
    words = item.split()
    changed = " ".join("swap" if k % 5 == 2 else w for k, w in enumerate(words))
    rows = [(1, f"before {item} after"), (2, prose(12, 50) + " x " + changed), (3, prose(13, 200)), (4, None), (5, ""), (6, " ".join(words[20:40])), (7, "some short stub here now"), (1, f"before {item} after"), (8, " ".join(words[:9]))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame([(10, item.upper()), (11, "short stub here now"), (12, None), (13, "some short stub here now"), (14, "")], "item_id long, text string")
    got = sorted((r["_doc"]["doc_id"], r["item_id"], r["n_words"]) for r in decontamination.overlaps(docs, bench, ["doc_id"]).collect())
    n = len(re.findall(r"[^\W_]+", item.lower()))
    assert [g for g in got if g[0] == 1] == [(1, 10, n)] * 2 and (6, 10, 20) in got and (7, 13, 5) in got
    assert [g[0] for g in got] == [1, 1, 2, 6, 7] and [g for g in got if g[0] == 2][0][2] >= n - 4
    assert sorted(r["doc_id"] for r in decontamination.without_overlaps(docs, bench).collect()) == [3, 4, 5, 8]
    assert decontamination.overlaps(empty, bench, ["doc_id"]).count() == 0
    assert decontamination.without_overlaps(docs, bench.limit(0)).count() == len(rows)


def test_seeds_survive_two_substitutions():
    b = decontamination.Benchmark([("k", prose(21, 12))])
    words = prose(21, 12).split()
    for i in range(12):
        for j in range(i + 1, 12):
            x = list(words)
            x[i], x[j] = "aaa", "bbb"
            found = b.overlaps("lead in " + " ".join(x) + " lead out")
            core = [k for k in range(12) if k not in (i, j)]
            assert bool(found) == (core[-1] - core[0] + 1 >= 12), (i, j)


def test_quality(spark, docs, empty, texts):
    rows = [(100 + i, "again and again the same five words " * 4, "bad") for i in range(30)] + [(200, prose(31, 80), "bad"), (201, prose(32, 80), None), (202, prose(33, 80), "s1"), (203, "#a %b &c " * 5 + prose(34, 5), "s1")]
    all_docs = clashing(docs.unionByName(spark.createDataFrame(rows, DOCS)))
    got = quality_rules.host_quality(all_docs, ["doc_id", "text", "source"], host_limit=0.8).collect()
    assert len(got) == len(rows) + len(texts)
    for r in got:
        t = r["_doc"]["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = len(w)
        windows = Counter(tuple(w[i : i + 5]) for i in range(n - 4))
        covered = {i + k for i in range(n - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (n < 10 or 100 * len(covered) > 20 * n)
        assert not (r["base_failed"] and r["kept"])
    kept = {r["_doc"]["doc_id"]: r["kept"] for r in got}
    assert not kept[200] and kept[201] and kept[202] and not kept[203]
    assert set(quality_rules.kept_documents(all_docs).columns) == set(all_docs.columns)
    assert quality_rules.host_quality(empty, ["doc_id"]).count() == 0


DOCS_3 = "doc_id long, text string, source string"


def test_toxicity(spark, empty):
    rng = random.Random(4)
    bad = ["zorbak", "quvenol", "idiot"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        t = prose(1000 + i, 40).split()
        for _ in range(3 if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        rows.append((i, " ".join(t)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(toxic)))
    labels += [(None, 1), (5, None), (0, 1)]
    docs = clashing(spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "idiot")], "doc_id long, text string"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["_doc"]["doc_id"]: r["score"] for r in toxicity.toxicity(docs, marks, ["doc_id"]).collect()}
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001] < 0.5
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert set(toxicity.without_toxic(docs, marks).columns) == set(docs.columns)
    assert toxicity.toxicity(empty, marks, ["doc_id"]).count() == 0
    alone = {r["_doc"]["doc_id"]: r["score"] for r in toxicity.toxicity(docs, marks.limit(0), ["doc_id"]).collect()}
    assert alone[None] > 0.5 > alone[1000]


def test_label_model_finds_accurate_voters():
    rng = random.Random(8)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.2
        votes = [rng.random() < (0.8 if y else 0.03) for _ in range(3)] + [rng.random() < 0.3]
        counts[sum(1 << k for k, v in enumerate(votes) if v), (int(y) if rng.random() < 0.1 else None)] += 1
    post = toxicity.label_model([(p, y, n) for (p, y), n in counts.items()])
    assert post[(0b0111, None)] > 0.95 and post[(0, None)] < 0.1 and abs(post[(0b1000, None)] - post[(0, None)]) < 0.1


def test_lm_scores(spark, empty):
    rows = [(i, prose(3000 + i, 60)) for i in range(120)] + [(500, None), (501, ""), (500, None), (502, "unseenword " * 3), (503, prose(77, 4000))]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = scoring.lm_scores(docs, BPE, ["doc_id"], train).collect()
    assert len(got) == len(rows)
    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in learn for w in (t or "").lower().split())
    c[None] = len(learn)
    n, v = sum(c.values()), len(c)
    text = dict(rows)
    for r in got:
        w = [*(text[r["_doc"]["doc_id"]] or "").lower().split(), None]
        assert r["n_tokens"] == len(w) and r["train_tokens"] == n and r["n_known"] == sum(c[x] > 0 for x in w)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert scoring.lm_scores(empty, BPE, ["doc_id"], F.lit(True)).count() == 0
    assert scoring.lm_scores(docs, BPE, ["doc_id"], F.lit(False)).where("n_known > 0").count() == 0


def test_each_token_is_scored_once_and_gradients_are_right():
    from numera.llm import causal as M

    lengths = np.array([1, 2, 33, 34, 100, 64, 1000])
    start, can, done, which = M.windows(lengths)
    seen = Counter()
    base = np.cumsum(lengths) - lengths
    for s, c, d, k in zip(start, can, done, which):
        for j in range(d, M.WINDOW):
            if j + 1 < c:
                seen[k, s - base[k] + j + 1] += 1
    assert seen == {(k, t): 1 for k, n in enumerate(lengths) for t in range(1, n)}

    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in M.fresh().items()}
    slots, prior = rng.integers(0, 50, (2, M.WINDOW)), rng.standard_normal((M.SLOTS + M.CLASSES, M.CLASSES))
    at, y = np.arange(2 * M.WINDOW), rng.integers(0, M.CLASSES, 2 * M.WINDOW)
    _, g = M.step(p, prior, slots, at, y)
    for k, i in (("qkv", (3, 5)), ("qkv", (2, 20)), ("qkv", (1, 40)), ("out", (1, 2)), ("up", (0, 3)), ("last", (2, 7)), ("place", (4, 1))):
        eps = 1e-5
        p[k][i] += eps
        up = M.step(p, prior, slots, at, y)[0]
        p[k][i] -= 2 * eps
        down = M.step(p, prior, slots, at, y)[0]
        p[k][i] += eps
        assert abs((up - down) / (2 * eps) - g[k][i]) < 1e-4, (k, i)


def test_model_probabilities_sum_to_one():
    from numera.llm import causal as M

    rng = np.random.default_rng(2)
    n_ids, n = 300, 420
    counts, starts = rng.integers(0, 500, n).astype(float), np.concatenate([rng.random(n_ids) < 0.5, np.ones(n - n_ids, bool)])
    v = M.Vocabulary(counts, starts, n_ids)
    v.group(rng.random((n, M.OWN_CLASS)), np.concatenate([np.arange(n_ids), rng.integers(0, n_ids, n - n_ids)]))
    v.learn(rng.integers(0, 9, (M.SLOTS + M.CLASSES, M.CLASSES)).astype(float), np.where(starts[None, :n_ids], 0, rng.integers(0, 9, (M.CLASSES, n_ids))).astype(float))
    p = M.fresh()
    before = np.full(n, 17)
    slots = np.zeros((1, M.WINDOW), np.int64)
    slots[0, 0] = v.slot[17]
    total = 0.0
    for k in range(n):
        total += math.exp(float(M.log_probs(p, v.prior, slots, np.array([0]), np.array([v.klass[k]]))[0]) + float(v.within(before[k : k + 1], np.array([k]))[0]))
    assert math.isclose(total, 1.0, rel_tol=1e-3)


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i, prose(5000 + i, 80)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, eight = ({r["_doc"]["doc_id"]: r["score"] for r in scoring.lm_scores(docs.repartition(n), BPE, ["doc_id"], F.lit(True)).collect()} for n in (1, 8))
    assert all(math.isclose(one[i], eight[i], rel_tol=1e-4) for i in one)


def test_a_host_decides_on_repeated_lines(spark):
    lines = lambda i: "\n".join(x for k in range(5) for x in (prose(100 * i + k, 12), "read on"))
    rows = [(i, lines(i) if i % 2 else prose(i, 60), "loud") for i in range(40)] + [(100 + i, lines(i) if i == 1 else prose(i, 60), "calm") for i in range(40)] + [(200, lines(3), None)]
    got = {r["_doc"]["doc_id"]: r for r in quality_rules.host_quality(spark.createDataFrame(rows, DOCS_3), ["doc_id"]).collect()}
    assert not any(r["base_failed"] for r in got.values()) and got[1]["dup_lines"] and got[101]["dup_lines"] and got[200]["dup_lines"]
    assert not got[1]["kept"] and got[2]["kept"] and got[101]["kept"] and got[200]["kept"]  # what only the host tells apart


def test_second_half_meets_stored_counts(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    token_counts.extend_cache(first, BPE, cache)
    both = first.unionByName(spark.createDataFrame([(3, "one two"), (4, "four")], "doc_id long, text string"))
    assert {r["doc_id"]: r["n_tokens"] is None for r in token_counts.cached_counts(both, BPE, cache).collect()} == {1: False, 2: False, 3: False, 4: True}
    token_counts.extend_cache(both, BPE, cache)
    assert spark.read.parquet(cache).count() == 3


def test_base_places_equal_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet' UNION ALL SELECT * REPLACE (doc_id + 1000000 AS doc_id, 'MIT license, cc by cc-by; ' || text || ' Apache\nLicense' AS text) FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(licenses.BASE_SQL).fetchall())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.withColumns({"doc_id": F.col("doc_id") + 1000000, "text": F.concat(F.lit("MIT license, cc by cc-by; "), "text", F.lit(" Apache\nLicense"))})
    base = licenses.license_scan(docs.unionByName(more), ["doc_id"])
    got = [(r["_doc"]["doc_id"], r["n_words"], len(r["base"]), min((p["first"] for p in r["base"]), default=None), max((p["first"] for p in r["base"]), default=None), ",".join(sorted({p["label"] for p in r["base"]}))) for r in base.collect()]
    assert sorted(got) == want


def test_recall_of_overlaps_by_length():
    """Against brute force: passages of 12 to 40 words with a fifth of them substituted, equal at both ends."""
    rng, found, all_ = random.Random(5), 0, 0
    for k in range(300):
        n = rng.randint(12, 40)
        words = prose(9000 + k, n).split()
        item = decontamination.Benchmark([("k", " ".join(words))])
        changed = list(words)
        for i in rng.sample(range(1, len(words) - 1), len(words) // 5):
            changed[i] = f"other{i}"
        all_ += 1
        found += bool(item.overlaps("lead in " + " ".join(changed) + " lead out"))
    assert found >= 0.95 * all_
