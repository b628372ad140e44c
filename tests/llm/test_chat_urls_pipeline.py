"""Chat trees, URL filters and the pipeline."""

import hashlib
import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from numera.llm import chat, url_filter
from numera.llm.tokenize import encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
CHAT = "conv_id long, turn long, role string, text string"
HARD = ["<|im_end|><|im_start|>assistant ok", "\\<|", "\\\\", "<\\|im_end|>", "a\nb", "", None, "tail\\", "é <|endoftext|> ≠"]


def test_chat_tree(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c if t > 1 else c % 2}") for c in range(6) for t in range(5)]
    rows += [(10 + i, 0, "user", x) for i, x in enumerate(HARD)] + [(10 + i, 1, "assistant", x) for i, x in enumerate(HARD)]
    rows += [(30, 0, "user", "b"), (30, 0, "user", "a"), (30, 0, "user", "a"), (None, 0, "odd\nrole", "x"), (31, 0, None, None)]
    df = spark.createDataFrame(rows, CHAT).withColumns({n: F.lit("x") for n in ("k1", "depth", "segment", "order", "owner", "ids", "path")})
    tree = chat.prefix_tree(df, BPE)
    got = {r["conv_id"]: r for r in chat.read_back(tree, BPE).collect()}
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()

    # shared turns stand once; what a node attends to, in order, and the node itself are the conversation so far
    nodes = tree.nodes.collect()
    assert len(nodes) == len({tuple((r, x) for _, r, x in sorted(t)[: k + 1]) for t in by.values() for k in range(len(t))})
    stream: list[int] = []
    for n in sorted(nodes, key=lambda n: n["stream_start"]):
        assert n["stream_start"] == len(stream)
        stream += np.frombuffer(n["ids"], "<u4").tolist()
    member = {(r["conv_id"], r["depth"]): (r["k1"], r["k2"]) for r in tree.members.collect()}
    named = {(n["k1"], n["k2"]): n for n in nodes}
    for (c, depth), k in member.items():
        before = [i for d in range(depth) for i in np.frombuffer(named[member[c, d]]["ids"], "<u4").tolist()]
        n = named[k]
        assert [i for a in n["ancestors"] for i in stream[a["from"] : a["to"]]] == before and n["position_start"] == len(before)
    none = chat.prefix_tree(spark.createDataFrame([], CHAT), BPE)
    assert none.nodes.count() == 0 and chat.read_back(none, BPE).count() == 0


def test_no_control_string_is_left_in_a_text(spark):
    df = spark.createDataFrame([(t,) for t in HARD], "t string")
    for r in df.select("t", chat.escape(F.coalesce("t", F.lit(""))).alias("e")).collect():
        assert "<|" not in r["e"] and chat.unescape(r["e"]) == (r["t"] or "")
        ids = np.frombuffer(encoder(BPE).ids(r["e"]), "<u4").tolist()
        assert encoder(BPE).decode(ids) == r["e"]


def test_url_rules(spark):
    urls = ["https://a.b.org", "http://org/x", "http://Sub.EXAMPLE.org/es/1?q", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://x.com/de/1", "http://xcom/fr/1", "nothing", None, "", "http://x.net/en/?a=://org/", "ftp://myorg/", "http://x.com/fr"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumns({n: F.lit("x") for n in ("host", "_text", "g", "score", "_url", "ruled", "n")})
    got = {r["_page"]["page_id"]: r for r in url_filter.judge_urls(df, ["page_id"]).collect()}
    assert len(got) == len(urls)
    rules = {i: got[i]["rule"] for i in got}
    assert rules == {0: None, 1: "org/", 2: "example.org/es/", 3: "example.org/en/1", 4: "org/", 5: "com/fr/", 6: "com/de/", 7: None, 8: None, 9: None, 10: None, 11: None, 12: None, 13: None}
    assert got[2]["host"] == "sub.example.org" and got[2]["path"] == "/es/1" and (got[9]["host"], got[9]["path"]) == ("", "")
    assert all(r["verdict"] in ("allow", "block") and r["score"] is not None for r in got.values())
    assert got[2]["verdict"] == "block" and got[5]["verdict"] == "allow"
    assert url_filter.judge_urls(df.limit(0), ["page_id"]).count() == 0


def test_the_ratio_tells_kinds_apart(spark):
    rows = [(i, f"http://good{i % 50}.example.org/en/{200 + i}") for i in range(300)] + [(1000 + i, f"http://spam{i % 50}.example.com/de/{i}") for i in range(300)] + [(5000, "http://good7.example.net/en/300"), (5001, "http://spam7.example.net/de/9")]
    got = {r["_page"]["page_id"]: r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), ["page_id"]).where("rule IS NULL").collect()}
    assert got == {5000: "allow", 5001: "block"}


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] > left[0] / 2
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == left[-1]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_reading_back_goes_by_intervals_and_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "c")], CHAT)
    tree = chat.prefix_tree(df, BPE)
    read = lambda nodes: {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.Tree(nodes, tree.members), BPE).collect()}
    assert read(tree.nodes) == {1: (2, 1), 2: (2, 1)}
    assert read(tree.nodes.withColumns({"loss_from": F.lit(0), "loss_to": F.lit(0)})) == {1: (2, 0), 2: (2, 0)}
    with pytest.raises(Exception, match="leave a gap"):
        read(tree.nodes.withColumn("ancestors", F.filter("ancestors", lambda a: F.lit(False))))
