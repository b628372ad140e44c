"""The language model learns from every training row, and a step's gradients are those of its loss."""

import numpy as np
from pyspark.sql import functions as F

import public_tokenizers
from numera.llm import causal, scoring


def test_every_training_row_is_trained_on(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TRAIN_TOKENS", 10)  # as a corpus that is far larger
    seen, plain = {}, scoring.materialize
    monkeypatch.setattr(scoring, "materialize", lambda df, label: seen.setdefault(label, plain(df, label)))
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(1, 30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scoring.lm_scores(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"], F.col("doc_id") % 4 != 0)
    trained = sorted(bytes(r["_text"]).decode() for r in seen["training"].collect())
    assert trained == sorted(t for i, t in rows if i % 4)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    p = {k: v.astype(np.float32) for k, v in causal.fresh().items()}
    prior = rng.normal(-4, 1, (causal.SLOTS + causal.CLASSES, causal.CLASSES)).astype(np.float32)
    slots, at = rng.integers(0, causal.SLOTS, (4, causal.WINDOW)), np.arange(0, 4 * causal.WINDOW, 3)
    classes = rng.integers(0, causal.CLASSES, len(at))
    loss, g = causal.step(p, prior, slots, at, classes)
    assert abs(loss + causal.log_probs(p, prior, slots, at, classes).mean()) < 1e-4
    for name in ("last", "qkv", "up", "out"):
        d = g[name] / np.linalg.norm(g[name])
        way = [causal.step({**p, name: p[name] + np.float32(s) * d.astype(np.float32)}, prior, slots, at, classes)[0] for s in (-0.02, 0.02)]
        assert abs((way[1] - way[0]) / 0.04 / np.linalg.norm(g[name]) - 1) < 0.05, name
