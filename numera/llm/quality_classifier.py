"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics (lengths, shares of kinds of characters, repetition), transformed so that they are
closer to normal. Of the labelled rows, Spark adds up counts, sums and products of the statistics by class: the two normal
densities need nothing else. Each class covariance is shrunk, towards the pooled one and then towards a multiple of the
identity, by an amount that follows from its own sums. A document's score is the difference of the two log densities, with
Mahalanobis distances by Cholesky factors that are worked out once and sent to the workers, put through a logistic curve
that is calibrated on a histogram of all labelled rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table
from .tokenize import release

#: Characters that prose hardly has.
SYMBOLS = "#*$%&|<>@^~_=+\\/{}[]"
STATISTICS = ("words", "word_length", "symbols", "digits", "capitals", "letterless", "distinct", "repeated_lines", "top_word", "line_words", "stops", "letters", "repeated_pairs", "one_letter")
#: Statistics are kept in steps of this size, so that sums over them are whole numbers and don't depend on their order.
STEP = 1 / 1024
#: Rows whose checksum leaves 2 by 4 are held out: their labels are never looked at.
HELD_OUT, REMAINDER = 4, 2
#: Labels up to this number are broadcast.
BROADCAST_LABELS = 1_000_000
#: The calibration sees log-density differences in bins of this width, up to this size.
BIN, FURTHEST = 0.25, 200.0
LIMIT = 0.7


def statistics(text: str | None) -> list[int]:
    """The transformed statistics of a text, in steps of STEP; a null text is an empty one."""
    from math import log1p, sqrt

    import numpy as np

    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    bytes_in_words = int(kinds.sum() - kinds[9:14].sum() - kinds[32])
    symbols = int(kinds[[ord(c) for c in SYMBOLS]].sum())
    digits, capitals, small = int(kinds[48:58].sum()), int(kinds[65:91].sum()), int(kinds[97:123].sum())
    beyond = int(kinds[192:].sum())  # lead bytes: one for each character beyond ASCII
    chars = bytes_in_words - int(kinds[128:192].sum())
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    some = max(n, 1)
    shape = (
        log1p(n),
        log1p(chars / some),
        sqrt(symbols / max(chars, 1)),
        sqrt(digits / max(chars, 1)),
        sqrt(capitals / max(capitals + small, 1)),
        sqrt(sum(k for w, k in seen.items() if not any(c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in w)) / some),
        len(seen) / some,
        sqrt(1 - len(set(lines)) / max(len(lines), 1)) if lines else 0.0,
        sqrt(max(seen.values(), default=0) / some),
        log1p(n / max(len(lines), 1)),
        sqrt(int(kinds[[33, 46, 63]].sum()) / some),
        (capitals + small + beyond) / max(chars, 1),
        sqrt(1 - len(pairs) / max(n - 1, 1)) if n > 1 else 0.0,
        sqrt(sum(k for w, k in seen.items() if len(w) == 1) / some),
    )
    return [round(x / STEP) for x in shape]


@dataclass
class Discriminant:
    """Means and inverse Cholesky factors of the two classes, on standardised statistics."""

    centre: list
    scale: list
    means: list
    factors: list
    log_dets: list
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x):
        """Log density of class 1 less that of class 0, for a matrix of statistics."""
        import numpy as np

        z = (np.asarray(x, float) * STEP - self.centre) / self.scale
        far = [np.square((z - m) @ f.T).sum(1) for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * (far[0] - far[1] + self.log_dets[0] - self.log_dets[1])

    def score(self, x):
        import numpy as np

        z = self.slope * np.clip(self.difference(x), -FURTHEST, FURTHEST) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shrinkage(cov, n: float) -> float:
    """How far a covariance of n rows is moved towards a multiple of the identity (the oracle-approximating rule)."""
    import numpy as np

    p = len(cov)
    square, trace = float((cov * cov).sum()), float(np.trace(cov))
    above, below = (1 - 2 / p) * square + trace**2, (n + 1 - 2 / p) * (square - trace**2 / p)
    return 1.0 if below <= 0 else min(1.0, above / below)


def discriminant(sums: dict[int, tuple]) -> Discriminant:
    """sums: of class 0 and 1, the number of rows, the sums of the statistics and those of their products."""
    import numpy as np

    p = len(STATISTICS)
    n = {k: float(sums[k][0]) for k in (0, 1)}
    mean = {k: np.array(sums[k][1], float) * STEP / n[k] for k in n}
    cov = {k: np.array(sums[k][2], float).reshape(p, p) * STEP**2 / n[k] - np.outer(mean[k], mean[k]) for k in n}
    pooled = (cov[0] * n[0] + cov[1] * n[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), STEP**2))
    out = Discriminant(((mean[0] * n[0] + mean[1] * n[1]) / (n[0] + n[1])), scale, [], [], [])
    both = pooled / np.outer(scale, scale)
    for k in (0, 1):
        own = cov[k] / np.outer(scale, scale)
        to_pooled = p / (p + n[k])
        own = (1 - to_pooled) * own + to_pooled * both
        rho = max(shrinkage(own, n[k]), 1e-3)
        own = (1 - rho) * own + rho * max(np.trace(own) / p, 1e-3) * np.eye(p)
        lower = np.linalg.cholesky(own)
        out.means.append((mean[k] - out.centre) / scale)
        out.factors.append(np.linalg.inv(lower))
        out.log_dets.append(2 * float(np.log(np.diag(lower)).sum()))
    return out


def calibrate(bins: list[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve from (difference, rows of class 0, rows of class 1), by Newton's method on
    targets that are kept off 0 and 1 by one row of either class."""
    import numpy as np

    x = np.array([b[0] for b in bins], float)
    zero, one = np.array([b[1] for b in bins], float), np.array([b[2] for b in bins], float)
    low, high = 1 / (zero.sum() + 2), (one.sum() + 1) / (one.sum() + 2)
    n, hits = zero + one, zero * low + one * high
    w = np.array([0.1, np.log((one.sum() + 1) / (zero.sum() + 1))])
    design = np.stack([x, np.ones_like(x)])
    loss = lambda w: float((n * np.logaddexp(0, w @ design) - hits * (w @ design)).sum() + 1e-6 * (w @ w))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ design, -30, 30)))
        gradient = design @ (n * p - hits) + 2e-6 * w
        step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + 2e-6 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _statistics(it):
    import pyarrow as pa

    release()
    for b in it:
        got = [statistics(t) for t in b.column(b.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.list_(pa.int32()))], [*b.schema.names[:-1], "_x"])


def _moments(it):
    """One row a task, class and place: partial sums, which are whole numbers."""
    import numpy as np
    import pyarrow as pa

    p = len(STATISTICS)
    total = np.zeros((2, 1 + p + p * p), np.int64)
    for b in it:
        x = np.asarray(b.column(1).flatten(), np.int64).reshape(-1, p)
        y = np.asarray(b.column(0), np.int64)
        for k in (0, 1):
            own = x[y == k]
            total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    k, i = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(k.ravel().astype(np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(total.ravel())], ["label", "place", "v"])


def _differences(shared):
    def batches(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            x = np.asarray(b.column(1).flatten(), float).reshape(-1, len(STATISTICS))
            d = np.clip(shared.value.difference(x), -FURTHEST, FURTHEST)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(d / BIN).astype(np.int32))], ["label", "bin"])

    return batches


def _scores(shared):
    def batches(it):
        import numpy as np
        import pyarrow as pa

        for b in it:
            x = np.asarray(b.column(b.num_columns - 1).flatten(), float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(shared.value.score(x))], [*b.schema.names[:-1], "score"])

    return batches


def fit(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Discriminant | None:
    """The discriminant from rows (_id, _x) and the labels that are not held out. Of several labels of one id the largest
    counts; null labels and ids tell nothing. None where only one class, or none, has labels."""
    spark = rows.sparkSession
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    given = materialize(given.where(fold(F.col("_id"), HELD_OUT) != REMAINDER), "labels")
    if given.count() <= BROADCAST_LABELS:
        given = F.broadcast(given)
    labelled = rows.join(given, "_id").select(F.col("_y").alias("label"), "_x")
    sums = labelled.mapInArrow(_moments, "label int, place int, v long").groupBy("label", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    p = len(STATISTICS)
    got = {k: [0] * (1 + p + p * p) for k in (0, 1)}
    for r in sums.collect():  # 2 classes of 1 + p + p * p sums
        got[r["label"]][r["place"]] = int(r["v"])
    if not got[0][0] or not got[1][0]:
        return None
    model = discriminant({k: (v[0], v[1 : 1 + p], v[1 + p :]) for k, v in got.items()})
    bins = labelled.mapInArrow(_differences(spark.sparkContext.broadcast(model)), "label int, bin int").groupBy("bin").agg(F.count_if(F.col("label") == 0).alias("zero"), F.count_if(F.col("label") == 1).alias("one"))
    model.slope, model.offset = calibrate(sorted((r["bin"] * BIN, r["zero"], r["one"]) for r in bins.collect()))
    return model


def quality(docs: DataFrame, labels: DataFrame, carry: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """A struct _doc of the carried columns and score double, from 0 to 1; higher: more likely of quality.

    Only the text is an input of the score. A null text scores as an empty one. Repeated rows stay repeated and score
    alike, and count each time they are labelled. Where the labels hold one class only, or there are none, every score is
    that class's, or 0.5. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*carry).alias("_doc"), F.col(text_col).alias("_text"))
    kind = rows.drop("_text").schema
    rows = materialize(rows.mapInArrow(_statistics, f"_id {kind['_id'].dataType.simpleString()}, _doc {kind['_doc'].dataType.simpleString()}, _x array<int>"), "statistics")
    model = fit(rows, labels, id_col, label_col)
    if model is None:
        known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (fold(F.col(id_col), HELD_OUT) != REMAINDER)).agg(F.max(label_col)).first()[0]
        return rows.select("_doc", F.lit(0.5 if known is None else float(known)).alias("score"))
    return rows.select("_doc", "_x").mapInArrow(_scores(spark.sparkContext.broadcast(model)), f"_doc {kind['_doc'].dataType.simpleString()}, score double")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"]).select("_doc.doc_id", "score")
    return scored.select("doc_id", (fold(F.col("doc_id"), HELD_OUT) == REMAINDER).alias("held_out"), "score", F.when(F.col("score") >= LIMIT, 1).otherwise(0).alias("predicted"))
