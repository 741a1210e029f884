"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled documents train a small network by the non-negative
unbiased risk with logistic loss: ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the
second term goes negative, its gradient is ascended instead. Scores are the sigmoid of the network's
output.

The class prior is estimated from positives and unlabelled rows alone (best bin estimation): a
network that tells positives from unlabelled rows ranks the half of both that it has not seen; the
prior is the share of unlabelled over the share of positive rows above the rank where that ratio plus
its confidence bound is least. Rows of label 0 are not read.

Inputs are counts over the whole text (byte classes, punctuation patterns, word and line
repetition, word-length shape); never id, labels, language or source. Labels come only from rows
whose crc32(doc_id as text) mod 4 is not 2.

The fit uses bounded samples, the documented parameter ``MOST_ROWS`` for each of the positives and the
unlabelled documents, drawn by a 63-bit hash over all distinct (doc_id, text) rows; a sample that
comes out empty although there are rows raises. Scoring reads every whole text of every row.

Defined results: null text counts as empty and is scored like one; a very long text is measured and
scored whole; a null doc_id is not held out and never learned from; repeated rows each get the same
score and are learned from once; ties do not arise, as each row is scored alone; if there is no positive
or no unlabelled row to learn from, every score is 0.5; extra columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rows_of

MOST_ROWS = 6_000
THRESHOLD = 0.7
HIDDEN = 24
EPOCHS = 60
BATCH = 512
SEED = 7

LOWER, UPPER, DIGIT, GAP = (np.zeros(256, bool) for _ in range(4))
LOWER[97:123], UPPER[65:91], DIGIT[48:58], GAP[[9, 10, 11, 12, 13, 32]] = True, True, True, True
HIGH = np.arange(256) >= 128
SINGLES = b"#*$%&|<>!.,;:?-'\"()[]{}/\\@=+_~^`"
#: Byte classes as columns of a matrix, so that one histogram gives all counts.
CLASSES = np.stack([LOWER, UPPER, DIGIT, GAP, HIGH, *[np.arange(256) == c for c in SINGLES]], 1).astype(np.float64)
N_FEATURES = CLASSES.shape[1] + 14


def features(text: str) -> np.ndarray:
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES
    words = data.split()
    n, size = max(1, len(words)), max(1, len(data))
    kinds = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = max(kinds.values(), default=0)
    few = sum(c for _, c in kinds.most_common(10))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    pairs = len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0
    more = [
        np.log1p(len(words)), np.log1p(len(data)), len(kinds) / n, top / n, few / n, pairs / n,
        len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), len(lines) / n,
        lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 12).mean(), data.count(b"\n\n") / n,
    ]
    return np.concatenate([np.sqrt(counts / size), more])


class Model:
    """Standardised inputs, one tanh layer, one output."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]) -> None:
        self.mean, self.scale, self.weights = mean, scale, weights

    def hidden(self, x: np.ndarray) -> np.ndarray:
        a, b, _, _ = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ a + b)

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.output(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(positive: np.ndarray, unlabelled: np.ndarray, slopes: Callable, seed: int) -> Model:
    """Adam on batches of both samples; ``slopes`` gives the risk's slope at each output. Deterministic."""
    rng, every = np.random.default_rng(seed), np.concatenate([positive, unlabelled])
    model = Model(every.mean(0), every.std(0) + 1e-6, [rng.normal(0, 0.3, (every.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)])
    moments, step = [[np.zeros_like(w), np.zeros_like(w)] for w in model.weights], 0
    rounds = -(-max(len(positive), len(unlabelled)) // BATCH)
    for epoch in range(EPOCHS):
        p_order, u_order = np.resize(rng.permutation(len(positive)), rounds * BATCH), np.resize(rng.permutation(len(unlabelled)), rounds * BATCH)
        for i in range(rounds):
            p, u = positive[p_order[i * BATCH : (i + 1) * BATCH]], unlabelled[u_order[i * BATCH : (i + 1) * BATCH]]
            gp, gu = slopes(model.output(p), model.output(u))
            x, g = np.concatenate([p, u]), np.concatenate([gp, gu])
            h, out = model.hidden(x), model.weights[2]
            back = g[:, None] * out[None] * (1 - h * h)
            grads = [np.clip((x - model.mean) / model.scale, -8, 8).T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]
            step += 1
            rate = 0.01 * (1 - epoch / EPOCHS)
            for k, grad in enumerate(grads):
                grad = grad + (1e-3 * model.weights[k] if k in (0, 2) else 0)
                m, v = moments[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                model.weights[k] = model.weights[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> Model | None:
    """Minimises the non-negative unbiased risk."""
    if not len(positive) or not len(unlabelled):
        return None

    def slopes(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            return prior * (-sigmoid(-zp) - sigmoid(zp)) / len(zp), sigmoid(zu) / len(zu)
        return prior * sigmoid(zp) / len(zp), -sigmoid(zu) / len(zu)

    return descend(positive, unlabelled, slopes, seed)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED, doubt: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled rows; no other labels are used. 0.5 with under two rows of either."""
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    model = descend(positive[::2], unlabelled[::2], lambda zp, zu: (-sigmoid(-zp) / len(zp), sigmoid(zu) / len(zu)), seed)
    zp, zu = np.sort(model.output(positive[1::2])), np.sort(model.output(unlabelled[1::2]))
    cuts = np.concatenate([zp, zu])
    above = lambda z: 1 - np.searchsorted(z, cuts, side="left") / len(z)
    p, u = above(zp), above(zu)
    cuts = p > 0
    p, u = p[cuts], u[cuts]
    bound = (1 + slack) / p * sum(np.sqrt(np.log(4 / doubt) / (2 * len(z))) for z in (zp, zu))
    best = np.argmin(u / p + bound)
    return float(min(max(u[best] / p[best], 0.01), 0.99))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for labels, texts in rows_of(batches, "label", "text"):
        x = np.stack([features(t or "") for t in texts]) if texts else np.zeros((0, N_FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])


def drawn(rows: DataFrame, salt: str, most: int) -> DataFrame:
    """About ``most`` distinct (doc_id, text) rows by hash: (label, text). Counts all rows first."""
    rows = rows.withColumn("digest_", F.xxhash64("text"))
    share = most / max(1, rows.count())
    if share < 1:  # 63 bits: no number of rows rounds the share down to none
        rows = rows.where(F.xxhash64(F.lit(salt), "doc_id", "digest_").bitwiseAND(F.lit((1 << 63) - 1)) < F.lit(int(share * (1 << 63))))
    return rows.dropDuplicates(["doc_id", "digest_"]).select("label", "text")


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[Model | None, float]:
    """The model and the prior. About ``2 * most`` feature rows come to the driver, whatever the tables' sizes."""
    learned = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    trusted = labels.where(learned & (F.col("quality") == 1)).select(F.col("doc_id").alias("d_")).distinct()
    rows = docs.select("doc_id", "text")
    positive = rows.join(trusted, F.col("doc_id") == F.col("d_"), "left_semi").withColumn("label", F.lit(1))
    rest = rows.where(learned).withColumn("label", F.lit(0))
    found = drawn(positive, "p", most).unionAll(drawn(rest, "u", most)).mapInArrow(_measure, "label int, x array<double>").toPandas()
    found = found.iloc[pd.util.hash_pandas_object(found["x"].map(tuple), index=False).argsort(kind="stable")]  # the same order on every run
    xs = lambda y: np.array(found.loc[found["label"] == y, "x"].tolist(), np.float64).reshape(-1, N_FEATURES)
    p, u = xs(1), xs(0)
    if (not len(p) and not positive.isEmpty()) or (not len(u) and not rest.isEmpty()):
        raise RuntimeError("a sample came out empty although there are rows")
    prior = estimate_prior(p, u)
    return fit(p, u, prior), prior


def score(docs: DataFrame, model: Model | None, prior: float) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in rows_of(batches, "doc_id", "text"):
            if model is None or not texts:
                y = np.full(len(texts), prior)
            else:
                y = model.score(np.stack([features(t or "") for t in texts]))
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(y, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op10_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, prior = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, prior).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
