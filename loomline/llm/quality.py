"""Quality from random-indexing word vectors and a two-layer network (operator 9).

Each token has a fixed sparse index vector of +1 and -1, drawn from a hash of the token. Its word vector sums its own
index vector and those of the tokens around it over the labelled sample. A document is the mean of its tokens'
vectors, the mean of its different tokens' vectors, and two measures of length and variety. A network of one hidden
layer and one output is trained on these with numpy; a temperature, fitted on rows that training did not see,
calibrates its probabilities.

Tokens that the sample does not hold often enough share the vector of their shape (case, script, length).

Defined results: a null or empty text has a zero vector and is scored like any other; repeated rows give repeated
results; where the sample lacks one of the labels every text scores the share of good rows (0.5 with no rows).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import chunks, in_fold, labelled_sample, once

FOLDS, HELD_OUT = 3, 1
#: Most labelled rows that word vectors, network and temperature are fitted on.
SAMPLE = 3000
#: Most tokens with a vector of their own, and the least count that earns one.
VOCABULARY, LEAST = 20_000, 5
DIM, NONZERO, WINDOW, HIDDEN, EPOCHS = 64, 4, 2, 24, 60
THRESHOLD = 0.5
TOKEN = re.compile(r"\w+|[^\w\s]+")


def shape(token: str) -> str:
    """The class that a rare token belongs to."""
    kind = "S" if not (token[0].isalnum() or token[0] == "_") else "N" if token.isdigit() else "U" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "L"
    return f"\x00{kind}{min(len(token) // 4, 6)}"


@dataclass
class Vectors:
    """index: token to row; rows: unit vectors."""

    index: dict[str, int]
    rows: np.ndarray

    def ids(self, tokens: list[str]) -> np.ndarray:
        get, none = self.index.get, len(self.rows) - 1
        return np.array([i if (i := get(t)) is not None else get(shape(t), none) for t in tokens], np.int32)

    def pool(self, texts: list[str]) -> np.ndarray:
        """A row per text. Memory is bounded by the longest text's tokens."""
        out = np.zeros((len(texts), 2 * DIM + 2))
        for k, text in enumerate(texts):
            tokens = TOKEN.findall(text or "")
            if not tokens:
                continue
            ids, times = np.unique(self.ids(tokens), return_counts=True)
            v = self.rows[ids]
            out[k, :DIM] = times @ v / len(tokens)
            out[k, DIM : 2 * DIM] = v.mean(0)
            out[k, -2:] = np.log1p(len(tokens)), len(set(tokens)) / len(tokens)
        return out


def index_vectors(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each token's nonzero entries."""
    h = np.array([[xxh64_intdigest(t, s) for s in range(NONZERO)] for t in tokens], np.uint64).reshape(-1, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def learn_vectors(texts: list[str]) -> Vectors:
    # Texts are split again below: all their tokens would be many times the texts, in the driver.
    counts: Counter = Counter()
    for t in texts:
        counts.update(TOKEN.findall(t or ""))
    kept = sorted((t for t, n in counts.items() if n >= LEAST), key=lambda t: (-counts[t], t))[:VOCABULARY]
    shapes = sorted({shape(t) for t in counts} | {f"\x00{k}{n}" for k in "SNUTL" for n in range(7)})
    names = [*kept, *shapes, "\x00"]
    index = {t: i for i, t in enumerate(names)}
    places, signs = index_vectors(names)
    signs[-1] = 0  # what stands between documents
    vectors = Vectors(index, np.zeros((len(names), DIM)))
    total = np.zeros(len(names) * DIM)
    gap = np.full(WINDOW, len(names) - 1, np.int64)  # between documents
    for a, b in chunks([t or "" for t in texts], 1_000_000):
        ids = np.concatenate([x for t in texts[a:b] for x in (vectors.ids(TOKEN.findall(t or "")).astype(np.int64), gap)])
        for off in (o for o in range(-WINDOW, WINDOW + 1)):
            here, there = ids[max(0, -off) : len(ids) - max(0, off)], ids[max(0, off) : len(ids) + min(0, off)]
            for j in range(NONZERO):
                total += np.bincount(here * DIM + places[there, j], signs[there, j] * (2.0 if off == 0 else 1.0), len(total))
    rows = total.reshape(-1, DIM)
    rows[-1] = 0
    vectors.rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return vectors


@dataclass
class Model:
    vectors: Vectors | None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    share: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str]) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.vectors.pool(texts)) / self.temperature, -30, 30)))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    if len(set(labels)) < 2:
        return Model(None, share=float(np.mean(labels)) if labels else 0.5)
    vectors = learn_vectors(texts)
    x, y = vectors.pool(texts), np.array(labels, float)
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(y)) < max(1, len(y) // 5)
    model = Model(vectors, x[~held].mean(0), x[~held].std(0) + 1e-3)
    z, t = (x[~held] - model.mean) / model.scale, y[~held]
    w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(t))
        for i in range(0, len(order), 64):
            rows = order[i : i + 64]
            h = np.tanh(z[rows] @ w[0] + w[1])
            d = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - t[rows]) / len(rows)
            dh = np.outer(d, w[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((z[rows].T @ dh + 1e-3 * w[0], dh.sum(0), h.T @ d + 1e-3 * w[2], d.sum())):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(w)
    logits, truth = model.logits(x[held]), y[held]
    loss = lambda temp: np.logaddexp(0, np.where(truth > 0, -1, 1) * logits / temp).mean()
    model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, bound)
    return fit(list(rows["text"]), [int(v) for v in rows["y"]])


def scorer(spark: SparkSession, model: Model):
    """A column function: the score of a text. The model is broadcast once; VOCABULARY bounds its size."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        once("quality")
        return pd.Series(sent.value.score(list(texts)), dtype="float64")

    return score


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted. No shuffle."""
    scored = docs.select("doc_id", scorer(docs.sparkSession, model)("text").alias("score"))
    return scored.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
