"""Quality: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates.

Features are the words and pairs of neighbouring words of the lower-cased text, hashed into ``buckets``; a feature's value is the
square root of its count over the square root of the number of features, so that no text weighs more for its length.
The weights come from FTRL-Proximal steps (per-coordinate rates, L1 and L2), one document at a time; a score is the
sigmoid of a sparse dot product.

Defined cases: null, empty and blank texts have the bias as their only feature; very long texts are scored whole; repeated rows
get equal scores; without labelled rows of both classes every score is the share of label 1 (0 without any labels); null labels
and labels of unknown documents are left out; extra columns pass through whatever their names.

Scale: only the fit is bounded: at most ``max_rows`` labelled rows of each class (those of smallest hash), one text an id, and
``max_bytes`` of text, which one task trains on.
Scoring is a narrow pass with a weight vector of fixed size.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, fitted, labelled_texts, map_texts, table, unpack


class Hasher:
    """Texts to (feature, value) arrays; the hashes of words are cached."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.cache: dict[str, int] = {}

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        ws = (text or "").lower().split()
        if not ws:
            return np.empty(0, np.int64), np.empty(0)
        cache = self.cache
        if len(cache) > 400_000:
            cache.clear()
        for w in set(ws).difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w, 3)
        one = np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ one[1:]
        two ^= two >> np.uint64(31)
        marks = (np.concatenate([one, two * np.uint64(0xD6E8FEB86659FD93)]) >> np.uint64(32)) % np.uint64(self.buckets)
        index, counts = np.unique(marks.astype(np.int64), return_counts=True)
        return index, np.sqrt(counts / len(marks))


class Ftrl:
    def __init__(self, buckets: int = 1 << 18, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.1):
        self.buckets, self.alpha, self.beta, self.l1, self.l2 = buckets, alpha, beta, l1, l2
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)
        self.bias_z = self.bias_n = 0.0

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    @property
    def bias(self) -> float:
        return -self.bias_z / ((self.beta + math.sqrt(self.bias_n)) / self.alpha)

    def step(self, index: np.ndarray, value: np.ndarray, y: int, weight: float) -> None:
        w, b = self.weights(index), self.bias
        p = sigmoid(float(w @ value) + b)
        g = weight * (p - y) * value
        self.z[index] += g - (np.sqrt(self.n[index] + g * g) - np.sqrt(self.n[index])) / self.alpha * w
        self.n[index] += g * g
        g = weight * (p - y)
        self.bias_z += g - (math.sqrt(self.bias_n + g * g) - math.sqrt(self.bias_n)) / self.alpha * b
        self.bias_n += g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x))))


def train(texts: list[str | None], labels: list[int], *, epochs: int = 8, balance: float = 0.5, seed: int = 5, **options) -> tuple[np.ndarray, float]:
    """(weights, bias). ``balance`` between 0 (rows weigh alike) and 1 (classes weigh alike)."""
    model = Ftrl(**options)
    if not labels or min(labels) == max(labels):
        share = labels[0] if labels else 0
        return np.zeros(model.buckets), 50.0 * (1 if share else -1)
    hasher = Hasher(model.buckets)
    rows = [hasher.features(t) for t in texts]
    share = np.bincount(labels, minlength=2) / len(labels)
    weight = (0.5 / share) ** balance
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.step(*rows[i], labels[i], float(weight[labels[i]]))
    return model.weights(np.arange(model.buckets)), model.bias


def scorer(weights: np.ndarray, bias: float):
    hasher = Hasher(len(weights))

    def score(texts):
        out = []
        for t in texts:
            index, value = hasher.features(t)
            out.append(sigmoid(float(weights[index] @ value) + bias))
        return [out]

    return score


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "quality", learn: F.Column | None = None, max_rows: tuple[int, int] = (6000, 10000), max_bytes: int = 64 << 20, **options) -> tuple[np.ndarray, float]:
    """Train on the labelled rows that ``learn`` (a predicate on the label rows) allows, ``max_rows`` of label 0 and 1 and ``max_bytes`` of text at most."""
    sample = labelled_texts(docs, labels, id_col=id_col, text=text, label=label, learn=learn, max_rows=max_rows, max_bytes=max_bytes)
    return fitted(sample, lambda texts, marks: train(texts, marks, **options))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: ``row`` (the kept columns) and ``score`` (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("score", T.DoubleType())])
    return map_texts(docs, [docs[text].cast("string")], docs.columns if keep is None else keep, fields, lambda: scorer(*sent.value))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), learn=crc32_mod("doc_id", 5) != 0)
    out = scored(docs, model, keep=["doc_id"]).withColumn("held_out", crc32_mod("row.doc_id", 5) == 0)
    return unpack(out, F.col("held_out"), F.col("score"), (F.col("score") >= 0.3).cast("int").alias("predicted"))
