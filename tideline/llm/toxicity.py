"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6, with word marks) and of itself, all hashed into one table of vectors;
its vector is the mean of the bag. The words of a window are averaged and go through a linear softmax of two classes; vectors and
softmax are trained together. A misspelling or an unseen inflection shares most n-grams with words that were seen. A document is as
toxic as its worst window, so that a few words in a long text are not averaged away: training starts from how much each n-gram
leans to a label in the documents' counts, and alternates between choosing the worst windows of each document under the present
model and gradient steps on those windows. A word that is repeated within a window counts once there.

Defined cases: null, empty and blank texts have no words and get the (calibrated) score of the bias alone; very long texts are scored whole, window
by window; repeated rows get equal scores; without labelled rows of both classes every score is 0; extra columns pass
through whatever their names; labels of unknown documents and null labels are left out.

Scale: only the fit is bounded: at most ``max_rows`` labelled rows of each class (those of smallest hash), one text an id, and
``max_bytes`` of text, which one task trains on. Scoring is a narrow pass; the model is a table of ``buckets`` vectors, whose size is fixed.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, fitted, labelled_texts, map_texts, table, unpack

SHAPE = ("buckets", "dim", "window")
WORD = re.compile(r"[^\W_]+(?:[*@$!'’_-]+[^\W_]+)*", re.UNICODE)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(ws: list[str], buckets: int, low: int = 3, high: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of each word and the word itself: all in one array, word by word, and how many each has."""
    marked = [f"<{w}>" for w in ws]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(ws)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters from here to the end of the word
    rolled, found, owners = code.copy(), [], []
    for n in range(2, high + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n >= low:
            ok = left[: len(rolled)] >= n
            h = rolled[ok] ^ (rolled[ok] >> np.uint64(29))
            found.append((h * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(32))
            owners.append(owner[: len(rolled)][ok])
    found.append(np.fromiter((xxhash.xxh32_intdigest(w, 1) for w in marked), np.uint64, len(marked)))
    owners.append(np.arange(len(ws)))
    flat, who = np.concatenate(found) % np.uint64(buckets), np.concatenate(owners)
    return flat[np.argsort(who, kind="stable")].astype(np.int64), np.bincount(who, minlength=len(ws))


def before(ids: np.ndarray) -> np.ndarray:
    """The place of the last equal id before each one, -1 if there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), -1)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def window_sums(scores: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """The sum of the window that starts at each place; a word counts if its last equal one lies before the window."""
    n = len(scores)
    total = np.zeros(n)
    at = np.arange(n)
    for k in range(min(window, n)):
        total[: n - k] += np.where(last[k:] < at[: n - k], scores[k:], 0.0)
    return total


class Model:
    """Vectors of the n-grams and the softmax; words' scores are cached while texts are scored."""

    def __init__(self, buckets: int = 1 << 16, dim: int = 8, window: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets, self.dim, self.window = buckets, dim, window
        self.vectors = rng.uniform(-0.5 / dim, 0.5 / dim, (buckets, dim)).astype(np.float32)
        self.weights = rng.normal(0, 0.5, (2, dim)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.trained = False
        self.scale, self.shift = 1.0, 0.0  # from logits to calibrated logits
        self.cache: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def word_scores(self, ws: list[str]) -> np.ndarray:
        """The logits of the words, each as if its window were full of it."""
        flat, sizes = grams(ws, self.buckets)
        slope = self.vectors @ (self.weights[1] - self.weights[0])
        return np.add.reduceat(slope[flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes if len(ws) else np.empty(0)

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.trained:
            return [0.0] * len(texts)
        return [sigmoid(self.scale * z + self.shift) for z in self.logits(texts)]

    def logits(self, texts: list[str | None]) -> list[float]:
        """The logit of each text's worst window."""
        docs = [words(t) for t in texts]
        cache = self.cache
        if len(cache) > 400_000:
            cache.clear()
        new = list({w for d in docs for w in d if w not in cache})
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            cache.update(zip(part, self.word_scores(part).tolist()))
        bias = float(self.bias[1] - self.bias[0])
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        out = np.full(len(docs), bias)
        some = np.flatnonzero(sizes)
        if len(some):
            # All texts in one row, each followed by words of no weight; words are told apart by their scores: two of equal score are as good as one.
            room = sizes + self.window
            start = np.r_[0, np.cumsum(room)[:-1]]
            row = np.zeros(int(room.sum()))
            row[np.repeat(start - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))] = np.fromiter((cache[w] for d in docs for w in d), np.float64, int(sizes.sum()))
            sums = window_sums(row, before(row), self.window)
            ends = start + np.maximum(1, sizes - self.window + 1)  # windows that stand whole in the text, or the only one
            best = np.maximum.reduceat(sums, np.stack([start[some], ends[some]], axis=1).ravel())[::2]
            out[some] += best / self.window
        return out.tolist()


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, x))))


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(scale, shift) of a logistic fit of labels on logits, with smoothed targets, so that separable rows give finite numbers."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    unit = max(1e-9, float(z.std()))
    x = np.stack([z / unit, np.ones(len(z))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / unit), float(w[1])


def train(texts: list[str | None], labels: list[int], *, epochs: int = 12, most_epochs: int = 30, min_steps: int = 400, folds: int = 5, enough: int = 50, seed: int = 7, **options) -> Model:
    """The model and its calibration on rows that it did not learn from.

    A fifth of the rows (``folds``) is kept back to calibrate the scores. Where that holds under ``enough`` rows of a class, each
    fifth is scored by a model of the others, all of these scores calibrate, and the model learns from every row. Few rows are gone
    through more often (``most_epochs`` at most), until about ``min_steps`` steps are done.
    """
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return Model(seed=seed, **{k: v for k, v in options.items() if k in SHAPE})
    options |= {"epochs": max(epochs, min(most_epochs, min_steps * options.get("batch", 256) // max(1, 2 * len(texts)))), "seed": seed}
    back = np.random.default_rng(seed + 1).permutation(len(y)) % folds

    def learnt(rows: np.ndarray) -> Model:
        return descend([texts[i] for i in np.flatnonzero(rows)], y[rows], **options)

    if np.bincount(y[back == 0], minlength=2).min() >= enough:
        model, held = learnt(back != 0), back == 0
        z = np.array(model.logits([texts[i] for i in np.flatnonzero(held)]))
    else:
        model, held, z = learnt(np.ones(len(y), bool)), np.zeros(len(y), bool), np.zeros(len(y))
        for fold in range(folds):
            out = back == fold
            if out.any() and y[~out].min() < y[~out].max():
                z[out] = learnt(~out).logits([texts[i] for i in np.flatnonzero(out)])
                held |= out
        z = z[held]
    if len(z) and np.bincount(y[held], minlength=2).min() >= 5:
        model.scale, model.shift = calibration(z, y[held])
        if model.scale <= 0:  # nothing was learnt
            model.scale, model.shift = 1.0, 0.0
    return model


def bagged(ws: np.ndarray, bag_flat: np.ndarray, bag_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the words of these numbers, word by word, and how many each has."""
    sizes = bag_at[ws + 1] - bag_at[ws]
    first = np.repeat(bag_at[ws] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(ws) else ws
    return bag_flat[first + np.arange(len(first))], sizes


def lean(y: np.ndarray, ids: list[np.ndarray], bag_flat: np.ndarray, bag_at: np.ndarray, buckets: int, prior: float) -> np.ndarray:
    """How much likelier each n-gram is in documents of label 1: the log of its odds over those of all, shrunk by ``prior`` documents."""
    seen = np.zeros((2, buckets))
    for d, w in enumerate(ids):
        mark = np.zeros(buckets, bool)
        mark[bagged(np.unique(w), bag_flat, bag_at)[0]] = True
        seen[y[d]] += mark
    base = np.bincount(y, minlength=2) / len(y)
    return np.log((seen[1] + prior * base[1]) / (seen[0] + prior * base[0])) - np.log(base[1] / base[0])


def descend(texts: list[str | None], y: np.ndarray, *, epochs: int, rate: float = 0.5, batch: int = 256, hard: int = 3, prior: float = 10.0, seed: int = 7, **shape) -> Model:
    """Joint AdaGrad steps on vectors, weights and bias; the loss weighs both classes equally.

    Vectors start from small random numbers and, along the softmax's direction, from how much each n-gram leans to label 1 in the
    documents' counts. The first worst windows are then the likely ones, which random vectors find only by many toxic documents.
    """
    model = Model(seed=seed, **shape)
    model.trained = True
    vocab: dict[str, int] = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in words(t)], np.int32) for t in texts]  # one document's words at a time
    names = list(vocab)
    parts = [grams(names[lo : lo + 20_000], model.buckets) for lo in range(0, len(names), 20_000)]
    bag_flat = np.concatenate([flat.astype(np.int32) for flat, _ in parts]) if parts else np.empty(0, np.int32)
    bag_at = np.r_[0, np.cumsum(np.concatenate([size for _, size in parts]))] if parts else np.zeros(1, np.int64)
    del vocab, names, parts
    last = [before(w) for w in ids]
    gap = model.weights[1] - model.weights[0]
    model.vectors += (lean(y, ids, bag_flat, bag_at, model.buckets, prior)[:, None] * gap / (gap @ gap)).astype(np.float32)
    rng = np.random.default_rng(seed)
    class_weight = (len(y) / 2 / np.bincount(y, minlength=2)).astype(np.float32)
    squares = [np.full_like(model.vectors[:, :1], 1e-4), np.full_like(model.weights, 1e-4), np.full_like(model.bias, 1e-4)]
    for _ in range(epochs):
        # The windows to learn from: of each document the worst ones.
        slope = model.vectors @ (model.weights[1] - model.weights[0])
        word_score = np.add.reduceat(slope[bag_flat], bag_at[:-1]) / np.diff(bag_at) if len(bag_flat) else np.empty(0, np.float32)
        chosen: list[tuple[int, int, int]] = []
        for d, w in enumerate(ids):
            n = max(1, len(w) - model.window + 1)
            z = window_sums(word_score[w], last[d], model.window)[:n] if len(w) else np.zeros(1)
            pick = []
            for _ in range(1 if y[d] else hard):  # they overlap by half at most
                k = int(np.argmax(z))
                if not np.isfinite(z[k]):
                    break
                pick.append(k)
                z[max(0, k - model.window // 2 + 1) : k + model.window // 2] = -np.inf
            chosen += [(d, int(k), min(int(k) + model.window, len(w))) for k in pick]
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), batch):
            part = [chosen[i] for i in order[lo : lo + batch]]
            seq = [ids[d][a:b][last[d][a:b] < a] for d, a, b in part]
            owner_w = np.repeat(np.arange(len(part)), [len(s) for s in seq])
            flat_w = np.concatenate(seq)
            g, sizes = bagged(flat_w, bag_flat, bag_at)
            owner = np.repeat(owner_w, sizes)
            share = np.repeat(1.0 / (sizes * model.window), sizes).astype(np.float32)
            vec = model.vectors[g] * share[:, None]
            mean = np.stack([np.bincount(owner, vec[:, j], len(part)) for j in range(model.dim)], axis=1).astype(np.float32)
            z = mean @ model.weights.T + model.bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            target = y[[d for d, _, _ in part]]
            err = p
            err[np.arange(len(part)), target] -= 1
            err *= class_weight[target][:, None] / len(part)
            gw, gb, gm = err.T @ mean, err.sum(axis=0), err @ model.weights
            rows, inv = np.unique(g, return_inverse=True)
            gv = np.stack([np.bincount(inv, gm[owner, j] * share, len(rows)) for j in range(model.dim)], axis=1).astype(np.float32)
            squares[0][rows] += (gv**2).mean(axis=1, keepdims=True)
            squares[1] += gw**2
            squares[2] += gb**2
            model.vectors[rows] -= rate * gv / np.sqrt(squares[0][rows])
            model.weights -= 0.2 * rate * gw / np.sqrt(squares[1])
            model.bias -= 0.2 * rate * gb / np.sqrt(squares[2])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", learn: F.Column | None = None, max_rows: tuple[int, int] = (5000, 3000), max_bytes: int = 64 << 20, **options) -> Model:
    """Train on the labelled rows that ``learn`` (a predicate on the label rows) allows, ``max_rows`` of label 0 and 1 and ``max_bytes`` of text at most."""
    sample = labelled_texts(docs, labels, id_col=id_col, text=text, label=label, learn=learn, max_rows=max_rows, max_bytes=max_bytes)
    return fitted(sample, lambda texts, marks: train(texts, marks, **options))


def scored(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per document: ``row`` (the kept columns) and ``score`` (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("score", T.DoubleType())])
    return map_texts(docs, [docs[text].cast("string")], docs.columns if keep is None else keep, fields, lambda: lambda texts: [sent.value.scores(texts)])


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn=crc32_mod("doc_id", 3) != 1)
    out = scored(docs, model, keep=["doc_id"]).withColumn("held_out", crc32_mod("row.doc_id", 3) == 1)
    return unpack(out, F.col("held_out"), F.col("score"), (F.col("score") >= 0.7).cast("int").alias("predicted"))
