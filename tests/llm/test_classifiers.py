"""Held-out accuracy and odd inputs of the two classifiers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from tideline.llm import quality, toxicity
from tideline.llm.common import labelled_texts

from .helpers import LONG, prose, write_tables

STEMS = ["grumbo", "vilkat", "snorfel"]
ENDS = ["a", "ing", "ers", "ous", "ity", "ed"]


def toxic_corpus(n=900):
    rng = random.Random(11)
    docs, labels = [], []
    for i in range(n):
        words = prose(i, rng.randrange(20, 200)).split()
        bad = int(rng.random() < 0.25)
        for _ in range(rng.randrange(2, 5) if bad else 0):
            # half of the held-out fold has endings that are new there: only the n-grams of the stem tell
            ends = ENDS[:3] if zlib.crc32(str(i).encode()) % 3 != 1 or i % 2 else ENDS[3:]
            words.insert(rng.randrange(len(words)), rng.choice(STEMS) + rng.choice(ends))
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - bad, bad))
    return docs, labels


ODD = [(5000, None), (5001, ""), (5002, " . "), (5003, LONG), (5003, LONG), (None, "no id")]


def test_toxicity(spark, tmp_path):
    docs, labels = toxic_corpus()
    d = write_tables(spark, tmp_path / "t", docs + ODD, labels=(labels + [(9999, 1, 1), (None, 1, 1), (5001, None, None)], "doc_id long, quality int, toxic int"))
    out = toxicity.op1_toxicity(spark, d).collect()
    assert len(out) == len(docs) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in out)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    seen = [r for r in held if r.doc_id % 2]
    hit = sum(r.predicted and truth[r.doc_id] for r in seen)
    assert hit >= 0.8 * sum(truth[r.doc_id] for r in seen) and hit >= 0.9 * sum(r.predicted for r in seen)
    bad, good = ([r.score for r in held if truth[r.doc_id] == v] for v in (1, 0))
    assert np.mean([[b > g for g in good] for b in bad]) > 0.97  # unseen endings rank high too
    assert len({r.score for r in out if r.doc_id == 5003}) == 1


def test_unseen_labels_are_not_used(spark, tmp_path):
    """Turning every held-out label round changes no score."""
    docs, labels = toxic_corpus(150)
    turned = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a = toxicity.op1_toxicity(spark, write_tables(spark, tmp_path / "a", docs, labels=(labels, schema))).collect()
    b = toxicity.op1_toxicity(spark, write_tables(spark, tmp_path / "b", docs, labels=(turned, schema))).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_without_labels(spark, tmp_path):
    d = write_tables(spark, tmp_path / "t", ODD, labels=([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxicity.op1_toxicity(spark, d).collect()} == {0.0}
    assert all(r.score < 1e-9 for r in quality.op5_quality(spark, d).collect())
    e = write_tables(spark, tmp_path / "e", [], labels=([(1, 1, 1)], "doc_id long, quality int, toxic int"))
    assert toxicity.op1_toxicity(spark, e).count() == 0 and quality.op5_quality(spark, e).count() == 0


def test_grams():
    flat, sizes = toxicity.grams(["ab", "abcdefgh", ""], 1 << 16)
    # <ab>: two 3-grams, one 4-gram, the word; an empty word is only itself
    assert sizes.tolist() == [4, 8 + 7 + 6 + 5 + 1, 1] and len(flat) == sizes.sum()
    alone, _ = toxicity.grams(["abcdefgh"], 1 << 16)
    assert sorted(flat[4:-1].tolist()) == sorted(alone.tolist())
    assert toxicity.before(np.array([1, 2, 1, 3, 1, 1])).tolist() == [-1, -1, 0, -1, 2, 4]


def scalar_bag(w):
    """The hashes of a word's n-grams and of the word, before they are cut to buckets."""
    mask, marked = (1 << 64) - 1, f"<{w}>"
    bag = [xxhash.xxh32_intdigest(marked, 1)]
    for n in range(3, 7):
        for a in range(len(marked) - n + 1):
            h = 0
            for c in marked[a : a + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
            h ^= h >> 29
            bag.append((h * (0xBF58476D1CE4E5B9 + 2 * n) & mask) >> 32)
    return bag


def scalar_score(model, text):
    """A document's score, gram by gram and window by window."""
    slope = model.vectors.astype(float) @ (model.weights[1] - model.weights[0]).astype(float)

    def word(w):
        bag = scalar_bag(w)
        return sum(slope[g % model.buckets] for g in bag) / len(bag)

    ws = toxicity.words(text)
    value = {w: word(w) for w in set(ws)}
    best = max((sum(value[w] for w in dict.fromkeys(ws[a : a + model.window])) for a in range(max(1, len(ws) - model.window + 1))), default=0.0)
    return toxicity.sigmoid(model.scale * (best / model.window + float(model.bias[1] - model.bias[0])) + model.shift)


def scalar_training(texts, labels, epochs, batch, hard=3, rate=0.5, prior=10.0, seed=7, **shape):
    """Vectors, weights and bias by loops over documents, words and n-grams."""
    start = toxicity.Model(seed=seed, **shape)
    vec, weights, bias = start.vectors.astype(float), start.weights.astype(float), np.zeros(2)
    docs, size = [toxicity.words(t) for t in texts], start.window
    bags = {w: [g % start.buckets for g in scalar_bag(w)] for d in docs for w in d}
    seen = [Counter(g for d, y in zip(docs, labels) if y == k for g in {g for w in d for g in bags[w]}) for k in (0, 1)]
    ones = sum(labels) / len(labels)
    gap = weights[1] - weights[0]
    for g in range(start.buckets):
        odds = math.log((seen[1][g] + prior * ones) / (seen[0][g] + prior * (1 - ones))) - math.log(ones / (1 - ones))
        vec[g] += odds * gap / (gap @ gap)
    weigh = [len(labels) / 2 / (len(labels) - sum(labels)), len(labels) / 2 / sum(labels)]
    rng = np.random.default_rng(seed)
    sums, sums_w, sums_b = defaultdict(lambda: 1e-4), np.full(weights.shape, 1e-4), np.full(2, 1e-4)

    def mean(ws):
        return sum((vec[bags[w]].mean(axis=0) for w in ws), np.zeros(start.dim)) / size

    for _ in range(epochs):
        chosen = []
        for d, y in zip(docs, labels):
            at = [list(dict.fromkeys(d[a : a + size])) for a in range(max(1, len(d) - size + 1))]
            z = {a: float(mean(ws) @ (weights[1] - weights[0])) for a, ws in enumerate(at)}
            for _ in range(1 if y else hard):
                if z:
                    worst = max(z, key=z.get)
                    chosen.append((at[worst], y))
                    z = {a: v for a, v in z.items() if not worst - size // 2 < a < worst + size // 2}
        order = rng.permutation(len(chosen))
        for lo in range(0, len(order), batch):
            part = [chosen[i] for i in order[lo : lo + batch]]
            grow, grow_w, grow_b = defaultdict(lambda: np.zeros(start.dim)), np.zeros(weights.shape), np.zeros(2)
            for ws, y in part:
                m = mean(ws)
                e = np.exp(weights @ m + bias)
                err = (e / e.sum() - np.eye(2)[y]) * weigh[y] / len(part)
                grow_w += np.outer(err, m)
                grow_b += err
                for w in ws:
                    for g in bags[w]:
                        grow[g] = grow[g] + err @ weights / (len(bags[w]) * size)
            for g, v in grow.items():
                sums[g] += (v**2).mean()
                vec[g] -= rate * v / math.sqrt(sums[g])
            sums_w += grow_w**2
            sums_b += grow_b**2
            weights = weights - 0.2 * rate * grow_w / np.sqrt(sums_w)
            bias = bias - 0.2 * rate * grow_b / np.sqrt(sums_b)
    return vec, weights, bias


def test_toxicity_training_by_hand():
    """The joint steps are those of plain loops."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(24)]
    labels = [int(i % 3 == 0) for i in range(24)]
    texts = [t + " grumbo" * y for t, y in zip(texts, labels)] + [None]
    labels.append(0)
    shape = {"buckets": 1 << 10, "dim": 4, "window": 5}
    got = toxicity.descend(texts, np.array(labels), epochs=3, batch=8, **shape)
    vec, weights, bias = scalar_training(texts, labels, 3, 8, **shape)
    for a, b in ((got.vectors, vec), (got.weights, weights), (got.bias, bias)):
        assert np.allclose(a, b, atol=2e-3), np.abs(a - b).max()


def test_toxicity_from_few_rows():
    """A few toxic rows: every fold calibrates, most held-out toxic texts are found and clean ones are left."""
    docs, labels = toxic_corpus(900)
    few = [(t, y) for (_, t), (_, _, y) in zip(docs[:150], labels)]
    assert sum(y for _, y in few) < 50
    model = toxicity.train([t for t, _ in few], [y for _, y in few])
    rest = list(zip(model.scores([t for _, t in docs[150:]]), [y for _, _, y in labels[150:]]))
    assert sum(s >= 0.7 for s, y in rest if y) > 0.6 * sum(y for _, y in rest)
    assert sum(s >= 0.7 for s, y in rest if not y) < 0.02 * len(rest)


def test_toxicity_scores_by_hand(spark, tmp_path):
    """The query's scores are those of the fitted model, word by word over whole texts; repeats count once a window."""
    docs, labels = toxic_corpus(200)
    docs += [(5000, None), (5001, ""), (5002, prose(1, 20_000) + " grumboing"), (5003, "grumboa x " * 40 + "vilkating"), (5004, "grumboa"), (5005, "grumboa " * 30)]
    d = write_tables(spark, tmp_path / "t", docs, labels=(labels, "doc_id long, quality int, toxic int"))
    tables = [spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels")]
    model = toxicity.fit(*tables, learn=toxicity.crc32_mod("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.op1_toxicity(spark, d).collect()}
    assert all(abs(got[i] - scalar_score(model, t)) < 1e-6 for i, t in docs)


def test_labelled_texts_are_bounded(spark):
    """A repeated id gives one text, and texts stop at the bound on bytes."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "x" * 900), (3, "y" * 900), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1)], "doc_id long, toxic int")
    rows = labelled_texts(docs, labels, id_col="doc_id", text="text", label="toxic", learn=None, max_rows=(9, 9), max_bytes=1000).collect()
    assert len(rows) == 3 and sum(len(r.text or "") for r in rows) <= 1000 and {r.label for r in rows if r.text is None} == {1}


def scalar_quality(texts, labels, tests, buckets=1 << 18, alpha=1.0, beta=1.0, l1=0.005, l2=0.1, epochs=8):
    """Scores of ``tests`` after follow-the-regularised-leader steps with plain dictionaries."""
    mask = (1 << 64) - 1

    def features(t):
        ws = (t or "").lower().split()
        one = [xxhash.xxh64_intdigest(w, 3) for w in ws]
        two = [(a * 0x9E3779B97F4A7C15 & mask) ^ b for a, b in zip(one, one[1:])]
        two = [(x ^ x >> 31) * 0xD6E8FEB86659FD93 & mask for x in two]
        counts = Counter((x >> 32) % buckets for x in one + two)
        return {k: math.sqrt(c / max(1, len(one + two))) for k, c in counts.items()}

    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0

    def w(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    def score(f):
        return quality.sigmoid(sum(w(k) * v for k, v in f.items()) - bz / ((beta + math.sqrt(bn)) / alpha))

    rows, share = [features(t) for t in texts], np.bincount(labels, minlength=2) / len(labels)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, y = rows[i], labels[i]
            weight, p, bias, old = (0.5 / share[y]) ** 0.5, score(f), -bz / ((beta + math.sqrt(bn)) / alpha), {k: w(k) for k in f}
            for k, v in f.items():
                g = weight * (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * old[k]
                n[k] += g * g
            g = weight * (p - y)
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
    return [score(features(t)) for t in tests]


def test_quality_scores_by_hand(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, prose(i, 12 + i % 30) if i % 3 else "click here " * rng.randrange(1, 9) + prose(i, 4)) for i in range(90)] + [(500, None), (501, ""), (502, prose(3, 20_000))]
    labels = [(i, int(i % 3 > 0), 0) for i in range(90)]
    d = write_tables(spark, tmp_path / "t", docs, labels=(labels, "doc_id long, quality int, toxic int"))
    learn = sorted((str(i), t, q) for (i, t), (_, q, _) in zip(docs, labels) if zlib.crc32(str(i).encode()) % 5)
    want = scalar_quality([t for _, t, _ in learn], [q for *_, q in learn], [t for _, t in docs])
    got = {r.doc_id: r.score for r in quality.op5_quality(spark, d).collect()}
    assert all(abs(got[i] - x) < 1e-6 for (i, _), x in zip(docs, want))


def test_quality(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(800):
        good = int(rng.random() < 0.8)
        text = prose(i, rng.randrange(20, 150))
        docs.append((i, text if good else " ".join([rng.choice(["click here", "buy now", "free free"]) for _ in range(20)]) + " " + text[:200]))
        labels.append((i, good, 0))
    d = write_tables(spark, tmp_path / "t", docs + ODD, labels=(labels, "doc_id long, quality int, toxic int"))
    out = quality.op5_quality(spark, d).collect()
    assert len(out) == len(docs) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


def test_ftrl_follows_the_closed_form():
    """One coordinate, by the published update."""
    m = quality.Ftrl(buckets=4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z = n = 0.0
    for y in (1, 0, 1, 1):
        w = 0.0 if abs(z) <= 0.1 else -(z - np.sign(z) * 0.1) / ((1 + np.sqrt(n)) / 0.5 + 0.2)
        assert m.weights(np.array([2]))[0] == w
        bias = m.bias
        p = quality.sigmoid(w + bias)
        m.step(np.array([2]), np.array([1.0]), y, 1.0)
        g = p - y
        z, n = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / 0.5 * w, n + g * g
        assert abs(m.z[2] - z) < 1e-15 and abs(m.n[2] - n) < 1e-15
