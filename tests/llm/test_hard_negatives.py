"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from tideline.llm import hard_negatives


def brute(rows):
    """Rows (id, vector, label) that take part -> the result as sorted tuples."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        x = tuple(math.floor(256 * float(np.float32(c))) for c in v)
        label = (label + 1) % 10 if i % 7 == 0 else label
        good[i] = min(good.get(i, (label, x)), (label, x))
    out = []
    for a, (label, q) in good.items():
        if a % 100:
            continue
        score = {b: sum(s * t for s, t in zip(q, x)) for b, (_, x) in good.items() if b != a and len(x) == len(q)}
        ranked = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in ranked if good[b][0] == label][:5]:
            fits = [b for b in ranked if good[b][0] != label and 30 * score[p] <= 100 * score[b] <= 90 * score[p]]
            out += [(a, p, r, b, score[p], score[b]) for r, b in enumerate(fits[:10], 1)]
    return sorted(out)


def run(spark, path, rows, **options):
    spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    if not options:
        out = hard_negatives.op13_hard_negatives(spark, str(path))
        assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
        return sorted(map(tuple, out.collect()))
    df = spark.read.parquet(f"{path}/embeddings.parquet").selectExpr("vec_id", "embedding", "IF(vec_id % 7 = 0, (label + 1) % 10, label) AS label")
    return sorted(map(tuple, hard_negatives.mine(df, "vec_id % 100 = 0", **options).collect()))


def made(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.astype(np.float32).tolist(), int(label)) for i, (v, label) in enumerate(zip(x, rng.integers(0, 10, n)))]


@pytest.mark.parametrize("spread,options", [(0.3, {}), (0.3, {"codes": 7, "block_rows": 90}), (5.0, {"codes": 4, "block_rows": 200})])
def test_against_brute_force(spark, tmp_path, spread, options):
    rows = made(1, 1200, 16, spread)
    rows = [(i, rows[5][1], label) if i % 3 == 1 else (i, v, label) for i, v, label in rows]  # a third of all are copies, a part of their own
    want = brute(rows)
    assert want and run(spark, tmp_path / "t", rows, **options) == want


def test_odd_tables(spark, tmp_path):
    assert run(spark, tmp_path / "empty", []) == []
    assert run(spark, tmp_path / "nulls", [(100, None, 1), (None, [1.0], 1), (200, [1.0], None)]) == []
    assert run(spark, tmp_path / "one", [(100, [1.0, 2.0], 1)]) == []
    small = [(0, [1.0, 0.0], 3), (1, [0.5, 1.0], 4), (2, [0.4, 3.0], 9), (3, [0.9, 1.0], 4), (3, [0.9, 1.0], 4), (100, [-1.0, 0.0], 4), (4, [0.5, 7.0], 4), (5, [0.45, 0.0], 9)]
    assert run(spark, tmp_path / "small", small) == brute(small) != []
    rng = np.random.default_rng(2)
    whole = [(i, [float(c) for c in rng.integers(-2, 3, 3)], int(rng.integers(0, 3))) for i in range(600)]  # ties everywhere, scores of 0
    odd = [(700, [float("nan"), 1, 1], 1), (800, [float("inf"), 1.0, 1.0], 1), (900, [None, 1.0, 1.0], 1), (1000, [1.0, 1.0], 1), (1001, [1.0, 2.0], 1), (1002, [0.5, 1.0], 2), (1100, [2.0], 1), (1103, [1.0], 1), (1104, [1.0], 2), (1200, [], 1)]
    odd = [(i, v and [None if c is None else float(c) for c in v], label) for i, v, label in odd]
    assert run(spark, tmp_path / "ties", whole + odd) == brute(whole + odd)
    big = [(i, (1e4 * rng.normal(size=4)).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(400)]  # products beyond 2^53 are long
    assert run(spark, tmp_path / "big", big) == brute(big)


def test_certified_search_visits_what_it_must():
    """On clustered vectors the bounds leave most cells out, and the result is the same as over all rows."""
    rng = np.random.default_rng(3)
    centres = 200 * rng.normal(size=(8, 8))
    x = np.rint(centres[rng.integers(0, 8, 4000)] + 2 * rng.normal(size=(4000, 8))).astype(np.int64)
    space = hard_negatives.Space(tuple(hard_negatives.kmeans(h.astype(float), 8) for h in hard_negatives.halves(x)))
    code = [hard_negatives.nearest(h.astype(float), c) for h, c in zip(hard_negatives.halves(x), space.codes)]
    far = [np.linalg.norm(h - c[k], axis=1) for h, c, k in zip(hard_negatives.halves(x), space.codes, code)]
    cells = {}
    for i, j, a, b in zip(*map(np.ndarray.tolist, code), *map(np.ndarray.tolist, far)):
        n, r, s = cells.get((i, j), (0, 0, 0))
        cells[i, j] = (n + 1, max(r, a), max(s, b))
    space.fill([(*c, *v) for c, v in cells.items()], 10**9, 0)
    labels, ids = rng.integers(0, 2, 4000), np.arange(4000)
    part = hard_negatives.Part(space, ids, labels, *code, x)
    visited = []
    plain = hard_negatives.dots
    hard_negatives.dots = lambda a, q, m: visited.append(len(a)) or plain(a, q, m)
    try:
        for q in range(50):
            score = x @ x[q]
            top = int(score[(labels == labels[q]) & (ids != q)].max())
            lo, hi = top * 30 // 100, top * 90 // 100
            (found, scores), = part.search(q, int(labels[q]), x[q], [lo], [hi], 10, False)
            fits = np.flatnonzero((labels != labels[q]) & (score >= lo) & (score <= hi))
            want = fits[np.lexsort((fits, -score[fits]))][:10]
            assert found.tolist() == want.tolist() and scores.tolist() == score[want].tolist()
    finally:
        hard_negatives.dots = plain
    assert sum(visited) < 50 * 4000 / 3
