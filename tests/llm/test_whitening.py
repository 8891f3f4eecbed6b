"""Whitening against exact fractions and double-precision eigenvectors, and the refinement on spectra that are known."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tideline.llm import whitening

EIGENVALUES = {
    "spread": np.linspace(1, 10, 48),
    "graded": 10.0 ** np.linspace(-8, 0, 48),
    "cluster": np.r_[np.linspace(1, 10, 44), 5 + np.arange(1, 5) * 1e-6],
    "equal": np.r_[np.linspace(1, 10, 44), 5, 5, 5, 5],
    "null": np.r_[np.linspace(1, 10, 44), 0, 0, 0, 0],
    "one": np.array([3.0]),
    "same": np.ones(6),
}


@pytest.mark.parametrize("name", EIGENVALUES)
def test_refinement(name):
    want = np.sort(EIGENVALUES[name])[::-1]
    d, rng = len(want), np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(2):
        q = q @ (3 * np.eye(d) - q.T @ q) / 2
    a = (q * want) @ q.T
    a = (a + a.T) / 2
    first = np.linalg.eigh(a.astype(np.float32))[1]
    assert d == 1 or np.abs(first.T @ first - np.eye(d)).max() > 1e-9  # what is corrected has float32's errors
    values, x = whitening.components(a, float(np.trace(a)))
    assert np.abs(values - want).max() < 1e-14 * d * want[0]
    assert np.abs(x.T @ x - np.eye(d)).max() < 2e-15
    assert np.abs(a.astype(float) @ x - x * values).max() < 1e-14 * want[0] * math.sqrt(d)
    apart = np.array([i for i in range(d) if np.abs(np.delete(want, i) - want[i]).min(initial=9) > 1e-9])
    if len(apart):
        gap = min(np.abs(np.delete(want, i) - want[i]).min(initial=9) for i in apart)
        assert (1 - np.abs(np.einsum("ij,ij->j", x, q.astype(float))))[apart].max() < 1e-14 + (1e-15 * want[0] / gap) ** 2


def exact(rows, dim, most=32):
    """id -> (deviation, whitened, explained) by Python's integers and double-precision eigenvectors."""
    x = {i: [math.floor(64 * float(c)) + 1_000_000 for c in v] for i, v in rows}
    n = len(x)
    total = [sum(v[j] for v in x.values()) for j in range(dim)]
    off = {i: [n * c - s for c, s in zip(v, total)] for i, v in x.items()}
    cov = np.array([[sum(o[a] * o[b] for o in off.values()) / n**3 for b in range(dim)] for a in range(dim)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return {i: (sum(c * c for c in o), np.array([c / n for c in o]) @ u / np.sqrt(e), e / np.trace(cov)) for i, o in off.items()}, n


def check(out, want, n, most):
    got = defaultdict(dict)
    for r in out:
        got[r.vec_id][r.component] = r
    assert got.keys() == want.keys()
    k = min(most, len(next(iter(want.values()))[1]))
    sign = None
    for i, (deviation, white, explained) in want.items():
        assert sorted(got[i]) == list(range(1, k + 1))
        assert all(r.deviation == deviation and r.n == n and r.identity_error < 1e-10 for r in got[i].values())
        mine = np.array([got[i][c].whitened for c in range(1, k + 1)])
        sign = np.sign(mine * white) if sign is None or (sign == 0).any() else sign
        assert np.abs(mine - sign * white).max() < 1e-9
        assert np.allclose([got[i][c].explained for c in range(1, k + 1)], explained, rtol=1e-9)


def test_whole_query(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 40)) * np.linspace(3, 0.2, 40)
    rows = [(i, base[i].astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # a third of all are one vector
    odd = [(2000, None), (2001, [None] * 40), (2002, [float("nan"), *[0.0] * 39]), (2003, [float("inf"), *[0.0] * 39]), (2004, [1.0] * 39), (2005, [])]
    spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.op12_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    want, n = exact(rows, 40)
    check(out.collect(), want, n, 32)


def test_odd_tables(spark, tmp_path):
    schema = "vec_id long, embedding array<double>"

    def run(rows, name):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return whitening.op12_whitening(spark, f"{tmp_path}/{name}").orderBy("vec_id", "component").collect()

    assert run([], "empty") == []
    assert run([(1, None)], "nulls") == []
    (one,) = run([(1, [0.3])], "one")
    assert (one.n, one.deviation, one.whitened, one.explained, one.identity_error) == (1, 0, None, None, None)
    # a dimension without variance gives components without values; the others are whitened
    rows = [(i, [i / 7, 5.0, float((i * i) % 11)]) for i in range(30)]
    out = run(rows, "flat")
    assert [r.whitened is None for r in out[:3]] == [False, False, True] and out[0].identity_error < 1e-12 and out[2].explained < 1e-15
    assert run([*rows, *rows], "twice")[0].n == 60
    # a mean of many digits costs none: the same vectors far away, and entries beyond 2^26, whose products exceed longs
    rng = np.random.default_rng(4)
    for k, (far, spread) in enumerate([(1e9, 2.0), (0.0, 3e8)]):
        rows = [(i, (far + spread * rng.normal(size=3)).tolist()) for i in range(40)]
        want, n = exact(rows, 3)
        out = run(rows, f"far{k}")
        if k:
            assert {r.deviation for r in out} == {None}
            want = {i: (None, *w[1:]) for i, w in want.items()}
        check(out, want, n, 32)
    big = run([(1, [1e30, 1.0]), (2, [-1e30, 2.0]), (3, [0.0, 3.0])], "big")
    assert len(big) == 6 and all(r.n == 3 for r in big)


def test_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 5, 6.0), (2, [2.0, 1.0], 7, 8.0), (3, [4.0, 4.5], 9, 9.0)], "n long, embedding array<double>, x int, whitened double")
    got = {r.row.n: r for r in whitening.whiten(df).collect()}
    assert got[1].row.whitened == 6.0 and got[3].row.x == 9 and len(got[2].whitened) == 2 and got[1].n == 3
    wide = spark.range(700).selectExpr("id as vec_id", "transform(sequence(1, 300), i -> sin(id * i) + cos(id * id + i)) as embedding")
    out = whitening.whiten(wide, keep=["vec_id"]).collect()
    assert len(out) == 700 and len(out[0].whitened) == 32 and out[0].identity_error < 1e-9
