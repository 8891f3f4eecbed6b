"""Whitening of embeddings: a distributed covariance, and mixed-precision refinement of its eigenvectors.

An entry c becomes the integer ``floor(scale * c) + shift``. Sums are taken in one pass; in a second one the vectors are centred by the
rounded mean and multiplied, all in exact integers, so that neither the shift nor the number of rows costs digits. Eigenvectors of the
covariance are found in float32 and then corrected by the iteration of Ogita and Aishima, which only multiplies matrices: from
``R = I - X'X`` and ``S = X'AX`` it takes the correction of every pair of eigenvectors whose eigenvalues are apart. The products are
taken in double precision while there is much to correct, and then in the widest float of the machine. Pairs whose eigenvalues lie closer than the
error of ``S`` can't be told apart by that step: such a cluster is rotated by the eigenvectors of its own small matrix,
``X_c' (A - mean) X_c``, in which the shift brings out the differences, and the iteration goes on.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, and so are vectors of another length than most
(of lengths that are equally frequent the larger counts) and empty ones; integers beyond 2^52 count as that; null ids, repeated ids and repeated rows
each count as rows; a component without variance (eigenvalue 0, up to rounding) has ``whitened`` null and no part in the identity
error, ``explained`` is null if there is no variance at all, ``deviation`` is null where it exceeds a long; fewer dimensions than
components give fewer rows; an empty table gives an empty result; extra columns pass through inside ``row``.

Scale: three narrow passes over the written integers. Each task adds its rows to one matrix; matrices meet row by row, keyed by the
row's number, so that no task gets them whole; the driver holds matrices of dimensions squared, whatever the number of vectors.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

#: Sums of integers travel as three parts of 40 bits, the last one with the sign.
LIMB = 40
#: Rows whose products are added at once.
BLOCK = 4096


def refined(a: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the symmetric ``a``, by falling eigenvalue, from approximate eigenvectors ``x``."""
    d = len(a)
    wide = np.longdouble
    # The iteration wants a first guess that is nearly orthonormal and spans the space.
    kind, x = np.float64, np.linalg.qr(x.astype(np.float64))[0]
    least, kept, idle = np.inf, x, 0
    for _ in range(rounds):
        m, y = a.astype(kind), x.astype(kind)
        r = np.eye(d, dtype=kind) - y.T @ y
        s = y.T @ (m @ y)
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        y, r, s, values = y[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        top = np.abs(values).max(initial=0)
        error = float(np.sqrt(((s - np.diag(values)) ** 2).sum()) + top * np.sqrt((r**2).sum()))
        if error < least / 2:
            least, kept, idle = error, y, 0
        elif kind is wide:
            kept, least, idle = (y, error, idle + 1) if error < least else (kept, least, idle + 1)
        if kind is not wide and error >= least:
            kind, x, least = wide, kept, np.inf
            continue
        if kind is wide and (idle >= 4 or error <= float(d * np.finfo(wide).eps * top)):
            break
        limit = 2 * error + float(d * np.finfo(kind).eps * top)
        near = np.abs(values[:, None] - values[None, :]) <= limit
        gaps = np.where(near, 1, values[None, :] - values[:, None])
        x = y + y @ np.where(near, r / 2, (s + values[None, :] * r) / gaps)
        for c in np.split(np.arange(d), np.flatnonzero(values[:-1] - values[1:] > limit) + 1):
            if len(c) > 1:
                x[:, c] = _apart(a, x[:, c], kind)
    y = kept.astype(wide)
    y = y + y @ ((np.eye(d) - y.T @ y) / 2)  # orthonormal to the last digit
    values = np.einsum("ij,ij->j", y, a.astype(wide) @ y) / np.einsum("ij,ij->j", y, y)
    order = np.argsort(-values, kind="stable")
    y = y / np.sqrt(np.einsum("ij,ij->j", y, y))
    return values[order].astype(np.float64), y[:, order].astype(np.float64)


def _apart(a: np.ndarray, x: np.ndarray, kind: type) -> np.ndarray:
    """A basis of the cluster's space that diagonalises ``a`` in it: the small matrix is shifted by its mean, so that what is left are
    the differences within the cluster."""
    y, wide = x.astype(np.longdouble), a.astype(np.longdouble)
    g = y.T @ y
    y = y @ ((3 * np.eye(len(g)) - g) / 2)  # orthonormal to the square of what was missing
    mean = np.trace(y.T @ wide @ y) / y.shape[1]
    small = (y.T @ (wide @ y - mean * y)).astype(np.float64)
    small = (small + small.T) / 2
    top = np.abs(small).max()
    if not top > 0:
        return y.astype(kind)
    return (y @ np.linalg.eigh(small / top)[1][:, ::-1]).astype(kind)


def components(a: np.ndarray, trace: float) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by falling eigenvalue, to double precision."""
    if not len(a) or not trace > 0:
        return np.zeros(len(a)), np.eye(len(a))
    top = float(np.abs(a).max())
    scaled = a / np.longdouble(top)
    first = np.linalg.eigh(scaled.astype(np.float32))[1][:, ::-1]
    values, vectors = refined(scaled, first)
    return values * top, vectors


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return np.asarray(column.flatten(), dtype).reshape(len(column), -1)


def products(z: np.ndarray) -> np.ndarray:
    """``z'z`` in exact integers: by floats where all sums stay below 2^53, by long integers below 2^63, else by Python's."""
    most = int(np.abs(z).max(initial=0))
    if most * most * len(z) < 1 << 53:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    if most * most * len(z) < 1 << 63:
        return z.T @ z
    big = z.astype(object)
    return big.T @ big


def limbs(g: np.ndarray) -> list[np.ndarray]:
    """Three arrays of longs whose weighted sum is ``g``."""
    if g.dtype != object:
        return [g & ((1 << LIMB) - 1), g >> LIMB, np.zeros_like(g)]
    return [np.array([(int(v) >> s) & ((1 << LIMB) - 1) if s < 2 * LIMB else int(v) >> s for v in g.ravel()], np.int64).reshape(g.shape) for s in (0, LIMB, 2 * LIMB)]


def whole(lo: int, mid: int, hi: int) -> int:
    return lo + (mid << LIMB) + (hi << 2 * LIMB)


def sums_of_rows(parts: DataFrame, dim: int) -> list[list[int]]:
    """``parts(i, lo, mid, hi)`` with arrays of longs added up by row number i; exact, row by row."""
    add = lambda c: F.array(*[F.sum(F.col(c)[j]) for j in range(dim)]).alias(c)
    if dim <= 256:  # one expression a column is quicker, but too long for wide vectors
        rows = parts.groupBy("i").agg(add("lo"), add("mid"), add("hi"))
    else:

        def added(t: pa.Table) -> pa.Table:
            return pa.table({"i": t.column("i").slice(0, 1), **{c: pa.array([matrix(t.column(c).combine_chunks(), np.int64).sum(axis=0)], pa.list_(pa.int64())) for c in ("lo", "mid", "hi")}})

        rows = parts.groupBy("i").applyInArrow(added, parts.schema)
    return [[whole(*x) for x in zip(r.lo, r.mid, r.hi)] for r in sorted(rows.collect(), key=lambda r: r.i)]  # dim rows


def integers(vectors: DataFrame, vector: str, keep: list[str], scale: int, shift: int) -> DataFrame:
    """(row, x array<long>) of the vectors that take part, of any length."""
    c = F.col("v")
    good = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size(c) > 0)
    most = float(1 << 52)
    df = vectors.select(F.struct(*[vectors[k] for k in keep]).alias("row"), vectors[vector].cast("array<double>").alias("v")).where(c.isNotNull()).where(good)
    return df.select("row", F.transform(c, lambda e: F.floor(F.greatest(F.least(e * scale, F.lit(most)), F.lit(-most))).cast("bigint") + shift).alias("x"))


def whiten(vectors: DataFrame, *, vector: str = "embedding", keep: list[str] | None = None, most: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Per vector: ``row`` (the kept columns), n, deviation, whitened (array<double>), explained (array<double>), identity_error.

    The fit list is all vectors that take part.
    """
    spark = vectors.sparkSession
    keep = vectors.columns if keep is None else keep
    rows = written(integers(vectors, vector, keep, scale, shift), "whiten-rows")
    out = T.StructType([rows.schema["row"], *T._parse_datatype_string("n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double").fields])
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], out)
    dim, n = sizes.dim, sizes.n
    rows = rows.where(F.size("x") == dim)

    def added(make):
        """Sums of a task's rows as (i, lo, mid, hi): ``make`` gives a block's matrix."""

        def run(batches):
            total = None
            for b in batches:
                x = matrix(b.column(0), np.int64)
                for at in range(0, len(x), BLOCK):
                    g = make(x[at : at + BLOCK])
                    three = np.stack(limbs(g))
                    total = three if total is None else total + three
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1]), pa.int32()), *(pa.array(list(t), pa.list_(pa.int64())) for t in total)], names=["i", "lo", "mid", "hi"])

        return rows.select("x").mapInArrow(run, "i int, lo array<bigint>, mid array<bigint>, hi array<bigint>")

    def block_sums(x: np.ndarray) -> np.ndarray:
        return x.sum(axis=0, keepdims=True) if int(np.abs(x).max()) * len(x) < 1 << 63 else x.astype(object).sum(axis=0, keepdims=True)

    total = sums_of_rows(added(block_sums), dim)[0]
    centre = np.array([round(Fraction(s, n)) for s in total], np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]  # what the rounded mean leaves of the sums
    gram = sums_of_rows(added(lambda x: products(x - centre)), dim)
    # n^2 V, exactly: the vectors were centred by whole numbers, which leaves less than half a unit of the mean.
    exact = [[n * gram[i][j] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]
    top = max(1, max(abs(v) for r in exact for v in r))
    drop = max(0, top.bit_length() - 1000)  # within the range of doubles
    cov = np.array([[_long(v >> drop) for v in r] for r in exact], np.longdouble)
    trace = sum(exact[i][i] for i in range(dim))
    values, basis = components(cov, float(trace >> drop))
    unit = float(Fraction(1 << drop, n * n))
    explained = values / float(trace >> drop) if trace else np.full(dim, np.nan)
    live = values > dim * np.finfo(float).eps * max(float(values[0]), 0.0) if trace else np.zeros(dim, bool)
    k = min(most, dim)
    live, basis = live[:k], basis[:, :k]
    deviations = np.where(live, np.sqrt(np.where(live, values[:k] * unit, 1.0)), np.nan)
    fit = spark.sparkContext.broadcast((n, centre, np.array(rest, object), basis, deviations, live))

    def projected(x: np.ndarray) -> np.ndarray:
        n, centre, rest, basis, deviations, _ = fit.value
        off = np.array([float(Fraction(int(s), n)) for s in rest])
        return ((x - centre) - off) @ basis / deviations

    def spread(batches):
        """A task's rows: number, sums and products of what was whitened, one row a component and one for the sums."""
        live = fit.value[5]
        total, count = np.zeros((int(live.sum()) + 1, int(live.sum()))), 0
        for b in batches:
            x = matrix(b.column(0), np.int64)
            for at in range(0, len(x), BLOCK):
                w = projected(x[at : at + BLOCK])[:, live]
                total[:-1] += w.T @ w
                total[-1] += w.sum(axis=0)
                count += len(w)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    error, alive = None, int(live.sum())
    if alive:
        parts = rows.select("x").mapInArrow(spread, "i int, v array<double>")
        if alive <= 256:
            met = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(alive)]).alias("v"))
        else:
            met = parts.groupBy("i").applyInArrow(lambda t: pa.table({"i": t.column("i").slice(0, 1), "v": pa.array([matrix(t.column("v").combine_chunks(), float).sum(axis=0)], pa.list_(pa.float64()))}), parts.schema)
        sums = np.array([r.v for r in sorted(met.collect(), key=lambda r: r.i)])
        mean = sums[-1] / n  # nearly 0: what was whitened is centred already
        error = float(np.abs(sums[:-1] / n - np.outer(mean, mean) - np.eye(alive)).max())
    shares = [None if not trace else float(v) for v in explained[:k]]

    def run(batches):
        n, centre, rest, _, _, live = fit.value
        for b in batches:
            x = matrix(b.column(1), np.int64)
            for at in range(0, len(x), BLOCK):
                some = x[at : at + BLOCK]
                w = np.where(live, projected(some), np.nan)
                z = some - centre
                size = (int(np.abs(z).max()) + 1) * n
                if size * size * len(centre) < 1 << 63:
                    long = ((z * n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    long = [v if v < 1 << 63 else None for v in ((z.astype(object) * n - rest) ** 2).sum(axis=1).tolist()]
                m = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, BLOCK),
                        pa.array([n] * m, pa.int64()),
                        pa.array(long, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64(), from_pandas=True)),
                        pa.array([shares] * m, pa.list_(pa.float64())),
                        pa.array([error] * m, pa.float64()),
                    ],
                    names=out.names,
                )

    return rows.mapInArrow(run, out)


def _long(v: int) -> np.longdouble:
    """An integer of any size to the widest float, rounded once at most."""
    hi = v >> 52
    return np.longdouble(float(hi)) * np.longdouble(2.0**52) + np.longdouble(float(v - (hi << 52))) if abs(v) < 1 << 104 else _long(v >> 52) * np.longdouble(2.0**52)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), keep=["vec_id"])
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return out.select("row.vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
