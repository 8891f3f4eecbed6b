"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Vectors are grouped by length and by the power of two of their norm, scaled by the group's largest norm and given one more component,
``sqrt(1 - |x|^2)``, which turns the largest inner product within a group into the least Euclidean distance. Each of ``tables`` hash
tables has ``functions`` p-stable functions ``floor((a x + b) / width)``. A query looks into its own bucket and then into perturbed
buckets, in the order of their estimated chance of success: the order statistics of the distances to the bucket borders give a
template of perturbation sets once, and each query maps it to its own borders. The candidates of all tables are merged and
reranked by the exact product in double precision.

How many buckets a query visits is fitted: for ``fit_queries`` queries (those of least hash) the true neighbours are found by brute
force over all rows, in one pass, and the least number of probes is taken that reaches ``target`` recall on them. Where ``max_probes``
don't reach it, and for queries that find fewer rows than they should, the search goes over all rows in blocks.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; vectors of another
length have no product with a query and aren't its candidates; of repeated rows with one id the least vector counts, as query and
as candidate; a row never finds its own id; equal scores are ordered by id; fewer candidates than k give fewer rows; an empty table
gives an empty result.

Scale: the buckets route. A table's buckets are dealt to regions by their first few functions, so that a probe mostly stays in the
query's region or a neighbour of it; a row goes to one region of each table, a query to the regions of its probes and to no
other. Regions of more than ``block_rows`` rows (a bucket full of copies, say) are split by the hash of the id, and what visits them
visits each part. A part holds its rows in memory and streams queries by; it returns k rows a query at most.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written


def template(functions: int, probes: int) -> np.ndarray:
    """probes x 2*functions: which ranks of border distances are crossed, the own bucket first, by expected squared distance.

    Ranks j and 2*functions-1-j are the two borders of one function and never go together.
    """
    m = functions
    z = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    z += [1 - (2 * m - j) / (m + 1) + (2 * m - j) * (2 * m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 2 * m)]
    sets: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(sets) < probes:
        cost, s = heapq.heappop(heap)
        if all(2 * m - 1 - j not in s for j in s):
            sets.append(s)
        if s[-1] + 1 < 2 * m:
            heapq.heappush(heap, (cost - z[s[-1]] + z[s[-1] + 1], (*s[:-1], s[-1] + 1)))
            heapq.heappush(heap, (cost + z[s[-1] + 1], (*s, s[-1] + 1)))
    out = np.zeros((len(sets), 2 * m), np.uint64)
    for i, s in enumerate(sets):
        out[i, list(s)] = 1
    return out


class Hashes:
    """The tables' functions; a bucket is a sum of its numbers times odd multipliers, so that a step adds or takes one multiplier."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, probes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.tables, self.functions, self.width = tables, functions, width
        self.a = rng.normal(size=(dim + 1, tables * functions)).astype(np.float32)
        self.b = rng.uniform(0, width, tables * functions).astype(np.float32)
        self.r = rng.integers(1, 1 << 63, (tables, functions), dtype=np.uint64) | np.uint64(1)
        self.template = template(functions, probes)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of buckets and places inside, rows x tables x functions."""
        y = ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.functions)
        h = np.floor(y)
        return h.astype(np.int64), y - h

    def codes(self, h: np.ndarray, lead: int | None = None) -> np.ndarray:
        """The bucket of each table, or what its first ``lead`` functions make of it."""
        return (h.astype(np.int64).view(np.uint64) * self.r)[:, :, :lead].sum(axis=2, dtype=np.uint64)

    def probes(self, x: np.ndarray, lead: int | None = None) -> np.ndarray:
        """Codes of the buckets to visit, rows x tables x probes; with ``lead`` only what the first functions make of them."""
        h, inside = self.places(x)
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=2), axis=2)
        r = np.where(np.arange(self.functions) < (self.functions if lead is None else lead), self.r, np.uint64(0))
        step = np.broadcast_to(np.concatenate([-r.view(np.int64), r.view(np.int64)], axis=1).view(np.uint64), order.shape)
        ranked = np.take_along_axis(step, order, axis=2)
        return self.codes(h, lead)[:, :, None] + np.einsum("pj,qtj->qtp", self.template, ranked)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    y = (x / top).astype(np.float32)
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1, keepdims=True)))], axis=1)


def flat(queries: np.ndarray) -> np.ndarray:
    """Queries of norm one in the space of lifted rows."""
    y = queries / np.abs(queries).max(axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return np.concatenate([y, np.zeros((len(y), 1))], axis=1).astype(np.float32)


class Part:
    """The rows of one region, or of a part of it, with one table's codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None):
        order = np.argsort(codes, kind="stable") if codes is not None else np.arange(len(ids))
        self.ids, self.x = ids[order], x[order]
        self.codes = codes[order] if codes is not None else None
        self.top = float(np.abs(x).max()) * math.sqrt(x.shape[1])

    def candidates(self, probes: np.ndarray | None) -> np.ndarray:
        """Marks of the rows in the buckets of each query: queries x rows."""
        if probes is None or self.codes is None:
            return np.ones((1 if probes is None else len(probes), len(self.ids)), bool)
        lo, hi = np.searchsorted(self.codes, probes, "left"), np.searchsorted(self.codes, probes, "right")
        edge = np.zeros((len(probes), len(self.ids) + 1), np.int32)
        who = np.broadcast_to(np.arange(len(probes))[:, None], lo.shape)
        np.add.at(edge, (who, lo), 1)
        np.add.at(edge, (who, hi), -1)
        return np.cumsum(edge, axis=1)[:, :-1] > 0

    def search(self, ids: np.ndarray, queries: np.ndarray, probes: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, row id, score) of the k best candidates of each query."""
        marks = self.candidates(probes)
        dense = marks.mean() > 0.1
        block = queries @ self.x.T if dense else None
        out = []
        for i, (q, vector) in enumerate(zip(ids, queries)):
            rows = np.flatnonzero(marks[i if len(marks) > 1 else 0] & (self.ids != q))
            if len(rows) > k:  # all that may be among the k best, whatever the rounding of these sums; the order is decided below
                rough = block[i, rows] if dense else self.x[rows] @ vector
                slack = 8 * len(vector) * np.finfo(float).eps * self.top * float(np.abs(vector).sum())
                rows = rows[rough >= np.partition(rough, len(rows) - k)[len(rows) - k] - slack]
            score = (self.x[rows] * vector).sum(axis=1)
            best = np.lexsort((self.ids[rows], -score))[:k]
            out.append((np.full(len(best), q), self.ids[rows][best], score[best]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class Groups:
    """Groups of vectors by (length, power of two of the norm), with their hash functions and numbers of regions."""

    def __init__(self, stats: list[tuple[int, int, int, float]], tables: int, functions: int, width: float, probes: int, block_rows: int):
        self.of = {(dim, band): (g, n, top) for g, (dim, band, n, top) in enumerate(sorted(stats))}
        self.bands = {dim: [b for d, b in self.of if d == dim] for dim in {d for d, _ in self.of}}
        self.tables, self.block_rows = tables, block_rows
        self.shape = (tables, functions, width, probes)
        self.made: dict[int, Hashes] = {}

    def hashes(self, dim: int) -> Hashes:
        if dim not in self.made:
            self.made[dim] = Hashes(dim, *self.shape)
        return self.made[dim]

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def lead(self, n: int) -> int:
        """How many functions name a region: each cuts the rows in two or three."""
        return min(self.shape[1], math.ceil(math.log2(max(1, n / self.block_rows)) / 1.2))

    def cell(self, g: int, t: int, region: np.ndarray) -> np.ndarray:
        """The number of a region of a table of a group."""
        mix = (region ^ np.uint64((g * self.tables + t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
        return (mix ^ (mix >> np.uint64(29))).view(np.int64)


def _by_dim(batch: pa.RecordBatch, column: int):
    """(dim, positions, vectors) of the vectors of each length."""
    sizes = np.asarray(batch.column(column).value_lengths())
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, matrix(batch.column(column).take(pa.array(at)))


def band_of(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1)
    return np.frexp(big * np.linalg.norm(x / big[:, None], axis=1))[1]


def _row_cells(groups: Groups):
    """batches (vec_id, x) -> (cell, code, vec_id, x), a row for each table."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 5000):
                batch = whole.slice(lo, 5000)
                for dim, at, x in _by_dim(batch, 1):
                    hashes, bands = groups.hashes(dim), band_of(x)
                    for band in np.unique(bands).tolist():
                        g, n, top = groups.of[dim, band]
                        own = bands == band
                        h, _ = hashes.places(lifted(x[own], top))
                        codes, region = hashes.codes(h), hashes.codes(h, groups.lead(n))
                        ids, vectors = (batch.column(c).take(pa.array(at[own])) for c in (0, 1))
                        for t in range(groups.tables):
                            yield pa.RecordBatch.from_arrays([pa.array(groups.cell(g, t, region[:, t])), pa.array(codes[:, t].view(np.int64)), ids, vectors], names=["cell", "code", "vec_id", "x"])

    return run


def _query_cells(groups: Groups):
    """batches (vec_id, x) -> (cell, g, t, vec_id, x): the regions that a query's probes fall to."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 100):
                batch = whole.slice(lo, 100)
                for dim, at, x in _by_dim(batch, 1):
                    hashes, y = groups.hashes(dim), flat(x)
                    for band in groups.bands[dim] if dim in groups.bands else ():
                        g, n, _ = groups.of[dim, band]
                        region = hashes.probes(y, groups.lead(n))
                        for t in range(groups.tables):
                            some = [np.unique(r) for r in region[:, t]]
                            who = pa.array(at[np.repeat(np.arange(len(at)), [len(s) for s in some])])
                            cells = groups.cell(g, t, np.concatenate(some))
                            const = lambda v, m=len(cells): pa.array(np.full(m, v, np.int32))
                            yield pa.RecordBatch.from_arrays([pa.array(cells), const(g), const(t), batch.column(0).take(who), batch.column(1).take(who)], names=["cell", "g", "t", "vec_id", "x"])

    return run


def _searcher(groups: Groups | None, k: int):
    """batches (cell, part, kind, t, code, vec_id, x), each part's rows before its queries -> (query_id, vec_id, score).

    Without ``groups`` all rows of a part are candidates.
    """

    def run(batches):
        key, held, index = None, [], None
        for batch in batches:
            cell, part, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(cell)]):
                if hi == lo:
                    continue
                if (cell[lo], part[lo]) != key:
                    key, held, index = (cell[lo], part[lo]), [], None
                piece = batch.slice(lo, hi - lo)
                ids, x = piece.column(5).to_numpy(), matrix(piece.column(6))
                if kind[lo] == 0:
                    held.append((ids, x, piece.column(4).to_numpy().view(np.uint64)))
                    continue
                if index is None:
                    if not held:
                        continue
                    rows = [np.concatenate(c) for c in zip(*held)]
                    index, held = Part(rows[0], rows[1], rows[2] if groups else None), []
                t = int(piece.column(3)[0].as_py())
                for at in range(0, len(ids), 64):
                    probes = groups.hashes(x.shape[1]).probes(flat(x[at : at + 64]))[:, t] if groups else None
                    found = index.search(ids[at : at + 64], x[at : at + 64], probes, k)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


DEALT = "cell long, part int, kind int, t int, code long, vec_id long, x array<double>"
FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, x array<double>) of the vectors that take part, one an id."""
    x = F.col(vector).cast("array<double>")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    df = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & good)
    return df.groupBy("vec_id").agg(F.min("x").alias("x"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def in_blocks(rows: DataFrame, asked: DataFrame, k: int, n: int, block_rows: int) -> DataFrame:
    """The exact search: every query meets all rows of its length, block by block."""
    blocks = max(1, -(-n // block_rows))
    dim = F.size("x").cast("bigint").alias("cell")
    none = [F.lit(0).alias("t"), F.lit(0).cast("bigint").alias("code")]
    dealt = rows.select(dim, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("part"), F.lit(0).alias("kind"), *none, "vec_id", "x")
    dealt = dealt.unionByName(asked.select(dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.lit(1).alias("kind"), *none, "vec_id", "x"))
    return dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(_searcher(None, k), FOUND)


def by_buckets(rows: DataFrame, asked: DataFrame, k: int, groups: Groups) -> DataFrame:
    """Rows and queries meet in the regions of their buckets."""
    placed = rows.select("vec_id", "x").mapInArrow(_row_cells(groups), "cell long, code long, vec_id long, x array<double>")
    wanted = asked.select("vec_id", "x").mapInArrow(_query_cells(groups), "cell long, g int, t int, vec_id long, x array<double>")
    split = placed.groupBy("cell").agg(F.ceil(F.count("*") / groups.block_rows).cast("int").alias("parts")).where("parts > 1")
    split = written(split, "ann-split")
    parts = F.coalesce("parts", F.lit(1))
    dealt = placed.join(split, "cell", "left").select("cell", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(0).alias("t"), "code", "vec_id", "x")
    visits = wanted.join(split, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(1).alias("kind"), "t", F.lit(0).cast("bigint").alias("code"), "vec_id", "x")
    return dealt.unionByName(visits).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind").mapInArrow(_searcher(groups, k), FOUND)


def fitted_probes(sample: list[tuple[np.ndarray, list[np.ndarray]]], groups: Groups, target: float) -> int | None:
    """The least number of probes that finds ``target`` of the sampled queries' true neighbours, or None.

    The sample is (query, its neighbours' vectors). Queries have one vote each.
    """
    most = groups.shape[3]
    at = []  # per neighbour: the first probe that meets it in any table, and its weight
    for query, near in sample:
        dim = len(query)
        hashes = groups.hashes(dim)
        probes = hashes.probes(flat(query[None]))[0]
        for v in near:
            top = groups.of[dim, int(band_of(v[None])[0])][2]
            codes = hashes.codes(hashes.places(lifted(v[None], top))[0])[0]
            met = [np.flatnonzero(probes[t] == codes[t])[:1] for t in range(groups.tables)]
            at.append((min([int(m[0]) for m in met if len(m)], default=most), 1 / len(near)))
    if not at:
        return 1
    place, weight = np.array([a for a, _ in at]), np.array([w for _, w in at])
    order = np.argsort(place, kind="stable")
    recall = np.cumsum(weight[order]) / weight.sum()
    need = int(np.searchsorted(recall, target))
    return None if need >= len(order) or place[order][need] >= most else int(place[order][need]) + 1


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, tables: int = 4, functions: int = 8, width: float = 2.0, target: float = 0.95, fit_queries: int = 64, max_probes: int = 1000, block_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k rows of ``vectors`` of largest inner product that were found."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector), "ann-rows")
    asked = written(usable(queries, id_col, vector), "ann-queries")
    big = F.aggregate("x", F.lit(0.0), lambda s, c: F.greatest(s, F.abs(c)))
    norm = F.col("big") * F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + (c / F.col("big")) * (c / F.col("big"))))
    normed = rows.withColumn("big", big).select("x", norm.alias("norm"))
    # A row for each length and power of two: bounded by the range of doubles, whatever the number of vectors.
    stats = normed.mapInArrow(_bands, "dim int, band int, n bigint, top double").groupBy("dim", "band").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    if not stats:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n = sum(r.n for r in stats)
    few = written(asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_queries), "ann-sample")
    near = _best(in_blocks(rows, few, k, n, block_rows), k).join(rows.withColumnRenamed("x", "near"), "vec_id")
    near = near.join(few.select(F.col("vec_id").alias("query_id"), "x"), "query_id").groupBy("query_id").agg(F.first("x").alias("x"), F.collect_list("near").alias("near"))
    sample = [(np.array(r.x), [np.array(v) for v in r.near]) for r in sorted(near.collect(), key=lambda r: r.query_id)]  # fit_queries x k vectors
    make = lambda probes: Groups([(r.dim, r.band, r.n, r.top) for r in stats], tables, functions, width, probes, block_rows)
    probes = fitted_probes(sample, make(max_probes), target)
    if probes is None:
        return _best(in_blocks(rows, asked, k, n, block_rows), k)
    found = written(_best(by_buckets(rows, asked, k, make(probes)), k), "ann-found")
    # Queries that found fewer rows than there are to find meet all rows.
    sizes = spark.createDataFrame([(d, sum(r.n for r in stats if r.dim == d)) for d in {r.dim for r in stats}], "dim int, n bigint")
    got = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("got"))
    own = rows.select("vec_id", F.size("x").alias("own"))
    due = asked.withColumn("dim", F.size("x")).join(sizes, "dim", "left").join(own, "vec_id", "left").join(got, "vec_id", "left")
    there = F.coalesce("n", F.lit(0)) - F.when(F.col("own") == F.col("dim"), 1).otherwise(0)
    short = written(due.where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), there)).select("vec_id", "x"), "ann-short")
    if short.isEmpty():
        return found
    rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*found.columns)
    return rest.unionByName(_best(in_blocks(rows, short, k, n, block_rows), k))


def _bands(batches):
    """batches (x, norm) -> (dim, band, n, top)."""
    for batch in batches:
        for dim, at, x in _by_dim(batch, 0):
            bands = band_of(x)
            norm = batch.column(1).to_numpy()[at]
            for band in np.unique(bands).tolist():
                own = norm[bands == band]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([band], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([float(own.max())])], names=["dim", "band", "n", "top"])


def op7_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
