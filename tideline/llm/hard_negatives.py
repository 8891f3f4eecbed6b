"""Hard-negative mining: an inverted multi-index over vector halves, searched until windows of scores are certified.

The components become the integers ``floor(scale * x)``; a score is an integer inner product. Two codebooks, one for each half of the
components, are fitted on a bounded sample; a row belongs to the cell of its two nearest codes. With the largest distance of any row to its
code (the radius, over all rows) the half score of a query and a row is at most ``q c + |q| r``, so the sum of two half bounds bounds
every score of a cell. A heap visits the cells by falling bound (the multi-sequence order: from a pair of places in the two sorted lists
to the next place in either). A search asks for the first k rows of one or more windows of scores; a window is certified once the next
bound is under its k-th row's score, or under the window. So the codebooks decide how much is visited and nothing else: results are
exact.

Hard negatives: an anchor's positives are the first rows of its label; for each of them, a window from ``low`` to ``high`` percent of
its score is searched among rows of other labels.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; empty vectors neither; rows
of another length have no product with a query; integers are held within what keeps 100 times a score a long; of repeated ids the
row of least label, then vector, counts; equal scores are ordered by id; a negative positive score gives an empty window, fewer rows
than asked for give fewer; an empty table gives an empty result.

Scale: cells are packed into parts of about ``block_rows`` rows, and larger cells (copies of one vector, say) are split by the hash of
the id. A query goes to the part of its highest bound first; what it finds there cuts the windows, and then it goes to the other parts
whose bounds still reach them, and to no other. A part holds its rows in memory and streams queries by; it returns k rows a window at most. The
driver holds the codebooks and a count for each cell, whatever the number of rows.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .whitening import matrix

FOUND = "query_id bigint, tag bigint, vec_id bigint, score bigint"
MET = "part int, kind int, vec_id bigint, label bigint, i int, j int, x array<bigint>, lo array<bigint>, hi array<bigint>, tags array<bigint>"
FAR = 1 << 62


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres by Lloyd's rounds from evenly spaced rows; a centre without rows stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        for c in np.flatnonzero(n):
            centres[c] = x[near == c].mean(axis=0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T), axis=1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[..., : x.shape[-1] // 2], x[..., x.shape[-1] // 2 :]


def dots(x: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Exact integer products: by floats where the sums stay below 2^53."""
    if most * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


class Space:
    """Codebooks and cells of the vectors of one length."""

    def __init__(self, codes: tuple[np.ndarray, np.ndarray]):
        self.codes = codes

    def fill(self, cells: list[tuple[int, int, int, float, float]], block_rows: int, first: int) -> int:
        """Lay out ``(i, j, rows, radius, radius)`` in parts numbered from ``first``; returns the next number."""
        self.radius = [np.zeros(len(c)) for c in self.codes]
        self.cells = np.array([(i, j) for i, j, *_ in sorted(cells)]).reshape(-1, 2)
        self.part, self.split, held = np.empty(len(cells), np.int64), np.ones(len(cells), np.int64), 0
        part = first - 1
        for at, (i, j, n, a, b) in enumerate(sorted(cells)):
            self.radius[0][i], self.radius[1][j] = max(self.radius[0][i], a), max(self.radius[1][j], b)
            pieces = -(-n // block_rows)
            if at == 0 or pieces > 1 or held + n > block_rows:
                part, held = part + 1, 0
            self.part[at], self.split[at] = part, pieces
            part += pieces - 1
            held = block_rows if pieces > 1 else held + n
        self.first, self.end = first, part + 1
        self.starts = np.r_[0, np.flatnonzero(np.diff(self.part)) + 1] if len(cells) else np.empty(0, np.int64)
        self.at = {(int(i), int(j)): (int(p), int(s)) for (i, j), p, s in zip(self.cells, self.part, self.split)}
        return part + 1

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Upper and lower bounds of the half scores of queries with each code, the first two for the first half; slack for rounding is in them."""
        out = []
        for part, codes, radius in zip(halves(q.astype(np.float64)), self.codes, self.radius):
            size = np.linalg.norm(part, axis=-1)[..., None]
            score, spread = part @ codes.T, size * radius
            spread = spread + 0.5 + 1e-9 * size * (np.linalg.norm(codes, axis=1) + radius)
            out += [score + spread, score - spread]
        return out[0], out[1], out[2], out[3]

    def routes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(upper, lower) bounds of the queries' scores in each run of cells that share parts, and the runs' first cells."""
        up1, low1, up2, low2 = self.bounds(q)
        i, j = self.cells[:, 0], self.cells[:, 1]
        return np.maximum.reduceat(up1[:, i] + up2[:, j], self.starts, axis=1), np.minimum.reduceat(low1[:, i] + low2[:, j], self.starts, axis=1), self.starts


class Index:
    def __init__(self, codes: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.spaces = {d: Space(c) for d, c in codes.items()}

    def space(self, dim: int) -> Space:
        """Lengths that the sample didn't hold have one code, the origin."""
        if dim not in self.spaces:
            self.spaces[dim] = Space((np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2))))
        return self.spaces[dim]


def by_length(column: pa.Array):
    """(length, positions, vectors) of the vectors of each length."""
    sizes = np.asarray(column.value_lengths())
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, at, matrix(column.take(pa.array(at)), np.int64)


def _assign(index: Index):
    """batches (vec_id, label, x) -> with dim, i, j and the distances to the codes."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 5000):
                b = whole.slice(lo, 5000)
                for dim, at, x in by_length(b.column(2)):
                    code, far = [], []
                    for part, codes in zip(halves(x.astype(np.float64)), index.space(dim).codes):
                        code.append(nearest(part, codes))
                        far.append(np.linalg.norm(part - codes[code[-1]], axis=1))
                    own = pa.array(at)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(own) for k in range(3)), pa.array(np.full(len(at), dim, np.int32)), *(pa.array(c.astype(np.int32)) for c in code), *map(pa.array, far)], names=["vec_id", "label", "x", "dim", "i", "j", "far1", "far2"])

    return run


class Part:
    """The rows of one part, by cell."""

    def __init__(self, space: Space, ids, labels, i, j, x):
        order = np.lexsort((ids, j, i))
        self.space, self.ids, self.labels, self.x = space, ids[order], labels[order], x[order]
        i, j = i[order], j[order]
        cuts = np.r_[0, np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1, len(i)]
        self.rows = {(int(i[a]), int(j[a])): slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:])}
        self.codes = np.unique(i), np.unique(j)
        self.most = int(np.abs(x).max(initial=0))

    def search(self, own: int, label: int, q: np.ndarray, lo: list[int], hi: list[int], k: int, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the first k rows of each window of scores, by falling score, then id."""
        up1, low1, up2, low2 = self.space.bounds(q)
        first, second = self.codes
        a_order, b_order = first[np.argsort(-up1[first], kind="stable")].tolist(), second[np.argsort(-up2[second], kind="stable")].tolist()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in lo]
        need, top, least = list(lo), max(hi), min(lo)
        heap, seen = [(-(up1[a_order[0]] + up2[b_order[0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, a, b = heapq.heappop(heap)
            if -bound < least:  # no cell that is left reaches a window: certified
                break
            for nxt in ((a + 1, b), (a, b + 1)):
                if nxt not in seen and nxt[0] < len(a_order) and nxt[1] < len(b_order):
                    seen.add(nxt)
                    heapq.heappush(heap, (-(up1[a_order[nxt[0]]] + up2[b_order[nxt[1]]]), *nxt))
            i, j = a_order[a], b_order[b]
            rows = self.rows.get((i, j))
            if rows is None or low1[i] + low2[j] > top:
                continue
            score = dots(self.x[rows], q, self.most)
            fits = np.flatnonzero((score >= least) & (score <= top) & ((self.labels[rows] == label) == same) & (self.ids[rows] != own))
            if not len(fits):
                continue
            ids, score = self.ids[rows][fits], score[fits]
            for w in range(len(lo)):
                inside = (score >= need[w]) & (score <= hi[w])
                if inside.any():
                    more_ids, more = np.r_[best[w][0], ids[inside]], np.r_[best[w][1], score[inside]]
                    order = np.lexsort((more_ids, -more))[:k]
                    best[w] = more_ids[order], more[order]
                    if len(order) == k:
                        need[w] = int(best[w][1][-1])
            least = min(need)
        return best


def _searcher(index: Index, k: int, same: bool):
    """batches of MET, a part's rows before its queries -> FOUND."""

    def run(batches):
        key, held, part = None, [], None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(number)]):
                if hi == lo:
                    continue
                if number[lo] != key:
                    key, held, part = number[lo], [], None
                piece = batch.slice(lo, hi - lo)
                ids, labels, x = piece.column(2).to_numpy(), piece.column(3).to_numpy(), matrix(piece.column(6), np.int64)
                if kind[lo] == 0:
                    held.append((ids, labels, piece.column(4).to_numpy(), piece.column(5).to_numpy(), x))
                    continue
                if part is None:
                    if not held:
                        continue
                    part, held = Part(index.space(x.shape[1]), *(np.concatenate(c) for c in zip(*held))), []
                windows = [piece.column(c).to_pylist() for c in (7, 8, 9)]
                out = []
                for q in range(len(ids)):
                    found = part.search(int(ids[q]), int(labels[q]), x[q], windows[0][q], windows[1][q], k, same)
                    out += [(np.full(len(f), ids[q]), np.full(len(f), tag), f, s) for tag, (f, s) in zip(windows[2][q], found) if len(f)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["query_id", "tag", "vec_id", "score"])

    return run


def _router(index: Index, first: bool):
    """batches (vec_id, label, x, lo, hi, tags) -> MET rows of queries: the part of the highest bound (``first``), or all others that
    a window reaches."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                lo, hi = b.column(3).to_pylist(), b.column(4).to_pylist()
                who, where = [], []
                for dim, own, x in by_length(b.column(2)):
                    space = index.space(dim)
                    upper, lower, starts = space.routes(x)
                    best = np.argmax(upper, axis=1)
                    for q, up, low, top in zip(own.tolist(), upper, lower, best.tolist()):
                        reach = (up >= min(lo[q])) & (low <= max(hi[q]))
                        for run_ in [top] if first else np.flatnonzero(reach).tolist():
                            p, s = int(space.part[starts[run_]]), int(space.split[starts[run_]])
                            parts = range(p, p + 1) if first else range(p + (run_ == top), p + s)
                            who += [q] * len(parts)
                            where += parts
                take = pa.array(who, pa.int32())
                none = pa.nulls(len(who), pa.int32())
                columns = [b.column(k).take(take) for k in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(np.ones(len(who), np.int32)), *columns[:2], none, none, *columns[2:]], names=["part", "kind", "vec_id", "label", "i", "j", "x", "lo", "hi", "tags"])

    return run


def usable(vectors: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(vec_id, label, x array<bigint>) of the rows that take part, one an id."""
    v = F.col("v")
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    df = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).where(good)
    most = F.floor(F.sqrt(F.lit(float(1 << 56)) / F.size(v))).cast("double")
    df = df.select("vec_id", "label", F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, most), -most)).cast("bigint")).alias("x"))
    return df.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")


class MultiIndex:
    """``rows`` in their cells, ready to be searched."""

    def __init__(self, rows: DataFrame, *, sample_rows: int = 20_000, codes: int | None = None, block_rows: int = 20_000):
        self.rows, self.block_rows = rows, block_rows
        n = rows.count()
        codes = codes or int(min(256, max(2, round((n / 200) ** 0.5))))

        def fit(batches):
            x = [m for b in batches for m in [b.column(0)]]
            found: dict[int, list] = {}
            for column in x:
                for dim, _, v in by_length(column):
                    found.setdefault(dim, []).append(v)
            made = {}
            for dim, v in found.items():
                v = np.concatenate(v)
                v = v[np.lexsort(v.T)].astype(np.float64)  # the same start whatever the order of the rows
                made[dim] = tuple(kmeans(h, codes) for h in halves(v))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["codes"])

        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("x")
        made = sample.repartition(1).mapInArrow(fit, "codes binary").first()
        index = Index(pickle.loads(made.codes) if made else {})
        placed = "vec_id bigint, label bigint, x array<bigint>, dim int, i int, j int, far1 double, far2 double"
        self.placed = written(rows.select("vec_id", "label", "x").mapInArrow(_assign(index), placed), "multi-index")
        cells = self.placed.groupBy("dim", "i", "j").agg(F.count("*").alias("n"), F.max("far1"), F.max("far2")).collect()  # codes squared at most
        nxt = 0
        for dim in sorted({r.dim for r in cells}):
            nxt = index.space(dim).fill([tuple(r)[1:] for r in cells if r.dim == dim], block_rows, nxt)
        self.index = index

    def dealt(self) -> DataFrame:
        """The rows with their parts, as MET."""
        index = self.index

        def run(batches):
            for b in batches:
                ids, dim, i, j = (b.column(k).to_numpy() for k in (0, 3, 4, 5))
                part = np.empty(len(ids), np.int32)
                mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                for at, (d, a, c) in enumerate(zip(dim.tolist(), i.tolist(), j.tolist())):
                    p, s = index.spaces[d].at[a, c]
                    part[at] = p + int(mixed[at]) % s
                none = pa.nulls(len(ids), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(ids), np.int32)), b.column(0), b.column(1), b.column(4), b.column(5), b.column(2), none, none, none], names=["part", "kind", "vec_id", "label", "i", "j", "x", "lo", "hi", "tags"])

        return self.placed.mapInArrow(run, MET)

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(query_id, tag, vec_id, score, rank): the first k rows of each window of ``queries(vec_id, label, x, lo, hi, tags)``, of the
        query's label (``same``) or of other labels, the query's own id left out."""
        queries = written(queries.select("vec_id", "label", "x", "lo", "hi", "tags"), "mined-queries")
        one = written(self._visit(queries.mapInArrow(_router(self.index, True), MET), k, same), "mined-first")
        full = one.groupBy("query_id", "tag").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        known = full.groupBy(F.col("query_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("tag", "least"))).alias("known"))  # a window a tag
        rest = queries.join(known, "vec_id", "left")
        cut = F.transform("lo", lambda v, at: F.greatest(v, F.coalesce(F.element_at(F.coalesce("known", F.create_map().cast("map<bigint,bigint>")), F.get("tags", at)), v)))
        rest = rest.select("vec_id", "label", "x", cut.alias("lo"), "hi", "tags")
        two = self._visit(rest.mapInArrow(_router(self.index, False), MET), k, same)
        order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
        return one.unionByName(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _visit(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        met = self.dealt().unionByName(visits).repartition("part").sortWithinPartitions("part", "kind")
        return met.mapInArrow(_searcher(self.index, k, same), FOUND)


def mine(vectors: DataFrame, anchors: F.Column | str, *, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, **options) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` is a predicate on ``vec_id``.

    Negatives have ``low * positive_score <= 100 * negative_score <= high * positive_score``; low and high are at most 100.
    """
    rows = written(usable(vectors, id_col, vector, label, scale), "mined-rows")
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    index = MultiIndex(rows, **options)
    asked = rows.where(anchors)
    every = asked.select("*", F.array(F.lit(-FAR)).alias("lo"), F.array(F.lit(FAR)).alias("hi"), F.array(F.lit(0).cast("bigint")).alias("tags"))
    pairs = written(index.search(every, positives, True).select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "mined-pairs")
    lo, hi = F.expr(f"(positive_score * {low} + 99) div 100"), F.expr(f"(positive_score * {high}) div 100")
    windows = pairs.where("positive_score >= 0").select("anchor_id", F.struct("positive_id", lo.alias("lo"), hi.alias("hi")).alias("w")).where("w.lo <= w.hi")
    windows = windows.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list("w")).alias("ws"))  # as many as positives are asked for
    wanted = asked.join(windows, "vec_id").select("vec_id", "label", "x", F.col("ws.lo").alias("lo"), F.col("ws.hi").alias("hi"), F.col("ws.positive_id").alias("tags"))
    found = index.search(wanted, negatives, False).select(F.col("query_id").alias("anchor_id"), F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("vec_id") % 100 == 0)


_SCORE_SQL = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT"
ORACLE_SQL = f"""
WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))),
scored AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, {_SCORE_SQL} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM pos JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10
"""
