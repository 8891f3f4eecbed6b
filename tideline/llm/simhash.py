"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints of 64 bits are cut into 16 segments of 4 bits; the popcounts of the segments are a point in a small integer grid.
A differing bit moves one coordinate by one, so the Manhattan distance of two points is a lower bound of the Hamming
distance. Two points at Manhattan distance d or less have a grid point in common that is at most ceil(d/2) from one and
floor(d/2) from the other, so each fingerprint is dealt to the cells of its ball of radius ceil(d/2), pairs are looked for
within a cell, and each is verified on the exact Hamming distance.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; texts of fewer words than a shingle are
one shingle; repeated rows and equal texts share a fingerprint; a null id never names a component unless all its ids are
null; an empty table gives an empty result; extra columns pass through whatever their names.

Scale: equal fingerprints are merged before any search, so copies never meet as pairs; a cell emits a forest of at most one edge a
member, never all pairs; links, components and fingerprints stay in Spark.

``similar_groups`` is the form for a similarity of word shingles, complete for texts whose shingle sets have that Jaccard similarity.
Fingerprints of the single words (an edit moves fewer of their bits than of those of shingles), one a table, go through the grid: each text
meets the hub of its fingerprint and hubs meet along a forest of links in each cell, so that a group of n copies costs a multiple of n
checks; pairs are checked on the whole sets. The exact way for what differs in more bits is a prefix filter, which
finds each pair that is left. In one order of all shingles, two sets of similarity s share a shingle among
the first ``n - ceil(s n) + 1`` of each. Pairs that meet there are kept unless they are joined already or their sizes or the places of
the shared shingle rule them out, and every pair is checked on the whole sets. Any order is right; the one used puts shingles that are
frequent in a share of the texts last, so that common lines and passages don't bring unrelated texts together. The first round of
meetings pairs each text with the least changed one of its key only, which joins what is left of large groups; the second one takes
all pairs of what is still apart. Sketches that bound the difference of two sets rule pairs out before whole sets are joined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let_go, map_texts, table, written
from .components import components

SEGMENT_BITS = 4
#: Bits of the packed cell for each coordinate; popcounts are 0..SEGMENT_BITS.
PLACE = 3
#: The share of the texts whose shingles are counted, the count from which a shingle is frequent, and the most that are told to the tasks.
SAMPLE_SHARE, FREQUENT_FROM, FREQUENT_MOST = 0.2, 4, 100_000
#: Bits of the parity sketches: of all texts, and of those of ``LONG_FROM`` shingles or more.
SKETCH_BITS, LONG_BITS, LONG_FROM = 1024, 16384, 400


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    k = min(shingle, len(words))
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens)
    starts = ends - lens
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, text: str = "text", shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Per document: ``row`` (the kept columns) and ``fp`` (bigint)."""
    keep = docs.columns if keep is None else keep
    fields = T.StructType([T.StructField("fp", T.LongType())])
    return map_texts(docs, [docs[text].cast("string")], keep, fields, lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]])


def cells(fps: DataFrame, radius: int) -> DataFrame:
    """``fps(t, fp)`` -> ``(cell, fp)`` for the packed grid points at Manhattan distance ``radius`` (0 or 1) or less, those of each ``t`` apart.

    The coordinates are columns of their own: written out in each of the 33 points they would fill the driver's plans.
    """
    segments = 64 // SEGMENT_BITS
    places = [F.bit_count(F.shiftrightunsigned("fp", SEGMENT_BITS * i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))).cast("bigint").alias(f"c{i}") for i in range(segments)]
    counts = [F.col(f"c{i}") for i in range(segments)]
    own = F.shiftleft(F.col("t").cast("bigint"), PLACE * segments)
    for i, c in enumerate(counts):
        own = own + F.shiftleft(c, PLACE * i)
    placed = fps.select("fp", "t", *places).select("fp", own.alias("own"), *counts)
    if radius == 0:
        return placed.select(F.col("own").alias("cell"), "fp")
    own, step = F.col("own"), [F.lit(1 << (PLACE * i)) for i in range(segments)]
    near = [F.when(c < SEGMENT_BITS, own + s) for c, s in zip(counts, step)] + [F.when(c > 0, own - s) for c, s in zip(counts, step)]
    return placed.select(F.explode(F.array(own, *near)).alias("cell"), "fp").where("cell IS NOT NULL")


def forest(fps: np.ndarray, distance: int, direct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that join what is linked among distinct fingerprints; one edge a node at most. ``direct`` ones are links themselves."""
    left, nodes, roots = np.sort(fps), [], []
    while len(left):
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near, to = np.zeros(len(left), bool), np.full(len(left), root)
            for at in range(0, len(frontier), 256):
                block = frontier[at : at + 256]
                rest = np.flatnonzero(~near)
                for lo in range(0, len(rest), 4096):
                    part = rest[lo : lo + 4096]
                    linked = np.bitwise_count((left[part][:, None] ^ block[None, :]).view(np.uint64)) <= distance
                    near[part] = linked.any(axis=1)
                    if direct:
                        to[part] = block[linked.argmax(axis=1)]
            frontier, left, to = left[near], left[~near], to[near]
            nodes.append(frontier)
            roots.append(to)
    empty = np.empty(0, fps.dtype)
    return (np.concatenate(nodes), np.concatenate(roots)) if nodes else (empty, empty)


def _linker(distance: int, direct: bool):
    """batches (cell, fp), by cell -> edges, with the table of their cell."""

    def run(batches):
        kept_cell, kept_fp = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(cell, fp):
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(cell)])
            two = starts[sizes == 2]
            a, b = fp[two], fp[two + 1]
            ok = np.bitwise_count((a ^ b).view(np.uint64)) <= distance  # of signed numbers it would count the bits of the absolute value
            out = [(cell[two[ok]], a[ok], b[ok])]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                nodes, roots = forest(fp[s : s + n], distance, direct)
                out.append((np.full(len(nodes), cell[s]), nodes, roots))
            of, a, b = (np.concatenate(x) for x in zip(*out))
            t = (of >> (PLACE * 64 // SEGMENT_BITS)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(t), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["t", "a", "b"])

        for batch in batches:
            cell = np.concatenate([kept_cell, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([kept_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            last = np.searchsorted(cell, cell[-1]) if len(cell) else 0  # the last cell may go on in the next batch
            yield edges(cell[:last], fp[:last])
            kept_cell, kept_fp = cell[last:], fp[last:]
        yield edges(kept_cell, kept_fp)

    return run


def links(fps: DataFrame, distance: int = 2, direct: bool = False) -> DataFrame:
    """``fps(fp)``, distinct -> edges ``(a, b)`` that span all links at Hamming distance ``distance`` (2 at most) or less.

    An edge may join the ends of a chain of links; ``direct`` edges are links themselves. With a number ``t`` of a table from 0 beside ``fp`` the
    links within each table are found in one pass; edges then have ``t`` too.
    """
    if distance not in (0, 1, 2):
        raise ValueError("the grid takes distances of 0, 1 and 2")
    tables = "t" in fps.columns
    parts = max(fps.sparkSession.sparkContext.defaultParallelism, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cells((fps if tables else fps.withColumn("t", F.lit(0))).repartition(parts), (distance + 1) // 2)
    edges = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_linker(distance, direct), "t int, a bigint, b bigint")
    return edges if tables else edges.select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Per document: ``row`` (the kept columns), ``fp`` and ``component_id`` (the smallest id that its fingerprint reaches)."""
    keep = docs.columns if keep is None else keep
    held = written(fingerprints(docs.select(docs[id_col].alias("_id"), F.struct(*[docs[c] for c in keep]).alias("_row"), docs[text].alias("_text")), text="_text", shingle=shingle, keep=["_id", "_row"]), "simhash-fp")
    classes = written(held.groupBy("fp").agg(F.min("row._id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), distance).distinct(), "simhash-links")
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = linked.select("fp", "root").join(named, "root").select("fp", "component_id")
    return held.join(ids, "fp").select("row._row", "fp", "component_id").withColumnRenamed("_row", "row")


def shingles(text: str | None, size: int, cache: dict | None = None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle. ``cache`` keeps hashes of words."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(1, np.int64)
    cache = {} if cache is None else cache
    if len(cache) > 400_000:
        cache.clear()
    for w in set(words):
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w, 7)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = (total ^ h[i : i + len(total)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total.view(np.int64))


def parities(found: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """So many bits, each the parity of the hashes that fall to it: two sets differ in as many shingles at least as these in bits."""
    counts = np.bincount((found.view(np.uint64) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


def prefix_length(n: int, similarity: float) -> int:
    """How many of the first of ``n`` shingles hold one that any set of that similarity shares."""
    return n - math.ceil(similarity * n - 1e-6) + 1


def _prefixes(shingle: int, similarity: float, often: np.ndarray, level: np.ndarray):
    """batches (uid, root, raw) -> a row for each shingle of the prefix; ``often`` (sorted) come last, by ``level``."""

    def run(batches):
        cache: dict = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                batch = whole.slice(lo, 200)
                keys = []
                sizes = []
                for text in batch.column(2).to_pylist():
                    found = shingles(text, shingle, cache)
                    sizes.append(len(found))
                    n = prefix_length(len(found), similarity)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
                        late = np.where(often[at] == found, level[at], 0)
                        found = found[np.lexsort((found, late))] if late.any() else found
                    keys.append(found[:n])
                counts = [len(k) for k in keys]
                uid, root = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False), counts) for i in (0, 1))
                size, place = np.repeat(np.array(sizes, np.int32), counts), np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(uid), pa.array(root), pa.array(size), pa.array(place)], names=["key", "uid", "root", "size", "place"])

    return run


def _meetings(similarity: float, all_pairs: bool):
    """batches (key, uid, root, size, place), by key -> pairs of different roots that can still have the similarity.

    All such pairs, or of each member only that with the least changed one of another root.
    """
    share = similarity / (1 + similarity)

    def possible(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        (root_a, size_a, place_a), (root_b, size_b, place_b) = a, b
        most = np.minimum(size_a - place_a, size_b - place_b)
        small = np.minimum(size_a, size_b)
        return (root_a != root_b) & (small >= similarity * np.maximum(size_a, size_b) - 1e-6) & (np.minimum(most, small) >= share * (size_a + size_b) - 1e-6)

    def of_key(uid: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
        out = []
        if not all_pairs:
            root, _, place = rest
            first = np.lexsort((uid, place))
            hub = first[0]
            second = first[np.argmax(root[first] != root[hub])]  # the first of another root
            to = np.where(root == root[hub], second, hub)
            ok = possible(rest, [x[to] for x in rest])
            return np.stack([uid[ok], uid[to[ok]]], axis=1)
        for at in range(0, len(uid), 256):
            ok = possible([x[at : at + 256, None] for x in rest], [x[None, at:] for x in rest])
            i, j = np.nonzero(np.triu(ok, 1))
            out.append(np.stack([uid[at + i], uid[at + j]], axis=1))
        return np.concatenate(out)

    def run(batches):
        kept = [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)] * 2

        def found(key, uid, *rest):
            out = [np.empty((0, 2), np.int64)]
            if len(key):
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                sizes = np.diff(np.r_[starts, len(key)])
                mixed = np.minimum.reduceat(rest[0], starts) != np.maximum.reduceat(rest[0], starts)
                two = starts[mixed & (sizes == 2)]
                two = two[possible([x[two] for x in rest], [x[two + 1] for x in rest])]
                out.append(np.stack([uid[two], uid[two + 1]], axis=1))
                more = mixed & (sizes > 2)
                out += [of_key(uid[s : s + n], [x[s : s + n] for x in rest]) for s, n in zip(starts[more].tolist(), sizes[more].tolist())]
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if len(cols[0]) and len(kept[0]) and cols[0][-1] == kept[0][0]:  # the key goes on
                parts.append(cols)
                continue
            if len(kept[0]):
                cols = [np.concatenate(x) for x in zip(*parts, cols)]
            last = np.searchsorted(cols[0], cols[0][-1]) if len(cols[0]) else 0  # the last key may go on in the next batch
            yield found(*[c[:last] for c in cols])
            kept = [c[last:] for c in cols]
            parts = [kept]
        if len(kept[0]):
            yield found(*[np.concatenate(x) for x in zip(*parts)])

    return run


def _alike(pairs: DataFrame, base: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of uids whose whole sets have the similarity; sketches rule pairs out before any set is made."""

    def both(of: DataFrame, known: DataFrame, *cols: str) -> DataFrame:
        side = lambda name: known.select(F.col("uid").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in cols])
        return of.join(side("a"), "a").join(side("b"), "b")

    def fits(sketch: str) -> F.Column:
        differ = F.aggregate(F.zip_with(f"{sketch}_a", f"{sketch}_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return differ <= (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + 1e-6

    near = written(both(pairs, texts, "n", "bits").where(fits("bits")).select("a", "b"), "similar-near")
    ends = near.select(F.col("a").alias("uid")).unionByName(near.select(F.col("b").alias("uid"))).distinct()
    asked = texts.select("k", "uid").join(ends, "uid")
    one = base.select("k", "raw").join(asked, "k").groupBy("k", "uid").agg(F.first("raw").alias("raw"))  # by k, as the join: texts move once

    def sets_of():
        cache: dict = {}

        def run(texts):
            sets = [shingles(t, shingle, cache) for t in texts]
            return [sets, [len(x) for x in sets], [parities(x, LONG_BITS) if len(x) >= LONG_FROM else None for x in sets]]

        return run

    longs = T.ArrayType(T.LongType())
    fields = T.StructType([T.StructField("set", longs), T.StructField("n", T.LongType()), T.StructField("more", longs)])
    sets = written(map_texts(one, [F.col("raw")], ["uid"], fields, sets_of).select("row.uid", "set", "n", "more"), "similar-sets")
    let_go(sets.sparkSession)  # the texts that were moved

    nearer = written(both(near, sets, "n", "more").where(F.coalesce(fits("more"), F.lit(True))).select("a", "b"), "similar-nearer")
    common = F.size(F.array_intersect("set_a", "set_b"))
    alike = both(nearer, sets, "set").where(common >= similarity * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")
    found = written(alike, "similar-edges")
    let_go(sets.sparkSession, sets, near, nearer)
    return found


def _frequent(base: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a share of the texts, sorted, and the power of two of their counts; a list of bounded length."""

    def of_texts():
        cache: dict = {}
        return lambda texts: [[shingles(t, shingle, cache) for t in texts]]

    wanted = base.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < math.ceil((1 << 20) * SAMPLE_SHARE))
    sets = map_texts(wanted.select("k", "raw").dropDuplicates(["k"]), [F.col("raw")], ["k"], T.StructType([T.StructField("set", T.ArrayType(T.LongType()))]), of_texts)
    counts = sets.select(F.explode("set").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    rows = counts.orderBy(F.desc("n"), "key").limit(FREQUENT_MOST).toArrow()
    key, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(key, kind="stable")
    return key[order], np.frexp(n[order].astype(np.float64))[1].astype(np.int64)


def _marked(base: DataFrame, shingle: int, tables: int) -> DataFrame:
    """The distinct texts: k, uid, the fingerprints ``fps`` of their words, one a table, and the size and sketch of their shingle sets."""

    def marks():
        cache: dict = {}

        def run(texts):
            sets = [shingles(t, shingle, cache) for t in texts]
            return [[[fingerprint(t, 1, seed) for seed in range(tables)] for t in texts], [len(x) for x in sets], [parities(x) for x in sets]]

        return run

    longs = T.ArrayType(T.LongType())
    fields = T.StructType([T.StructField("fps", longs), T.StructField("n", T.LongType()), T.StructField("bits", longs)])
    made = map_texts(base, [F.col("raw")], ["k"], fields, marks)
    texts = made.groupBy("row.k").agg(F.first(F.struct("fps", "n", "bits")).alias("x")).select("k", "x.*")
    return written(texts.withColumn("uid", F.monotonically_increasing_id()), "similar-texts")


def _linked(texts: DataFrame, tables: int, distance: int) -> DataFrame:
    """Pairs of texts that the first ``tables`` fingerprints link: each text with the hub of its own, and the hubs of linked ones."""
    dealt = texts.select("uid", F.posexplode(F.slice("fps", 1, tables)).alias("t", "fp"))
    hubs = written(dealt.groupBy("t", "fp").agg(F.min("uid").alias("hub"), F.count("*").alias("n")), "similar-hubs")
    pairs = dealt.join(hubs.where("n > 1"), ["t", "fp"]).where("uid <> hub").select(F.col("hub").alias("a"), F.col("uid").alias("b"))
    a, b = (hubs.select("t", F.col("fp").alias(end), F.col("hub").alias(f"hub_{end}")) for end in "ab")
    near = links(hubs.select("t", "fp"), distance, direct=True).distinct().join(a, ["t", "a"]).join(b, ["t", "b"])
    pairs = pairs.unionByName(near.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b")))
    found = written(pairs.distinct(), "similar-linked")
    let_go(texts.sparkSession, hubs)
    return found


def _met(base: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, similarity: float, often: tuple[np.ndarray, np.ndarray], all_pairs: bool) -> DataFrame:
    """Pairs of texts with different roots that meet in a shingle of their prefixes."""
    named = texts.join(roots, "uid", "left").select("k", "uid", F.coalesce("root", "uid").alias("root"))
    one = base.select("k", "raw").dropDuplicates(["k"]).join(named, "k").select("uid", "root", "raw")
    dealt = one.mapInArrow(_prefixes(shingle, similarity, *often), "key long, uid long, root long, size int, place int")
    return written(dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_meetings(similarity, all_pairs), "a long, b long").distinct(), "similar-pairs")


def similar_groups(docs: DataFrame, *, text: str = "text", shingle: int = 5, similarity: float = 0.8, tables: int = 2, distance: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Per document: ``row`` (the kept columns) and ``group``: a number that it shares with all texts it is linked to.

    Texts are linked whose sets of word shingles have a Jaccard similarity of ``similarity`` or more, all of them; equal texts always are.
    ``tables`` and ``distance`` say what the fingerprints link before the rest is looked for: they change the work, not the groups.
    """
    if not 0 < similarity <= 1:
        raise ValueError("the similarity is above 0 and 1 at most")
    keep = docs.columns if keep is None else keep
    raw = F.coalesce(docs[text].cast("string"), F.lit(""))
    base = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), raw.alias("raw"), F.unhex(F.sha2(raw.cast("binary"), 256)).alias("k"))
    texts = _marked(base, shingle, tables)
    linked = _linked(texts, tables, distance)
    often = _frequent(base, shingle)
    edges = _alike(linked, base, texts, shingle, similarity)
    let_go(docs.sparkSession, linked)
    roots = components(edges, "similar-links")
    let_go(docs.sparkSession, edges)
    for all_pairs in (False, True):
        met = _met(base, texts, roots.withColumnRenamed("node", "uid"), shingle, similarity, often, all_pairs)
        let_go(docs.sparkSession)
        edges = _alike(met, base, texts, shingle, similarity)
        let_go(docs.sparkSession, met)
        roots = components(roots.toDF("a", "b").unionByName(edges), "similar-links")  # what was joined before is one star each
        let_go(docs.sparkSession, edges)
    roots = roots.withColumnRenamed("node", "uid")
    groups = texts.join(roots, "uid", "left").select("k", F.coalesce("root", "uid").alias("group"))
    return base.select("row", "k").join(groups, "k").select("row", "group")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of similar texts: the one of least id (a null id last), then of least text."""
    name = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    key = F.unhex(F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary"), 256))
    marked = docs.select(F.struct(*docs.columns).alias("_row"), docs[id_col].alias("_id"), name.alias("_name"), key.alias("_key"), docs[text].alias("_text"))
    grouped = similar_groups(marked, text="_text", keep=["_id", "_name", "_key"], **options)
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("row._id").isNull().alias("none"), F.col("row._id").alias("id"), F.col("row._key").alias("key"), F.col("row._name").alias("name"))).alias("x"))
    chosen = first.select(F.col("x.name").alias("_name"), F.col("x.key").alias("_key"))
    return marked.join(chosen, ["_name", "_key"], "left_semi").dropDuplicates(["_name", "_key"]).select("_row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.*", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
