"""Removal of long repeated byte strings, found by external induced sorting of suffixes.

Every byte that lies in a string of ``length`` bytes which also starts elsewhere (in any document, the same one included) is removed;
strings are judged on the input. The work goes from cheap necessary conditions to the exact suffix sort:

1. Each document's anchors: a byte k-gram is an anchor where it is the least by hash in some window of k-grams. Equal strings
   have equal anchors at equal places, so a repeated string holds only anchors whose hash is counted twice or more in the corpus.
2. Runs of starts whose anchors are all counted twice are cut into contexts, one per least k-gram of a string, which names the
   shard; equal strings meet in one shard. Equal contexts are merged and counted before they are shuffled.
3. Each shard's contexts go through the external induced sorter (``suffix``), which marks the starts whose common prefix with a
   neighbour reaches ``length``; a context that stands twice is marked whole.
4. Marks go back to the documents, the bytes they cover are joined to spans, and the rest is kept.

A collision of anchors' hashes costs work, never a result. Texts and contexts are told apart by their SHA-256, S* names in the sorter by
64-bit fingerprints: two different names of one fingerprint in one shard would be taken for equal.

Defined cases: a null text counts as empty; texts shorter than ``length`` lose nothing; equal texts are repeats of each other, so
all their bytes go if they are long enough; repeated rows are copies like any others; cuts may fall within a character, the kept
bytes are what the digest is taken of; an empty table gives an empty result; extra columns pass through whatever their names.

Scale: equal texts are worked on once; counts are pre-aggregated; a hot passage shrinks to one context before the shuffle; nothing is
broadcast or collected; a shard's sort spills, and the lists of a document grow with that document only.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BATCH_ROWS, map_texts, table, written
from .suffix import repeats

MULTIPLIER = 0x9E3779B97F4A7C15
GRAM = 100
#: Bytes of contexts that a shard sorts at once; a larger group of contexts is sorted alone, spilling.
SHARD_BYTES = 3 << 19


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse up to n, and the values of bytes."""
    up, down = np.full(n, MULTIPLIER, np.uint64), np.full(n, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), np.random.default_rng(9).integers(0, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(raw: bytes, k: int) -> np.ndarray:
    """A hash of each k-gram."""
    n = len(raw)
    up, down, values = powers(1 << max(12, n.bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[np.frombuffer(raw, np.uint8)] * up[:n], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of each ``width`` neighbours: running extremes within blocks, from both sides."""
    f = np.minimum if least else np.maximum
    n = len(values)
    pad = np.full(-n % width, np.iinfo(values.dtype).max if least else np.iinfo(values.dtype).min, values.dtype)
    blocks = np.concatenate([values, pad]).reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it is an anchor at two places or more) of the document's anchors; windows are half a string long."""
    half = length // 2
    h = gram_hashes(raw, GRAM)
    low = sliding(h, half - GRAM + 1, True)
    width = half - GRAM + 1
    edge = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([edge, low, edge]), width, False)
    found, counts = np.unique(h[best == h], return_counts=True)
    return found, counts > 1


def live_starts(raw: bytes, known: np.ndarray, length: int) -> np.ndarray:
    """Marks of the string starts all of whose windows have an anchor among ``known`` (sorted)."""
    half = length // 2
    low = sliding(gram_hashes(raw, GRAM), half - GRAM + 1, True)
    at = np.minimum(np.searchsorted(known, low), len(known) - 1)
    bad = np.r_[0, np.cumsum(known[at] != low)]
    return bad[length - half + 1 :] == bad[: len(bad) - (length - half + 1)]


def contexts(raw: bytes, known: np.ndarray, length: int) -> list[tuple[int, int, int, bool]]:
    """(route, first start, last start, whether the least k-gram stands there twice) of runs of live starts with one least k-gram."""
    live = live_starts(raw, known, length)
    if not live.any():
        return []
    h = gram_hashes(raw, GRAM)
    width = length - GRAM + 1
    low = sliding(h, width, True)
    cut = np.flatnonzero(np.r_[True, (live[1:] != live[:-1]) | (low[1:] != low[:-1])])
    end = np.r_[cut[1:], len(live)] - 1
    keep = live[cut]
    out = []
    for a, b in zip(cut[keep].tolist(), end[keep].tolist()):
        twice = b - a >= width or int((h[a : b + width] == low[a]).sum()) > 1
        out.append((int(low[a].astype(np.int64)), a, b, twice))
    return out


def _anchor_map(length: int):
    def run(texts):
        out = []
        for t in texts:
            raw = t or b""
            if len(raw) < length:
                out.append(([], []))
            else:
                h, twice = anchors(raw, length)
                out.append((h.view(np.int64), twice))
        return [[a for a, _ in out], [b for _, b in out]]

    return run


def _cutter(length: int):
    """batches (uid, raw, known) -> contexts."""
    names = ["uid", "at", "route", "twice", "key", "bytes"]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH_ROWS // 4):
                batch = whole.slice(lo, BATCH_ROWS // 4)
                rows: list[list] = [[] for _ in names]
                for i in range(batch.num_rows):
                    uid, raw = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    known = np.sort(batch.column(2).slice(i, 1).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                    for route, a, b, twice in contexts(raw, known, length):
                        piece = raw[a : b + length]
                        for row, v in zip(rows, (uid, a, route, twice, hashlib.sha256(piece).digest()[:16], piece)):
                            row.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.bool_()), pa.array(rows[4], pa.binary()), pa.array(rows[5], pa.binary())], names=names)

    return run


def _sorter(length: int):
    """batches (route, key, count, twice, bytes), by route -> (key, runs of repeated starts)."""

    def runs(marks: np.ndarray) -> list[list[int]]:
        edge = np.flatnonzero(np.diff(np.r_[0, marks.astype(np.int8), 0]))
        return [[int(a), int(b) - 1] for a, b in zip(edge[::2], edge[1::2])]

    def solve(rows, alone):
        marks = repeats([raw for *_, raw in rows], length)
        found = [(key, [[0, len(raw) - length]] if n > 1 else runs(m)) for (_, key, n, _, raw), m in zip(rows, marks)]
        found = [x for x in found + alone if x[1]]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([r for _, r in found], pa.list_(pa.list_(pa.int64())))], names=["key", "runs"])

    def run(batches):
        done, alone, group, size = [], [], [], 0  # rows of whole routes, answers without a sort, rows of the route that goes on

        def close():
            nonlocal size
            if len(group) == 1 and not group[0][3]:  # the only context of its route: a repeat of itself, or of nothing
                _, key, n, _, raw = group[0]
                if n > 1:
                    alone.append((key, [[0, len(raw) - length]]))
            else:
                done.extend(group)
                size += sum(len(r[4]) for r in group)
            group.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if group and row[0] != group[0][0]:
                    close()
                    if size >= SHARD_BYTES or len(alone) > 100_000:
                        yield solve(done, alone)
                        done, alone, size = [], [], 0
                group.append(row)
        close()
        yield solve(done, alone)

    return run


def _remover(length: int):
    """raw bytes and lists of repeated runs -> (removed spans, bytes removed, digest of what is kept)."""

    def run(raws, lists):
        spans, removed, digests = [], [], []
        for raw, starts in zip(raws, lists):
            raw, out, at, digest = raw or b"", [], 0, hashlib.sha256()
            for a, b in sorted((a, b + length) for a, b in starts or ()):
                if out and a <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], b)
                else:
                    out.append([a, b])
            for a, b in out:
                digest.update(raw[at:a])
                at = b
            digest.update(raw[at:])
            spans.append(out)
            removed.append(sum(b - a for a, b in out))
            digests.append(digest.hexdigest())
        return [spans, removed, digests]

    return run


REMOVED = T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])


def repeated_spans(docs: DataFrame, *, text: str = "text", length: int = 400, keep: list[str] | None = None) -> DataFrame:
    """Per document: ``row`` (the kept columns), n_bytes, spans (removed byte runs), n_removed, kept_sha256.

    ``length`` is 2 * GRAM at least.
    """
    if length < 2 * GRAM:
        raise ValueError(f"strings must have {2 * GRAM} bytes at least")
    keep = docs.columns if keep is None else keep
    raw = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), raw.alias("raw"), F.unhex(F.sha2(raw, 256)).alias("k"), F.octet_length(raw).cast("bigint").alias("n_bytes"))

    # 1. Distinct texts with their anchors; anchors that are counted twice in the corpus.
    fields = T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("twice", T.ArrayType(T.BooleanType()))])
    long = base.where(F.col("n_bytes") >= length)
    found = map_texts(long, [F.col("raw")], ["k"], fields, lambda: _anchor_map(length))
    texts = found.groupBy("row.k").agg(F.count("*").alias("copies"), F.first(F.struct("hashes", "twice")).alias("a"))
    texts = written(texts.select("k", "copies", "a.hashes", "a.twice").withColumn("uid", F.monotonically_increasing_id()), "repeat-texts")
    each = texts.select("uid", F.explode(F.arrays_zip("hashes", "twice")).alias("x")).select("uid", F.col("x.hashes").alias("hash"), F.col("x.twice").alias("twice"))
    again = each.groupBy("hash").agg((F.count("*") + F.max(F.col("twice").cast("int"))).alias("n")).where(F.col("n") > 1).select("hash")
    known = each.select("uid", "hash").join(again, "hash").groupBy("uid").agg(F.collect_list("hash").alias("known"))

    # 2. Contexts of the texts that may hold repeats.
    some = texts.select("k", "copies", "uid").join(known, "uid")
    held = written(_one_each(long, some), "repeat-candidates")
    cut = held.select("uid", "raw", "known").mapInArrow(_cutter(length), "uid long, at long, route long, twice boolean, key binary, bytes binary")
    cut = written(cut, "repeat-contexts")

    # 3. Shards of distinct contexts through the sorter.
    distinct = cut.groupBy("route", "key").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.first("bytes").alias("bytes"))
    shards = distinct.select("route", "key", "n", "twice", "bytes")
    marks = shards.repartition("route").sortWithinPartitions("route").mapInArrow(_sorter(length), "key binary, runs array<array<long>>")

    # 4. Back to the texts.
    shifted = F.transform("runs", lambda r: F.array(r[0] + F.col("at"), r[1] + F.col("at")))
    starts = cut.select("uid", "at", "key").join(marks, "key").select("uid", shifted.alias("runs")).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    partial = map_texts(held.select("uid", "k", "raw").join(starts, "uid"), [F.col("raw"), F.col("runs")], ["k"], REMOVED, lambda: _remover(length)).select("row.k", "spans", "n_removed", "kept")
    result = texts.select("k", "copies").join(partial, "k", "left")
    out = base.select("row", "k", "n_bytes").join(result, "k", "left")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    none = F.array().cast("array<array<bigint>>")
    return out.select(
        "row",
        "n_bytes",
        F.when(whole, F.array(F.array(F.lit(0).cast("bigint"), F.col("n_bytes")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", F.lower(F.hex("k")))).alias("kept_sha256"),
    )


def _one_each(long: DataFrame, some: DataFrame) -> DataFrame:
    """One text of each group of copies, with what ``some`` knows of it."""
    return long.select("k", "raw").join(some, "k").groupBy("uid", "k", "copies").agg(F.first("raw").alias("raw"), F.first("known").alias("known"))


def without_repeats(docs: DataFrame, *, text: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with the repeated bytes cut out of the text; characters that a cut halves become the replacement character."""
    out = repeated_spans(docs, text=text, length=length)
    raw = F.col(f"row.{text}").cast("binary")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(b"").alias("out"))
    cut = F.aggregate("spans", start, lambda s, x: F.struct(x[1].alias("at"), F.concat(s["out"], F.substring(raw, (s["at"] + 1).cast("int"), (x[0] - s["at"]).cast("int"))).alias("out")), lambda s: F.concat(s["out"], F.substring(raw, (s["at"] + 1).cast("int"), F.octet_length(raw))))
    clean = F.when(F.size("spans") > 0, F.decode(cut, "UTF-8")).otherwise(F.col(f"row.{text}"))
    return out.select(*[clean.alias(c) if c == text else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("row.*", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS w FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
twice AS (SELECT w FROM starts GROUP BY w HAVING count(*) > 1),
hit AS (SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM starts WHERE w IN (SELECT w FROM twice)),
runs AS (SELECT rid, i, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM hit),
spans AS (SELECT rid, run, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY rid, run),
cuts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT rid, count(*) AS n, sum(b - a) AS removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k FROM cuts JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""
