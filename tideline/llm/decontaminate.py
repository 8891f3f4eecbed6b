"""Benchmark decontamination with one Aho-Corasick automaton over normalised test texts.

Texts are normalised to lower-cased words joined by single spaces; every window of ``window`` consecutive words of a
benchmark item is a pattern (an item of fewer words, but not none, is one pattern). Each document is scanned once,
and hits are mapped back to code-point offsets of the original text.

Defined cases: a null or empty text has no words and no hits; null or empty items give no pattern; an item
without an id has its words hit, but is not named or counted; items with equal windows are all reported; repeated documents are each judged on their own; extra columns pass through untouched, whatever
their names; an empty benchmark leaves every document clean.

Scale: the scan is a narrow pass over the documents without a shuffle. The benchmark is dealt into blocks by a bound on its
bytes (``block_bytes``); each block becomes one automaton and one pass, so that what is broadcast stays bounded however
large the benchmark grows.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Callable

import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, table, unpack

#: Bytes that separate words: all of ASCII but digits and letters. Upper-case letters become lower-case ones.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def words(text: str | None) -> list[str]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).decode("utf-8", "replace").split(" ") if text else []


def normal(text: str | None) -> list[str]:
    return [w for w in words(text) if w]


def patterns(rows: list[tuple[str, str]], window: int) -> dict[str, tuple[int, list[str]]]:
    """Pattern text -> (its number of words, the items that have it)."""
    out: dict[str, tuple[int, list[str]]] = {}
    for item, text in rows:
        ws = normal(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1) if n else ():
            key = f" {' '.join(ws[i : i + n])} "
            have = out.setdefault(key, (n, []))[1]
            if item is not None and item not in have:
                have.append(item)
    return out


def automaton(pats: dict[str, tuple[int, list[str]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for key, value in pats.items():
        a.add_word(key, value)
    if pats:
        a.make_automaton()
    return a


def _merged(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scanner(pats: dict[str, tuple[int, list[str]]]):
    auto = automaton(pats)

    def scan(texts, runs_before, items_before):
        n_words, runs, items, spans = [], [], [], []
        for text, r0, i0 in zip(texts, runs_before, items_before):
            ws = normal(text)
            n_words.append(len(ws))
            r, found = [list(x) for x in r0 or ()], set(i0 or ())
            if ws and pats:
                line = f" {' '.join(ws)} "
                starts = None
                for end, (n, its) in auto.iter(line):
                    if starts is None:
                        starts, at = [], 1
                        for w in ws:
                            starts.append(at)
                            at += len(w) + 1
                    last = bisect_right(starts, end - 1)
                    r.append([last - n, last])
                    found.update(its)
            r = _merged(r)
            runs.append(r)
            items.append(sorted(found))
            at = [m.span() for m in _WORD.finditer(text)] if r else []
            spans.append([[at[a][0], at[b - 1][1]] for a, b in r])
        return [n_words, runs, items, spans]

    return scan


_SCANNERS: dict[str, Callable] = {}


def _scanner_of(key: str, sent: Broadcast) -> Callable:
    """The scanner of a benchmark block, made once in each Python worker and not once a task; workers keep the last few."""
    if key not in _SCANNERS:
        while len(_SCANNERS) >= 2:
            _SCANNERS.pop(next(iter(_SCANNERS)))
        _SCANNERS[key] = scanner(sent.value)
    return _SCANNERS[key]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_texts: tuple[str, ...] = ("text",),
    window: int = 10,
    keep: list[str] | None = None,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Per document: ``row`` (the kept columns), n_words, n_hit, items, spans (of hit runs, in the original text), contaminated."""
    spark = docs.sparkSession
    texts = benchmark.select(F.col(item).cast("string").alias("item"), F.explode(F.array(*[F.col(c).cast("string") for c in item_texts])).alias("text"))
    texts = texts.where(F.col("text").isNotNull())
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    keep = docs.columns if keep is None else keep
    out = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text].cast("string").alias("text"), F.lit(None).cast("array<array<bigint>>").alias("runs"), F.lit(None).cast("array<string>").alias("items"))
    for b in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(patterns([tuple(r) for r in part.collect()], window))
        key = uuid.uuid4().hex
        out = map_texts(out, [F.col("text"), F.col("runs"), F.col("items")], ["row", "text"], FIELDS, lambda key=key, sent=sent: _scanner_of(key, sent))
        out = out.select("row.row", "row.text", "n_words", "runs", "items", "spans")
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])
    return out.select("row", "n_words", n_hit.alias("n_hit"), "items", "spans").withColumn("contaminated", F.col("n_hit") > 0)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return unpack(out, F.col("n_words"), F.col("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.col("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
        FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM pat) WHERE len(w) >= k)),
hit AS (SELECT win.doc_id, win.i, win.k, pat.item_id FROM win JOIN pat USING (k, p)),
pos AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(len(its.items), 0)::BIGINT AS n_items,
       sha256(array_to_string(coalesce(its.items, []), ',')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
