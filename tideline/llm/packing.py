"""Vector best-fit packing of tokenised documents into sequences.

A document is tokenised, closed with ``end_id``, and cut only if it is longer than a sequence: pieces of full length, the first one
being what is left over. A piece needs (tokens, one document, attention cost = tokens squared); a sequence has a capacity of
each. Pieces are placed longest first; among open sequences with room in every dimension the one is taken whose weighted
residual norm after the placement is least (``norm``), or whose residual has the largest weighted dot product with the piece
(``dot``); if none fits, a new one is opened. The default capacities for documents and attention are what the token capacity implies,
so that they cost no sequence unless a caller sets them lower.

Defined cases: a null text counts as empty, and an empty text is one piece of ``end_id``; a piece that exceeds the attention
capacity alone gets a sequence of its own; repeated rows are packed as often as they stand there; an empty table gives an empty
result; extra columns pass through whatever their names.

Scale: tokenising is a narrow pass and its narrow result is written to the shared folder. Pieces are dealt by hash into groups of
about ``group_rows``, so that a group is a bounded task whatever the input; the sequences that a group leaves with room are packed
again over all groups, round by round, so that grouping costs next to nothing.
"""

from __future__ import annotations

import json
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import map_texts, table, written

PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
FIELDS = T.StructType([T.StructField("pieces", T.ArrayType(PIECE))])


def byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stand for themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Splits text where the byte-level pre-tokenizer of the library does, which has this pattern built in.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_plain_byte_level(spec: dict) -> bool:
    """Whether the file asks for byte-level BPE with the built-in pattern and nothing else, with merges in the order of their ids."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
    plain = plain and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain:
        return False
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"].get(m) for m in merged]
    return None not in ids and all(a < b for a, b in zip(ids, ids[1:]))


@cache
def encoder(path: str):
    """text -> uint32 ids of the tokenizer file at ``path``, special tokens in the text included.

    The file is run by the library that it is written for. A byte-level file that asks for nothing but the library's built-in
    pattern is run by a faster one with the same vocabulary, but for texts with the string of a special token; tests hold both
    against each other.
    """
    full = Tokenizer.from_file(path)

    def by_file(text: str) -> np.ndarray:
        return np.array(full.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not is_plain_byte_level(spec):
        return by_file
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    at = byte_of()
    ranks = {bytes(at[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}
    quick = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return by_file(text) if any(s in text for s in specials) else np.array(quick.encode_ordinary(text), np.uint32)

    return encode


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces."""
    first = len(ids) % capacity or capacity
    cuts = [0, *range(min(first, len(ids)), len(ids), capacity), len(ids)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _tokenise(path: str, end_id: int, capacity: int, with_ids: bool):
    encode = encoder(path)

    def run(texts):
        out = []
        for t in texts:
            ids = np.append(encode(t or ""), np.uint32(end_id)).astype("<u4")
            out.append([(a, n, zlib.crc32(ids[a : a + n].tobytes()), ids[a : a + n].tolist() if with_ids else None) for a, n in pieces_of(ids, capacity)])
        return [out]

    return run


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), select: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Bins of equal residual vectors are one state and are filled together."""
    cap, w = np.array(capacity, float), np.array(weights, float)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []  # tokens in each bin
    states = np.empty((64, 3))
    members: list[list[int]] = []
    where: dict[tuple, int] = {}
    values, starts, counts = np.unique(-lengths[order], return_index=True, return_counts=True) if len(order) else ([], [], [])
    for value, at, count in zip(values, starts, counts):
        length = -int(value)
        need = np.array([length, 1.0, float(length) ** 2])
        todo = order[at : at + count].tolist()
        todo.reverse()
        while todo:
            live = states[: len(members)]
            ok = np.flatnonzero((live >= need).all(axis=1))
            if len(ok):
                after = (live[ok] - need) / cap
                score = (w * after**2).sum(axis=1) if select == "norm" else -(w * live[ok] * need / cap**2).sum(axis=1)
                state = int(ok[np.argmin(score)])
                chosen, residual = members[state], states[state] - need
                k = min(len(chosen), len(todo))
                picked = chosen[-k:]
                del chosen[-k:]
                if not chosen:  # drop the state; the last one takes its place
                    where.pop(tuple(states[state]))
                    last = len(members) - 1
                    if state != last:
                        states[state], members[state] = states[last], members[last]
                        where[tuple(states[state])] = state
                    members.pop()
            else:
                residual = cap - need
                k = 1 if (residual >= need).all() else len(todo)
                picked = list(range(len(used), len(used) + k))
                used += [0] * k
            for b in picked:
                i = todo.pop()
                bins[i], offsets[i] = b, used[b]
                used[b] += length
            if residual[0] >= 1 and residual[1] >= 1 and residual[2] >= 1:
                key = tuple(residual)
                if key not in where:
                    if len(members) == len(states):
                        states = np.concatenate([states, np.empty_like(states)])
                    where[key] = len(members)
                    states[len(members)] = residual
                    members.append([])
                members[where[key]] += picked
    return bins, offsets


def tokenised(docs: DataFrame, path: str, *, text: str = "text", capacity: int = 1024, end_id: int = 2, with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Per piece: ``row`` (the kept columns), piece, start, length, crc, ids."""
    df = map_texts(docs, [docs[text].cast("string")], docs.columns if keep is None else keep, FIELDS, lambda: _tokenise(path, end_id, capacity, with_ids))
    df = df.select("row", F.posexplode("pieces").alias("piece", "p"))
    return df.select("row", "piece", "p.start", "p.length", "p.crc", *(["p.ids"] if with_ids else []))


def pack(pieces: DataFrame, *, capacity: int = 1024, max_docs: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), select: str = "norm", group_rows: int = 20_000, full: float = 0.98) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is what a piece needs.

    Sequences of a group that are less than ``full`` in every capacity are opened again and packed with those of the other groups,
    until one group holds what is left or a round saves nothing.
    """
    limits = (float(capacity), float(max_docs or capacity), float(max_attention or capacity**2))
    pieces = written(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("_uid")
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit(lengths, limits, weights, select)
        ids = table.column("_group").to_numpy() * (1 << 32) + bins
        used = np.stack([np.bincount(bins, w) for w in (lengths, np.ones(len(lengths)), lengths.astype(float) ** 2)], axis=1) / np.array(limits)
        closed = (used.max(axis=1) >= full)[bins] if len(bins) else np.zeros(0, bool)
        return pa.table({"_uid": table.column("_uid"), "length": table.column("length"), "sequence_id": pa.array(ids, pa.int64()), "offset": pa.array(offsets, pa.int64()), "closed": pa.array(closed)})

    todo, done, base = pieces.select("_uid", F.col("length").cast("long").alias("length")), [], 0
    n = todo.count()
    while True:
        groups = max(1, -(-n // group_rows))
        dealt = todo.withColumn("_group", F.pmod(F.xxhash64("_uid"), F.lit(groups)) + base)
        placed = written(dealt.groupBy("_group").applyInArrow(place, "_uid long, length long, sequence_id long, offset long, closed boolean"), "placed")
        base += groups
        rest = placed.where("NOT closed")
        left = rest.count() if groups > 1 else 0
        if left == 0 or left > n // 2:
            done.append(placed)
            break
        done.append(placed.where("closed"))
        todo, n = rest.select("_uid", "length"), left
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return pieces.join(out.select("_uid", "sequence_id", "offset"), "_uid").drop("_uid")


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    pieces = tokenised(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, keep=["doc_id"])
    return pack(pieces).select("row.*", "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
