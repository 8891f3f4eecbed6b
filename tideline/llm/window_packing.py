"""Packing by non-negative least squares: combinations of lengths that fill a window exactly, repeated as the histogram asks.

A document is tokenised and closed with ``end_id``; whole windows of it are sequences of their own, what is left over is an item of
1 to ``capacity - 1`` tokens. Only the histogram of the item lengths reaches the driver, a number a length. For a window the
combinations of up to three lengths that fill it are enumerated, non-negative least squares says how often each should be repeated so
that the histogram is met, the counts are rounded within what there is, and the next round goes on with the rest; what least squares
leaves is taken greedily, until no combination of three fills the window any more. The windows are the sequence itself, then a sixteenth
of it, an eighth and so on up to the sequence again: a filled part is an item of the next window, so that many short documents share a
sequence though each combination is shallow. Items that fit nowhere are laid end to end, longest first, and only these are cut, where a
sequence ends; the last tokens go to sequences whose sizes are powers of two. So no sequence needs padding.

Items of one length are numbered: within their task when they are written, and over all tasks by the sums of the tasks before. The plan
says which numbers of a length go where; an item's place is looked up by length and number.

Defined cases: a null text counts as empty, and an empty text is the single token ``end_id``; repeated rows are packed as often as they
stand there; an empty table gives an empty result; extra columns pass through whatever their names.

Scale: one tokenising pass, written to the shared folder with its ids (two bytes each where the vocabulary allows); a partial aggregate
by (task, length); a window over the tasks of a length; one join that brings each item the sum before its task; one narrow pass that
cuts. The plan's size is bounded by ``capacity``, whatever the number of documents. A length that a third of all documents have
is one number in the histogram and many tasks in the join, which goes by task and length.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import BATCH_ROWS, table, written
from .packing import byte_of

#: Marks the end of a piece, and of a word.
END, BREAK = "\x1f", "\n"
#: Words with these go to the library: beyond Latin to Cyrillic scripts the libraries' tables may differ; white space that isn't ASCII;
#: letters that Python lowers by their place or to two.
HARD = "[\x1c-\x1f\x85\xa0\u0130\u03a3]|[^\x00-\u052f]"
#: Texts are encoded in slices of about this size.
SLICE_BYTES = 4 << 20


def splits_at_spaces(spec: dict) -> bool:
    """Whether the file's pieces never hold white space, so that words between spaces can be encoded one by one."""
    steps = spec.get("normalizer") or {}
    norms = [n.get("type") for n in steps.get("normalizers", [steps])]
    pre = spec.get("pre_tokenizer") or {}
    first, *more = pre.get("pretokenizers") or [pre]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    apart = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"\s" not in pattern.replace(r"[^\s", "") and " " not in pattern
    plain = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex", True) for p in more)
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return bool(apart and plain and added) and norms == ["NFC", "Replace", "Lowercase"]


def bulk_encoder(spec: dict):
    """array of words -> (ids of all, number of each), or None where the file isn't a plain BPE with word ends.

    The end of a piece is written as a byte of its own, whose merge with the byte before it comes first; then merges go by their ids.
    All words are encoded at once, a line break between two of them.
    """
    model = spec["model"]
    suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
    if model.get("type") != "BPE" or not suffix or None in merged or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return None
    at = byte_of()
    base = [vocab.get(c + s) for c in at for s in ("", suffix)]
    if None in base or max(base) >= merged[0] or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    own = {vocab[c] for c in at}
    ranks = {(bytes(at[c] for c in t.removesuffix(suffix)) + END.encode() if t.endswith(suffix) and i not in own else bytes(at[c] for c in t)): i for t, i in vocab.items()}
    quick = tiktoken.Encoding("words", pat_str=rf"[^{END}{BREAK}]+{END}|{BREAK}", mergeable_ranks=ranks, special_tokens={})
    pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    apart = vocab[next(c for c, b in at.items() if b == ord(BREAK))]

    def encode(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        line = BREAK.join(words.to_pylist())
        if not (line.isascii() or unicodedata.is_normalized("NFC", line)):
            line = unicodedata.normalize("NFC", line)
        ended = pc.replace_substring_regex(pc.utf8_lower(pa.scalar(line)), pattern, rf"\0{END}")
        ids = np.array(quick.encode_ordinary(ended.as_py()), np.uint32)
        cuts = np.flatnonzero(ids == apart)
        return np.delete(ids, cuts), np.diff(np.r_[-1, cuts, len(ids)]) - 1

    return encode


@cache
def encoder(path: str):
    """(array of texts -> (ids of all, number of each), dtype of the ids) for the tokenizer file at ``path``, special tokens included.

    Where the file's pieces never hold white space, a word between spaces has the same ids in every text, so that each different word
    of a slice is encoded once. It goes to the library that the file is written for, or, where the file is a plain BPE with word
    ends, to a faster one with the same vocabulary; tests hold both against each other.
    """
    full = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kind = np.dtype("<u2") if full.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def by_file(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(full.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    if not splits_at_spaces(spec):
        return lambda texts: by_file(texts.to_pylist()), kind
    quick = bulk_encoder(spec)
    hard = "|".join([HARD, *[re.escape(t["content"]) for t in spec.get("added_tokens", [])]])

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        at = np.asarray(split.offsets)
        coded = split.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        odd = pc.match_substring_regex(words, hard).to_numpy(zero_copy_only=False) if quick else np.ones(len(words), bool)
        ids, sizes = [np.empty(0, np.uint32)], np.empty(len(words), np.int64)
        if not odd.all():
            found, sizes[~odd] = quick(words.filter(pa.array(~odd)))
            ids.append(found)
        more, sizes[odd] = by_file(words.filter(pa.array(odd)).to_pylist())
        flat = np.concatenate([*ids, more])
        order = np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]  # as they stand in ``flat``
        first = np.empty(len(words), np.int64)
        first[order] = np.r_[0, np.cumsum(sizes[order])][:-1] if len(order) else 0
        n = sizes[which]
        ends = np.r_[0, np.cumsum(n)]
        out = flat[np.repeat(first[which] - ends[:-1], n) + np.arange(ends[-1])]
        return out, np.diff(ends[at - at[0]])

    return encode, kind


def slices(batch: pa.RecordBatch, column: int):
    """The batch in slices of about ``SLICE_BYTES`` of a text column; a longer text is one slice."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    block = (np.cumsum(sizes) - sizes) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(block)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def combinations(lengths: np.ndarray, counts: np.ndarray, window: int, per_length: int = 4) -> np.ndarray:
    """Rows (a, b, c) of present lengths that add up to ``window``, 0 for none: all pairs, and of the triples the ``per_length`` of
    each length that could be repeated most."""
    c = np.zeros(window + 1, np.int64)
    c[lengths] = counts
    a = np.flatnonzero(c[: window // 2 + 1])
    pairs = a[c[window - a] > 0]
    pairs = np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1)
    small = lengths[lengths <= window // 3]
    triples = []
    for least in small.tolist():
        mid = np.arange(least, (window - least) // 2 + 1)
        mid = mid[(c[mid] > 0) & (c[window - least - mid] > 0)]
        triples.append(np.stack([np.full_like(mid, least), mid, window - least - mid], axis=1))
    triples = np.concatenate(triples) if triples else np.empty((0, 3), np.int64)
    if len(triples):
        most = np.minimum(np.minimum(c[triples[:, 0]], c[triples[:, 1]]), c[triples[:, 2]])
        keep = np.zeros(len(triples), bool)
        for j in range(3):
            order = np.lexsort((-most, triples[:, j]))
            who = triples[order, j]
            first = np.r_[0, np.flatnonzero(np.diff(who)) + 1]
            place = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
            keep[order[place < per_length]] = True
        triples = triples[keep]
    return np.concatenate([pairs, triples]).astype(np.int64)


def nnls(rows: np.ndarray, target: np.ndarray, steps: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    """x >= 0 that makes ``A x`` nearest to ``target``, by accelerated projected gradients; column j of A counts the lengths in rows[j].

    Length 0 stands for none. The columns are sparse, so that a step is a gather and a bincount.
    """
    n = len(target)
    real = rows > 0
    down = lambda x: np.bincount(rows[real], np.broadcast_to(x[:, None], rows.shape)[real], n)
    up = lambda y: (y[rows] * real).sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(30):
        v = up(down(v))
        v /= max(1e-300, np.linalg.norm(v))
    steepest = 1.05 * float(np.linalg.norm(up(down(v))))
    x, y, t = np.zeros(len(rows)), np.zeros(len(rows)), 1.0
    for _ in range(steps):
        nxt = np.maximum(0.0, y - up(down(y) - target) / steepest)
        if ((y - nxt) * (nxt - x)).sum() > 0:  # momentum points uphill: start it anew
            t = 1.0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        moved = np.abs(nxt - x).max()
        x, t = nxt, t2
        if moved <= tolerance * max(1.0, float(x.max())):
            break
    return x


def filled(counts: np.ndarray, window: int, rounds: int = 60) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """([(combination, repeats)], what is left of ``counts``); counts[length] is the number of items. Only whole windows are filled."""
    left = counts.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    for _ in range(rounds):
        lengths = np.flatnonzero(left[:window])
        rows = combinations(lengths, left[lengths], window) if len(lengths) else np.empty((0, 3), np.int64)
        if not len(rows):
            break
        x = nnls(rows, left[: window + 1].astype(float))
        wanted = np.rint(x).astype(np.int64)
        if not wanted.any():
            wanted[:] = np.iinfo(np.int64).max  # nothing rounds up: greedily, as often as there are items
        took = 0
        for j in np.argsort(-x, kind="stable"):
            if wanted[j]:
                a, b, c = rows[j].tolist()
                need: dict[int, int] = {}
                for m in (a, b, c):
                    if m:
                        need[m] = need.get(m, 0) + 1
                k = min(int(wanted[j]), *(int(left[m]) // times for m, times in need.items()))
                if k:
                    for m, times in need.items():
                        left[m] -= k * times
                    out.append((tuple(m for m in (c, b, a) if m), k))
                    took += k
        if not took:
            # Rounding asked only for what is used up: take each combination as often as it still goes.
            for a, b, c in rows.tolist():
                need = {m: (a, b, c).count(m) for m in (a, b, c) if m}
                k = min(int(left[m]) // times for m, times in need.items())
                if k:
                    for m, times in need.items():
                        left[m] -= k * times
                    out.append((tuple(m for m in (c, b, a) if m), k))
    return out, left


class Level:
    """One window's combinations: which numbers of a length go to which block, and where in it."""

    def __init__(self, window: int, counts: np.ndarray):
        self.window = window
        combos, self.left = filled(counts, window)
        uses, used, block = [], np.zeros_like(counts), 0
        for combo, k in combos:
            at = 0
            for m in combo:
                uses.append((m, int(used[m]), k, block, at))
                used[m] += k
                at += m
            block += k
        self.blocks, self.used = block, used
        u = np.array(sorted(uses), np.int64).reshape(-1, 5)
        self.key, self.first, self.block, self.offset = (u[:, 0] << 48) + u[:, 1], u[:, 1], u[:, 3], u[:, 4]

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether the item is used, its block, its offset); the block of others is their number among what is left."""
        inside = number < self.used[length]
        i = np.maximum(0, np.searchsorted(self.key, (length << 48) + number, "right") - 1)
        if not len(self.key):
            return inside, number, np.zeros_like(number)
        return inside, np.where(inside, self.block[i] + number - self.first[i], number - self.used[length]), np.where(inside, self.offset[i], 0)


class Plan:
    """Where each (length, number) goes. ``counts[length]`` is the histogram, up to ``capacity``."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        windows = [capacity, *[capacity >> s for s in (4, 3, 2, 1) if capacity >> s >= 2 and capacity % (1 << s) == 0], capacity]
        self.levels: list[Level] = []
        self.bases: list[int] = []  # sequences before each level's, or items of the window's length before its blocks
        sequences, counts = 0, counts.copy()
        for w in windows:
            level = Level(w, counts)
            counts = level.left.copy()
            if w == capacity:
                self.bases.append(sequences)
                sequences += level.blocks
            else:
                self.bases.append(int(counts[w]))
                counts[w] += level.blocks
            self.levels.append(level)
        self.left, self.sequences = counts, sequences
        size = np.arange(len(counts)) * counts
        self.start = size[::-1].cumsum()[::-1] - size  # longest first
        total = int(size.sum())
        tail, at, cuts = total % capacity, total - total % capacity, []
        for p in range(capacity.bit_length(), -1, -1):
            if tail >> p & 1:
                cuts.append(at)
                at += 1 << p
        self.whole, self.cuts = total - total % capacity, np.array([*cuts, total], np.int64)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, position among what is laid end to end): the position is -1 for items that have a sequence."""
        length, number = length.copy(), number.copy()
        inner = np.zeros_like(number)
        sequence = np.full_like(number, -1)
        for level, base in zip(self.levels, self.bases):
            open_ = sequence < 0
            inside, block, offset = level.place(length, number)
            inside, skipped = inside & open_, ~inside & open_
            number[skipped] = block[skipped]
            inner[inside] += offset[inside]
            if level.window == self.capacity:
                sequence[inside] = base + block[inside]
            else:
                number[inside] = base + block[inside]
                length[inside] = level.window
        position = np.where(sequence < 0, self.start[length] + number * length + inner, -1)
        return sequence, inner, position

    def cut(self, position: int, length: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of what is laid end to end."""
        out, at, end = [], position, position + length
        while at < end:
            if at < self.whole:
                n = at // self.capacity
                lo, hi = n * self.capacity, (n + 1) * self.capacity
            else:
                i = int(np.searchsorted(self.cuts, at, "right"))
                n, lo, hi = self.whole // self.capacity + i - 1, int(self.cuts[i - 1]), int(self.cuts[i])
            stop = min(end, hi)
            out.append((at - position, stop - at, self.sequences + n, at - lo))
            at = stop
        return out


def tokenised(docs: DataFrame, path: str, *, text: str = "text", capacity: int = 4096, end_id: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Per document: ``row`` (the kept columns), ids (binary), doc_tokens, rest (its last item's length, 0 if none), part (the task), n (the
    item's number among those of its length in the task), full (the number of whole windows before it in the task)."""
    keep = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text].cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string("ids binary, doc_tokens bigint, rest bigint, part bigint, n bigint, full bigint").fields])

    def run(batches):
        encode, kind = encoder(path)
        part, seen, full = TaskContext.get().partitionId(), np.zeros(capacity, np.int64), 0
        for whole in batches:
            for b in slices(whole, 1):
                ids, tokens = encode(pc.fill_null(b.column(1), ""))
                tokens = tokens + 1
                ends = np.cumsum(tokens)
                closed = np.full(ends[-1], end_id, kind)
                body = np.ones(len(closed), bool)
                body[ends - 1] = False
                closed[body] = ids
                binary = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends] * kind.itemsize), pa.py_buffer(closed)]).cast(pa.binary())
                rest, windows = tokens % capacity, tokens // capacity
                order = np.argsort(rest, kind="stable")
                first = np.r_[0, np.flatnonzero(np.diff(rest[order])) + 1]
                runs = np.diff(np.r_[first, len(order)])
                number = np.empty(len(order), np.int64)
                number[order] = np.arange(len(order)) - np.repeat(first, runs) + seen[rest[order]]
                seen[rest[order][first]] += runs
                before = full + np.cumsum(windows) - windows
                full += int(windows.sum())
                yield pa.RecordBatch.from_arrays([b.column(0), binary, *map(pa.array, (tokens, rest, np.full(len(ends), part), number, before))], names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return packed.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, *, text: str = "text", capacity: int = 4096, end_id: int = 2, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Per piece: ``row`` (the kept columns), start, length, crc, doc_tokens, sequence_id, offset, and ``ids`` if asked for."""
    spark = docs.sparkSession
    items = written(tokenised(docs, path, text=text, capacity=capacity, end_id=end_id, keep=keep), "window-items")
    each = items.groupBy("part", "rest").agg(F.count("*").alias("k"), F.sum(F.floor(F.col("doc_tokens") / capacity)).alias("f"))
    each = written(each, "window-counts")  # tasks x lengths
    counts = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("rest").agg(F.sum("k").alias("k"), F.sum("f").alias("f")).collect():  # a row a length
        counts[capacity] += r.f
        if r.rest:
            counts[r.rest] += r.k
    plan = spark.sparkContext.broadcast(Plan(counts, capacity))
    of_length = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Sums over the tasks before: per length within the length, of whole windows by salted blocks of tasks.
    per_part = each.groupBy("part").agg(F.sum("f").alias("f")).withColumn("block", F.floor(F.col("part") / 1000))
    per_block = per_part.groupBy("block").agg(F.sum("f").alias("f")).withColumn("base", F.coalesce(F.sum("f").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a thousand tasks
    in_block = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.join(per_block.select("block", "base"), "block").select("part", (F.coalesce(F.sum("f").over(in_block), F.lit(0)) + F.col("base")).alias("full0"))
    sums = each.select("part", "rest", F.coalesce(F.sum("k").over(of_length), F.lit(0)).alias("n0")).join(before, "part")
    df = items.join(sums, ["part", "rest"]).select("row", "ids", "doc_tokens", "rest", (F.col("n") + F.col("n0")).alias("n"), (F.col("full") + F.col("full0")).alias("full"))
    fields = "start bigint, length bigint, crc bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids array<int>" if with_ids else "")
    schema = T.StructType([df.schema["row"], *T._parse_datatype_string(fields).fields])

    def run(batches):
        p = plan.value
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                tokens, rest, n, full = (b.column(i).to_numpy() for i in range(2, 6))
                lone = np.maximum(rest, 1)  # documents of whole windows only have no item: what is looked up for them isn't used
                sequence, offset, position = p.place(lone, np.where(rest > 0, n, 0))
                owner, out, ids_out = [], [], []
                for i, raw in enumerate(b.column(1)):
                    stored = raw.as_buffer()
                    ids = np.frombuffer(stored, f"<u{len(stored) // int(tokens[i])}").astype("<u4")
                    k = int(tokens[i]) // capacity
                    pieces = []
                    if k:
                        alone = p.place(np.full(k, capacity), full[i] + np.arange(k))[0]
                        pieces = [(j * capacity, capacity, int(s), 0) for j, s in enumerate(alone)]
                    if rest[i]:
                        r = int(rest[i])
                        mine = [(0, r, int(sequence[i]), int(offset[i]))] if sequence[i] >= 0 else p.cut(int(position[i]), r)
                        pieces += [(k * capacity + a, m, s, o) for a, m, s, o in mine]
                    for a, m, s, o in pieces:
                        owner.append(i)
                        out.append((a, m, zlib.crc32(ids[a : a + m].tobytes()), int(tokens[i]), s, o))
                        if with_ids:
                            ids_out.append(ids[a : a + m].astype(np.int32))
                columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6
                more = [pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), *columns, *more], names=schema.names)

    return df.mapInArrow(run, schema)


def op11_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], with_ids=False)
    return out.select("row.*", "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
