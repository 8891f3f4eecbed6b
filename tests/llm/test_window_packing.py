"""Window packing: ids against the library, placement against the rules, least squares against its optimality conditions."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import window_packing

from .helpers import LONG, prose, write_tables

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Σας ΟΔΟΣ <|endoftext|> x<|startoftext|>y",
    "a\x1cb\x85c\xa0d​e f é é ́x İI ß ẞ",
    "᠎ a ᠎b 'S 'LL don't I'M 123 4５６ ²³½",
    "   ",
    "\x00 a\x0bb\x1f c",
    "好" * 300 + " " + "x" * 1500,
    "Ǆ ǅ ﬁ Å _a_ a_b ---- … “quoted”",
    "",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    path = public_tokenizers.path(name)
    full = Tokenizer.from_file(path)
    texts = [*ODD, *(prose(i, 200) for i in range(5)), " ".join(ODD), "Łódź naïve Пример ТЕКСТА ΑΒΓ"]
    ids, sizes = window_packing.encoder(path)[0](pa.array(texts))
    ends = np.cumsum(sizes)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(3)
    lengths = np.arange(1, 25)
    counts = rng.integers(0, 40, len(lengths))
    present = lengths[counts > 0]
    rows = window_packing.combinations(present, counts[counts > 0], 24, per_length=99)
    every = {tuple(sorted(c)) for k in (2, 3) for c in itertools.combinations_with_replacement(present.tolist(), k) if sum(c) == 24}
    assert {tuple(m for m in r if m) for r in rows.tolist()} == every
    target = np.zeros(25)
    target[lengths] = counts
    x = window_packing.nnls(rows, target, steps=20_000, tolerance=1e-12)
    made = np.zeros(25)
    for r, v in zip(rows, x):
        for m in r[r > 0]:
            made[m] += v
    slope = np.array([(made - target)[r[r > 0]].sum() for r in rows])
    assert (x >= 0).all() and slope.min() > -1e-4 and np.abs(slope[x > 1e-6]).max() < 1e-4


@pytest.mark.parametrize("seed,capacity", [(0, 64), (1, 64), (2, 128), (3, 7), (4, 1)])
def test_plan_places_each_number_once(seed, capacity):
    rng = np.random.default_rng(seed)
    counts = np.r_[0, rng.integers(0, 60, capacity)]
    counts[1 + capacity // 3] += 500  # a length that a third of all have
    plan = window_packing.Plan(counts.copy(), capacity)
    length = np.repeat(np.arange(capacity + 1), counts)
    number = np.concatenate([np.arange(c) for c in counts])
    order = rng.permutation(len(length))
    sequence, offset, position = plan.place(length[order], number[order])
    held = defaultdict(list)
    for n, s, o, p in zip(length[order].tolist(), sequence.tolist(), offset.tolist(), position.tolist()):
        for a, m, q, at in [(0, n, s, o)] if s >= 0 else plan.cut(p, n):
            held[q].append((at, m))
    for parts in held.values():
        at = 0
        for start, m in sorted(parts):
            assert start == at
            at += m
        assert at == capacity or at & (at - 1) == 0
    assert sum(m for parts in held.values() for _, m in parts) == int((length).sum())
    assert sum(sum(m for _, m in parts) != capacity for parts in held.values()) <= capacity.bit_length()


def test_whole_query(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " ", LONG, prose(1, 20_000), *ODD, *["same text again"] * 400, *(prose(i, rng.randrange(1, 900)) for i in range(400))]
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts, 1)]
    d = write_tables(spark, tmp_path / "t", docs)
    out = window_packing.op11_window_packing(spark, d)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = Tokenizer.from_file(PATH)
    ids = lambda t: [*full.encode(t or "", add_special_tokens=False).ids, 2]
    rows = out.collect()
    pieces, held = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    want = {i: ids(t) for i, t in docs if i is not None}
    for i, x in want.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(x)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(x[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(x)
    assert sum(r.length for r in pieces[None]) == sum(len(ids(t)) for i, t in docs if i is None)
    short = 0
    for parts in held.values():
        at = 0
        for start, m in sorted(parts):
            assert start == at
            at += m
        assert at == 4096 or at & (at - 1) == 0
        short += at < 4096
    assert short <= 12
    # general form: any columns, real ids, another capacity
    clash = spark.createDataFrame([(1, "a b", 5, 6), (2, None, 7, 8)], "start long, text string, ids long, sequence_id long")
    got = {r.row.start: r for r in window_packing.pack(clash, PATH, capacity=64).collect()}
    assert got[2].ids == [2] and got[1].ids == ids("a b") and got[1].row.sequence_id == 6
    assert window_packing.pack(clash.limit(0), PATH).count() == 0
    # most documents stay whole
    whole = sum(len(p) == 1 for i, p in pieces.items() if i is not None)
    assert whole >= 0.9 * len(want)
