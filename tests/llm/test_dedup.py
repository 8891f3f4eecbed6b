"""SimHash near-duplicates, suffix sorting and repeated strings against brute force."""

import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import simhash, substring_dedup, suffix
from tideline.llm.common import written
from tideline.llm.components import components

from .helpers import LONG, fingerprint, groups, prose, removed, write_tables


def corpus():
    base = [prose(s, 150) for s in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    rng = random.Random(5)
    for i, t in enumerate(base[:6]):
        words = t.split()
        for j in range(4):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            docs.append((100 + 10 * i + j, " ".join(copy)))
    docs += [(300, base[0]), (301, None), (302, ""), (303, " \t\n"), (304, "one two"), (305, "one two"), (306, LONG), (307, "Öl ÖL é"), (None, base[1]), (308, LONG), (308, LONG)]
    return docs


def test_simhash_query(spark, tmp_path):
    docs = corpus()
    d = write_tables(spark, tmp_path / "t", docs)
    out = simhash.op6_simhash(spark, d).collect()
    assert len(out) == len(docs)
    prints = sorted({fingerprint(t) for _, t in docs})
    least = {f: min([i for i, t in docs if i is not None and fingerprint(t) == f], default=None) for f in prints}
    root = groups(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    name = {}
    for f in prints:
        known = [least[g] for g in prints if root[g] == root[f] and least[g] is not None]
        name[f"{f:016x}"] = min(known) if known else None
    assert sorted(str((r.doc_id, r.fingerprint)) for r in out) == sorted(str((i, f"{fingerprint(t):016x}")) for i, t in docs)
    assert all(r.component_id == name[r.fingerprint] for r in out)


def test_links_span_all_close_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(8)} | set(base)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.root for r in components(edges).collect()}
    want = groups(sorted(signed), lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert all(got.get(f, f) == want[f] for f in signed)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 500), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(200)) and 500 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_keep_one_table_and_stars_take_no_round(spark, monkeypatch):
    """Each round's edges go when the next are written, and edges that are stars already are written once: the driver runs no round for them."""
    made = []

    def counted(df, name):
        made.append(written(df, name))
        return made[-1]

    monkeypatch.setattr("tideline.llm.components.written", counted)
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"))
    assert {r.root for r in chain.collect()} == {0} and [os.path.exists(df.written_at.removeprefix("file:")) for df in made] == [False] * (len(made) - 1) + [True]
    made.clear()
    again = components(chain.toDF("a", "b").unionByName(spark.createDataFrame([(100, 101), (100, 102)], "a long, b long")))
    assert {(r.node, r.root) for r in again.collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (102, 100)} and len(made) == 1


def test_links_of_many_tables_in_one_short_plan(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(63) for _ in range(30)]
    fps = sorted({(t, b ^ (1 << rng.randrange(63))) for t in (0, 1, 7) for b in base for _ in range(3)})
    edges = simhash.links(spark.createDataFrame(fps, "t int, fp long"), direct=True)
    assert len(edges._jdf.queryExecution().executedPlan().toString()) < 12_000
    rows = {tuple(r) for r in edges.collect()}
    assert all((a ^ b).bit_count() <= 2 and {(t, a), (t, b)} <= set(fps) for t, a, b in rows)
    for t in (0, 1, 7):
        own = [f for u, f in fps if u == t]
        got = {r.node: r.root for r in components(spark.createDataFrame([(a, b) for u, a, b in rows if u == t], "a long, b long")).collect()}
        want = groups(own, lambda a, b: (a ^ b).bit_count() <= 2)
        assert all(got.get(f, f) == want[f] for f in own)


def test_similar_groups(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, row int")
    got = simhash.similar_groups(df, keep=["doc_id", "text", "row"]).select("row.doc_id", "row.text", "group").collect()
    sets = {t: set(simhash.shingles(t, 5).tolist()) for _, t in docs}
    texts = sorted(sets, key=str)
    want = groups(list(range(len(texts))), lambda a, b: len(sets[texts[a]] & sets[texts[b]]) >= 0.8 * len(sets[texts[a]] | sets[texts[b]]))
    by = {}
    for r in got:
        by.setdefault(r.group, set()).add(want[texts.index(r.text)])
    # null, empty and blank texts are one class for the shingles too
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set(want.values()))
    one = simhash.one_of_each(df).collect()
    assert len(one) == len(set(want.values())) and {r.doc_id for r in one if r.text == docs[0][1]} == {0}
    assert df.columns == ["doc_id", "text", "row"] == simhash.one_of_each(df).columns
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_near_copies_are_linked_by_fingerprints(spark):
    """The pairs that are checked first come from fingerprints and the grid: a copy with one word changed, hubs of linked fingerprints."""
    base = [prose(7000 + i, 300, 4000).split() for i in range(20)]
    copies = [[*w[:150], "changed", *w[151:]] for w in base]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(base + copies)], "k long, raw string")
    texts = simhash._marked(df, 5, 2)
    uid = {r.uid: r.k for r in texts.collect()}
    fps = {r.k: r.fps for r in texts.collect()}
    assert all(fps[i] == [simhash.fingerprint(" ".join(w), 1, seed) for seed in range(2)] for i, w in enumerate(base + copies))
    pairs = [tuple(sorted((uid[r.a], uid[r.b]))) for r in simhash._linked(texts, 2, 2).collect()]
    close = {(i, j) for i in fps for j in fps if i < j and any(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in zip(fps[i], fps[j]))}
    assert len(pairs) == len(set(pairs)) and set(pairs) == close and len(close & {(i, i + 20) for i in range(20)}) >= 15


def test_direct_links():
    rng = random.Random(4)
    fps = {0}
    while len(fps) < 400:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    nodes, to = simhash.forest(np.array(sorted(fps), np.int64), 2, direct=True)
    assert len(nodes) == 399 and all((a ^ b).bit_count() <= 2 for a, b in zip(nodes.tolist(), to.tolist()))
    assert any((a ^ b).bit_count() > 2 for a, b in zip(*(x.tolist() for x in simhash.forest(np.array(sorted(fps), np.int64), 2))))


def grouped_as_brute_force(spark, texts):
    """Whether the groups are those of all pairs, and how many pairs are similar by brute force."""
    got = {r.doc_id: r.group for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), keep=["doc_id"]).select("row.doc_id", "group").collect()}
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = groups(list(range(len(texts))), near)
    pairs = {}
    for i, g in got.items():
        pairs.setdefault(g, set()).add(want[i])
    return all(len(v) == 1 for v in pairs.values()) and len(pairs) == len(set(want.values())), len(texts) - len(set(want.values()))


def test_similar_groups_of_one_word_set(spark):
    rng = random.Random(8)
    words = list(dict.fromkeys(prose(900, 200).split()))[:100]
    texts = []
    for _ in range(150):
        rng.shuffle(words)
        swapped = list(words)
        swapped[97:] = reversed(swapped[97:])
        texts += [" ".join(words), " ".join(swapped)]
    assert grouped_as_brute_force(spark, texts) == (True, 150)


def test_similar_groups_of_cut_and_longer_copies(spark):
    texts = []
    for i in range(60):
        words = prose(1000 + i, 60 + 7 * i, 4000).split()
        share = (0.81, 0.85, 0.9, 0.95)[i % 4]
        texts += [" ".join(words), " ".join(words[: int(len(words) * share) + 2]) if i % 8 < 4 else " ".join(words + prose(2000 + i, int(len(words) * (1 / share - 1)) - 1, 4000).split())]
    assert grouped_as_brute_force(spark, texts) == (True, 60)


def test_similar_groups_of_many_copies_with_edits_of_their_own(spark):
    """Groups of 50 copies at 0.7 to 0.95, of which most pairs are not similar and some are similar to few others only."""
    rng, texts = random.Random(11), []
    for g in range(3):
        words = prose(4000 + g, 120 if g else 700, 4000).split()
        for i in range(50):
            copy = list(words)
            for at in rng.sample(range(len(words)), len(words) // 120 * (1 + i % 4)):
                copy[at] = f"x{g}y{i % 40}z{at}"
            texts.append(" ".join(copy))
    same, merged = grouped_as_brute_force(spark, texts)
    assert same and merged > 60


def test_similar_groups_behind_a_common_passage(spark):
    passage = prose(3000, 120)
    texts = [passage + " " + prose(3100 + i, 8 + i % 90, 4000) for i in range(200)] + [prose(3100 + i, 60, 4000) for i in range(40)]
    same, merged = grouped_as_brute_force(spark, texts)
    assert same and merged > 20


def test_empty_tables(spark, tmp_path):
    d = write_tables(spark, tmp_path / "t", [])
    assert simhash.op6_simhash(spark, d).count() == 0 and substring_dedup.op2_suffix_dedup(spark, d).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), max_size=5), st.sampled_from([1, 2, 3, 7, 20]), st.sampled_from([1 << 25, 64, 16]))
def test_repeats(strings, depth, memory):
    counts = {}
    for s in strings:
        for i in range(len(s) - depth + 1):
            counts[s[i : i + depth]] = counts.get(s[i : i + depth], 0) + 1
    for s, m in zip(strings, suffix.repeats(strings, depth, memory)):
        assert m.tolist() == [i + depth <= len(s) and counts[s[i : i + depth]] > 1 for i in range(len(s))]


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=90).map(lambda b: bytes(x % 4 for x in b)), st.sampled_from([1 << 25, 32]))
def test_suffixes_are_sorted(raw, memory):
    text = np.array([x + 1 for x in raw] + [0], np.uint16)
    assert suffix.Induced(text, 200, memory).suffixes().tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_repeated_strings_query(spark, tmp_path):
    passage, other = prose(77, 90), prose(78, 140)
    period = "la " * 300
    docs = [(i, prose(200 + i, 120 + 10 * i)) for i in range(10)]
    docs += [(20, prose(1, 50) + passage + prose(2, 60)), (21, passage + prose(3, 80)), (22, prose(4, 30) + passage), (23, other + " x " + other), (24, period), (25, prose(6, 40) + period), (26, "é" * 500), (27, None), (28, ""), (29, passage[:399]), (30, other), (31, other), (32, LONG), (32, LONG), (None, other[3:])]
    d = write_tables(spark, tmp_path / "t", docs)
    out = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.op2_suffix_dedup(spark, d).collect()]
    want = [(i, *x) for (i, _), x in zip(docs, removed([t for _, t in docs], 400))]
    assert sorted(map(str, out)) == sorted(map(str, want))
    assert sum(x[2] for x in want) > 5000


def test_cut_texts(spark):
    passage = prose(77, 90)
    df = spark.createDataFrame([(1, "start " + passage + " end", 5), (2, passage + "x", 6), (3, None, 7), (4, "short", 8)], "doc_id long, text string, spans int")
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(df, length=300).collect()}
    assert got == {1: "start  end", 2: "x", 3: None, 4: "short"}
    with pytest.raises(ValueError):
        substring_dedup.repeated_spans(df, length=150)
