"""Small fixtures and brute-force versions for the corpus operators."""

import hashlib
import random
import re

import xxhash

LONG = "word" * 3000


def write_tables(spark, path, docs, **tables):
    """A folder of tables as the queries read them; ``docs`` are (doc_id, text)."""
    rows = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    """id -> smallest id reachable."""
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


def removed(texts, length):
    """Per text: (n_bytes, n_removed, n_spans, digest of what is kept)."""
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raws:
        spans = []
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + r[at:a], b
        out.append((len(r), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + r[at:]).hexdigest()))
    return out
