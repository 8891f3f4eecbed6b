"""The pipeline on planted cases, each stage against its own input."""

import random

import corpus_pipeline

from .helpers import LONG, prose, write_tables


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(300):
        toxic = int(i % 5 == 0)
        words = prose(i, 80).split()
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), "grumbo" + rng.choice(["a", "ing", "ed"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    item = prose(5000, 30)
    docs += [(1000, docs[1][1]), (1001, docs[2][1].replace(docs[2][1].split()[40], "other", 1)), (1002, prose(5001, 30) + " " + item), (1003, "write to someone@example.com " + prose(5002, 30)), (1004, None), (1005, ""), (1006, LONG), (None, prose(5003, 30)), (1007, prose(5004, 40)), (1007, prose(5004, 40))]
    d = write_tables(spark, tmp_path / "t", docs, labels=(labels, "doc_id long, quality int, toxic int"), benchmark=([(1, item)], "item_id long, text string"))
    df = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = df
        stage(spark, df, d).write.parquet(f"{d}/out{k}")
        df = spark.read.parquet(f"{d}/out{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == before.columns
        seen[name] = df.collect()
    toxic = {i for i, _, t in labels if t}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert len(toxic & kept) <= 3 and len({i for i, _ in docs} - kept - toxic) <= 3
    ids = [r.doc_id for r in seen["near_dedup"]]
    assert 1000 not in ids and 1001 not in ids and ids.count(1007) == 1 and ids.count(1004) + ids.count(1005) == 1
    assert kept - set(ids) <= {1000, 1001, 1004, 1005}
    assert set(ids) - {r.doc_id for r in seen["decontaminate"]} == {1002}
    texts = {r.doc_id: r for r in seen["pii"]}
    assert texts[1003].text.startswith("write to [EMAIL] ") and texts[1003].n_chars == len(texts[1003].text) and len(texts) == len(ids) - 1
    assert {r.doc_id for r in seen["packing"]} == set(texts)
    final = corpus_pipeline.run(spark, d)
    assert sorted(map(str, final.drop("sequence_id", "offset").collect())) == sorted(str(r) for r in df.drop("sequence_id", "offset").collect())


def test_empty(spark, tmp_path):
    d = write_tables(spark, tmp_path / "t", [], labels=([], "doc_id long, quality int, toxic int"), benchmark=([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0 and corpus_pipeline.ORACLE_SQL is None
