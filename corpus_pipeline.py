"""A corpus pipeline over ``documents``: five stages, each one written as Parquet and read again by the next.

toxicity     documents that the classifier scores at 0.7 or more go
near_dedup   one document of each group of near copies stays (five-word shingles, similarity 0.8 or more)
decontaminate  documents that hold a window of ten words of a benchmark item go
pii          personal data and terms that reveal it are masked in the text; n_chars follows the new text
packing      the documents are tokenised and packed into sequences of 1024 tokens

All stages but the last return the columns of ``documents``. Nulls, empty and very long texts, repeated rows and empty tables are
handled as the operators' modules say; a document with a null text is kept with a null text until packing, where it is one piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, packing, pii, simhash, toxicity
from tideline.llm.common import crc32_mod, table, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: SQL can't express the trained classifier.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, learn=crc32_mod("doc_id", 3) != 1)
    return toxicity.scored(docs, model).where("score < 0.7").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated").select("row.*")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenised(docs, TOKENIZER, with_ids=False, keep=["doc_id"])
    return packing.pack(pieces).select("row.*", "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("pii", mask_pii), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
