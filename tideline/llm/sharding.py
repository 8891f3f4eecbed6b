"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in the order of a hash of (id, size, crc32), a keyed Feistel network permutes these numbers, and
the permuted number p gives ``shard = p mod shards`` and ``slot = p div shards``. So shard sizes differ by one row at most
(law ``rows``), slots are gapless from 0, and anybody who knows a row's number, n and the seed can compute its place.

Defined cases: a null text has size 1 and the crc32 of no bytes (0); a null id is numbered like an empty one; rows that agree
in id, size and crc32 are interchangeable, they get different numbers in any order; an empty table gives an empty result;
extra columns pass through whatever their names.

Scale: DataFrame functions only. Numbering takes one aggregate (rows per hash bucket) and one shuffle of the kept columns by
hash bucket; buckets are even whatever the ids or sources are, and the offsets are ``BUCKETS`` rows at most, which bounds the
broadcast. The Feistel domain has at most sqrt(n) + 1 numbers too many, so hardly any row walks at all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unpack

BUCKETS = 1 << 14
ROUNDS = 6
#: Steps that a number may walk; the chance of a longer walk is under n**-32, and it raises an error rather than misplace a row.
WALK = 64


def number_rows(df: DataFrame, key: F.Column, order: list[F.Column]) -> DataFrame:
    """``df`` with ``number``: 0..n-1 by the hash ``key``, ties by ``order``."""
    bucket = F.shiftrightunsigned(key, 64 - int(math.log2(BUCKETS)))
    sizes = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(key, *order))
    return df.withColumn("bucket", bucket).withColumn("inside", inside).join(F.broadcast(offsets), "bucket").withColumn("number", F.col("offset") + F.col("inside") - 1).drop("bucket", "inside", "offset")


def feistel(x: F.Column, n: int, seed: int) -> F.Column:
    """One pass of the network over 0..a*b-1, where a = ceil(sqrt(n)) and b = ceil(n/a)."""
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    left, right = F.pmod(x, F.lit(a)), F.floor(x / F.lit(a))
    for r in range(ROUNDS):
        mix = lambda v, m, r=r: F.pmod(F.xxhash64(F.concat_ws(":", F.lit(seed), F.lit(r), v)), F.lit(m).cast("bigint"))
        if r % 2 == 0:
            left = F.pmod(left + mix(right, a), F.lit(a))
        else:
            right = F.pmod(right + mix(left, b), F.lit(b))
    return (right * a + left).cast("bigint")


def permuted(number: F.Column, n: int, seed: int) -> F.Column:
    """The permutation of 0..n-1: walk the cycle until the number is under n."""
    first = feistel(number, n, seed)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, n, seed)))
    done = F.when(first < n, first).otherwise(walk)
    return F.when(done < n, done).otherwise(F.raise_error(F.lit("a Feistel cycle is longer than WALK")).cast("bigint"))


def shard(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shards: int = 16, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Per row: ``row`` (the kept columns), size, text_crc32, number, place (the permuted number), shard, slot."""
    keep = docs.columns if keep is None else keep
    raw = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    df = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"), (F.octet_length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    df = df.withColumn("key", F.xxhash64("id", "size", "text_crc32"))
    n = docs.count()
    if n == 0:
        zero = F.lit(None).cast("bigint")
        return df.select("row", "size", "text_crc32", zero.alias("number"), zero.alias("place"), zero.cast("int").alias("shard"), zero.alias("slot"))
    df = number_rows(df, F.col("key"), [F.col("id"), F.col("size"), F.col("text_crc32")]).drop("key", "id")
    df = df.withColumn("place", permuted(F.col("number"), n, seed))
    return df.select("row", "size", "text_crc32", "number", "place", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("bigint").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in the order of their slots within each file."""
    flat = unpack(sharded, F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    flat.repartition("_shard", F.floor(F.col("_slot") / 1_000_000)).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return unpack(out, F.col("size"), F.col("text_crc32"), F.lit("rows").alias("law"), F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"))
