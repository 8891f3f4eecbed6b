"""What the corpus operators share: reading tables, cutting lineage, mapping texts in Arrow batches."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a Python task holds at once; the text of a batch is bounded by this many texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where it may be unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = jdir.get() if jdir.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: a short lineage that outlives executors.

    The table goes with ``let_go`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_at = path
    return back


def let_go(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more, and let the driver find shuffles that nothing uses."""
    for df in tables:
        place, fs = _place(spark, df.written_at)
        fs.delete(place, True)
    spark.sparkContext._jvm.System.gc()  # shuffle files go once the collector finds them unused; a small heap's young ones may wait


def crc32_mod(id_col: str, mod: int) -> F.Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def map_texts(
    docs: DataFrame,
    inputs: list[F.Column],
    keep: list[str],
    fields: T.StructType,
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """One output row per input row: the column ``row`` (a struct of the columns ``keep``), then ``fields``.

    ``make`` runs once a task and returns a function from the input columns (Python lists) to one list per field.
    The original columns travel in a struct, so that their names can't clash with the fields.
    """
    packed = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([packed.schema["row"], *fields.fields])
    types = [f.type for f in to_arrow_schema(fields)]
    names = schema.names
    n = len(inputs)

    def run(batches):
        fn = make()
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(at, BATCH_ROWS)
                out = fn(*[b.column(i + 1).to_pylist() for i in range(n)])
                yield pa.RecordBatch.from_arrays([b.column(0), *[x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(out, types)]], names=names)

    return packed.mapInArrow(run, schema)


def unpack(df: DataFrame, *fields: F.Column) -> DataFrame:
    """The kept columns at the top again, then ``fields``."""
    return df.select("row.*", *fields)


def labelled_texts(docs: DataFrame, labels: DataFrame, *, id_col: str, text: str, label: str, learn: Column | None, max_rows: tuple[int, int], max_bytes: int) -> DataFrame:
    """(name, text, label) to learn from: ``max_rows`` of label 0 and 1 at most, ``max_bytes`` of text at most, those of least hash of the id.

    An id with two labels counts as 1; of several texts of one id the one of least hash is taken. Only ids and sizes reach the
    driver, as many as there are rows at most.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    known = known if learn is None else known.where(learn)
    known = known.groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
    some = known.where("_label = 0").orderBy(F.xxhash64(id_col), id_col).limit(max_rows[0])
    some = some.unionByName(known.where("_label = 1").orderBy(F.xxhash64(id_col), id_col).limit(max_rows[1]))
    held = docs.select(docs[id_col], docs[text].cast("string").alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    sizes = held.join(F.broadcast(some), id_col).groupBy(id_col, "_label").agg(F.min(F.struct("_hash", F.coalesce(F.octet_length("_text"), F.lit(0)).alias("size"))).alias("x"))
    picked, left = [], max_bytes
    for r in sorted(sizes.select(id_col, "_label", "x._hash", "x.size", F.xxhash64(id_col).alias("_at")).collect(), key=lambda r: (r._at, str(r[0]))):
        if r.size <= left:
            left -= r.size
            picked.append((r[0], r._label, r._hash))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(picked, T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("_label", T.IntegerType()), T.StructField("_least", T.LongType())]))
    one = held.join(F.broadcast(chosen), id_col).where("_hash = _least").groupBy(id_col, "_label").agg(F.min("_text").alias("_text"))
    return one.select(F.col(id_col).cast("string").alias("name"), F.col("_text").alias("text"), F.col("_label").alias("label"))


def fitted(sample: DataFrame, train: Callable[[list[str | None], list[int]], object]) -> object:
    """What ``train`` makes of the bounded sample (name, text, label), in one task: a lost executor repeats it, the driver holds no texts."""

    def run(batches):
        rows = sorted((r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))), key=lambda r: (r[0], r[1] or ""))
        model = train([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(run, "model binary").first()
    return train([], []) if made is None else pickle.loads(made.model)  # without rows there is no task
