"""Writers that leave the old or the new output, never half of one."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str:
    """The folder of the version that the pointer at ``path`` names; ``path`` itself where there is no pointer."""
    pointer, fs = _place(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        return path
    stream = fs.open(pointer)
    try:
        return f"{path}/{spark._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Replace the pointer in one step: it names the old version or the new one at any time."""
    jvm = spark._jvm
    fresh, fs = _place(spark, f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    target, _ = _place(spark, f"{path}/{POINTER}")
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, target, how)


def commit(df: DataFrame, path: str, write: Callable[[DataFrame, str], None], keep: int = 2) -> str:
    """Write ``df`` as a new version below ``path`` and point to it; returns its folder.

    A driver that dies before the pointer moves leaves the old version in place, one that dies after it leaves the new one: there is no
    moment without a table. The last ``keep`` versions stay, as readers may still be at the one before; older ones go.
    """
    spark = df.sparkSession
    version = f"version-{time.time_ns():020d}-{uuid.uuid4().hex}"
    write(df, f"{path}/{version}")
    _point(spark, path, version)
    place, fs = _place(spark, path)
    versions = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith("version-") and s.getPath().getName() <= version)
    for old in versions[:-keep]:
        fs.delete(_place(spark, f"{path}/{old}")[0], True)
    return f"{path}/{version}"


def commit_table(df: DataFrame, path: str, keep: int = 2) -> str:
    """Parquet as a new version of the table at ``path``; ``tables.read_table`` reads it."""
    return commit(df, path, lambda d, to: d.write.parquet(to), keep)


def commit_metadata(df: DataFrame, path: str, keep: int = 2) -> str:
    return commit(df, path, lambda d, to: metadata_json(d).coalesce(1).write.text(to), keep)  # one row


def _swap(df: DataFrame, staged: str, path: str) -> None:
    """Rename through the file system of the path, so that it works on any store that Spark writes to.

    The old table is moved aside first and moved back if the new one can't take its place. A driver that dies between the two
    renames leaves the old table whole under ``<path>.old-...`` and the new one under ``<path>.new-...``.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(path)
    fs = old.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{path} can't be moved aside")
    try:
        if not fs.rename(new, old):
            raise OSError(f"{staged} can't be moved to {path}")
    except Exception:
        if had:
            fs.rename(aside, old)
        raise
    if had:
        fs.delete(aside, True)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet at ``path``, replaced when the new files are complete."""
    staged = f"{path}.new-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(staged)
    _swap(df, staged, path)


def metadata_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, fields in order of their names."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_metadata(df: DataFrame, path: str) -> None:
    staged = f"{path}.new-{uuid.uuid4().hex}"
    metadata_json(df).coalesce(1).write.mode("overwrite").text(staged)  # one row
    _swap(df, staged, path)
