"""Readers: index universe, wide prices, announcement files, given returns, and what the report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quality import Invalid, nan_to_null
from ..functions.strings import strip
from ..operators.events import ANNOUNCEMENT_FIELDS
from .sinks import current

PRICE_FIELDS = {"open", "high", "low", "close", "adj close", "volume"}


def universe(lines: DataFrame, *, suffix: str = ".NS", min_rows: int = 450, order: str | None = None) -> DataFrame:
    """(ticker, sector) of an index list with ``Symbol`` and ``Industry``.

    Rows with a null are dropped; of equal symbols the first by ``order`` stays (before trimming); too few rows are an error.
    """
    if lacking := {"Symbol", "Industry"} - set(lines.columns):
        raise Invalid(f"universe lacks {', '.join(sorted(lacking))}")
    df = lines.dropna(subset=["Symbol", "Industry"])
    first = Window.partitionBy("Symbol").orderBy(F.col(order) if order else F.monotonically_increasing_id())
    df = df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1")
    df = df.select(F.concat(strip("Symbol"), F.lit(suffix)).alias("ticker"), strip("Industry").alias("sector"))
    n = df.count()
    if n < min_rows:
        raise Invalid(f"universe has {n} rows, {min_rows} are needed")
    return df


def read_universe(spark: SparkSession, path: str, **options) -> DataFrame:
    """The CSV with its line order: one file, read in order."""
    lines = spark.read.csv(path, header=True).withColumn("_line", F.monotonically_increasing_id())
    return universe(lines, order="_line", **options)


def long_prices(wide: DataFrame, *, date: str = "Date", sep: str = "|", ticker: str | None = None) -> DataFrame:
    """(ticker, trade_date, close) from wide columns ``<ticker>|<field>`` or ``<field>|<ticker>``, or a flat ``Close`` of one ``ticker``.

    A table that has the long columns passes through.
    """
    if {"ticker", "trade_date", "close"} <= set(wide.columns):
        return wide.select("ticker", "trade_date", nan_to_null(F.col("close").cast("double")).alias("close"))
    flat = [c for c in wide.columns if c.strip().lower() == "close"]
    if flat and ticker:
        return wide.select(F.lit(ticker).alias("ticker"), F.to_date(date).alias("trade_date"), nan_to_null(F.col(flat[0]).cast("double")).alias("close"))
    names = {}
    for c in wide.columns:
        parts = [p.strip() for p in c.split(sep)]
        if len(parts) != 2:
            continue
        if parts[1].lower() in PRICE_FIELDS and parts[1].lower() == "close":
            names[c] = parts[0]
        elif parts[0].lower() == "close":
            names[c] = parts[1]
    if not names:
        raise Invalid("no closing prices among the columns")
    df = wide.select(F.to_date(date).alias("trade_date"), *[F.col(f"`{c}`").cast("double").alias(t) for c, t in names.items()])
    long = df.unpivot("trade_date", list(names.values()), "ticker", "close")
    return long.select("ticker", "trade_date", nan_to_null(F.col("close")).alias("close")).where(F.col("close").isNotNull())


def announcement_rows(payloads: DataFrame, column: str = "value") -> DataFrame:
    """The object rows of the ``Table`` array of JSON payloads, all fields as strings; rows that are no objects are skipped."""
    rows = F.from_json(F.get_json_object(column, "$.Table"), "array<string>")
    schema = T.StructType([T.StructField(f, T.StringType()) for f in ANNOUNCEMENT_FIELDS])
    each = payloads.select(F.explode(rows).alias("r")).where(strip("r").startswith("{"))
    return each.select(F.from_json("r", schema).alias("x")).select("x.*")


def read_announcements(spark: SparkSession, path: str) -> DataFrame:
    return announcement_rows(spark.read.text(path, wholetext=True))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``: of a table in versions the one that its pointer names."""
    return spark.read.parquet(current(spark, path))


def read_report(spark: SparkSession, alpha_path: str, metadata_path: str, ic_path: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None, str | None]:
    """(alpha table, metadata, rank-IC history or None, message): a missing or odd rank-IC file is a message, not a failure."""
    alpha, meta = read_table(spark, alpha_path), spark.read.json(current(spark, metadata_path), multiLine=True)
    if ic_path is None:
        return alpha, meta, None, "no rank-IC history"
    try:
        ics = read_table(spark, ic_path)
    except Exception as error:  # noqa: BLE001  whatever the reader raises is the message
        return alpha, meta, None, f"no rank-IC history: {type(error).__name__}"
    if lacking := {"as_of_date", "horizon_days", "rank_ic"} - set(ics.columns):
        return alpha, meta, None, f"rank-IC history lacks {', '.join(sorted(lacking))}"
    return alpha, meta, ics, None
