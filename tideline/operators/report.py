"""Report views: rank-IC history, histograms, headline figures, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of a rank-IC history.
IC_COLUMNS = {"as_of_date", "horizon_days", "rank_ic"}


def ic_history(ics: DataFrame, horizons: list[int]) -> DataFrame:
    """Rows by date, a column for each horizon, means of the coefficients."""
    if lacking := IC_COLUMNS - set(ics.columns):
        raise ValueError(f"rank-IC history lacks {', '.join(sorted(lacking))}")
    return ics.groupBy("as_of_date").pivot("horizon_days", list(horizons)).agg(F.avg("rank_ic"))


def histogram(df: DataFrame, value: F.Column, *, by: list[str] | None = None, bins: int = 40) -> DataFrame:
    """(by..., bin, n): equal bins from the least to the largest value, the last one closed; one value only widens by 0.5 either way."""
    by = by or []
    v = df.select(*by, value.alias("_x")).where(F.col("_x").isNotNull())
    ends = v.groupBy(*by).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(*by, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    df = v.join(ends, by) if by else v.crossJoin(F.broadcast(ends))  # one row
    place = F.least(F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))


def headline(df: DataFrame, value: F.Column, by: list[str] | None = None) -> DataFrame:
    """(by..., n_rows, mean, population_sd)."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("population_sd"))


def raw_against_neutral(alpha: DataFrame) -> DataFrame:
    return alpha.select("ticker", "raw_score", "alpha_z")


def alpha_view(alpha: DataFrame) -> DataFrame:
    """The seven columns of the report table, sorted by ticker."""
    return alpha.select("ticker", "sector", "raw_score", "alpha_z", "log_market_cap", "momentum_12m", "price_to_book").orderBy("ticker")
