"""Factor tables: momentum, market caps, missing gates, imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import missing, nan_to_null, together, violation
from ..functions.ranges import largest, medians

FACTORS = ["log_market_cap", "momentum_12m", "price_to_book"]


def momentum(prices: DataFrame, *, by: list[str] | None = None, min_history: int = 200, lookback: int = 253) -> DataFrame:
    """(by..., momentum_12m): latest close over the close ``lookback`` rows from the end (the first one if there are fewer), minus 1.

    NULL with under ``min_history`` closes or if either close is not positive. Cut the history before: only the last rows count.
    """
    by = by or ["ticker"]
    recent = Window.partitionBy(*by).orderBy(F.desc("trade_date"), F.desc("close"))
    # Of what stands behind the base row only the number is needed, which the aggregate counts.
    ranked = prices.where(~missing(F.col("close"))).withColumn("rn", F.row_number().over(recent))
    ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    ends = ranked.where((F.col("rn") == 1) | (F.col("rn") == F.least("n", F.lit(lookback))))
    found = ends.groupBy(*by).agg(F.max("n").alias("n"), F.max(F.when(F.col("rn") == 1, F.col("close"))).alias("latest"), F.max(F.when(F.col("rn") == F.least("n", F.lit(lookback)), F.col("close"))).alias("base"))
    good = (F.col("n") >= min_history) & (F.col("latest") > 0) & (F.col("base") > 0)
    return found.select(*by, F.when(good, F.col("latest") / F.col("base") - 1).alias("momentum_12m"))


def clean_cap(*sources: F.Column) -> F.Column:
    """The first source that is finite and positive, else NULL."""
    return F.coalesce(*[F.when((c > 0) & (c < float("inf")), c) for c in sources])


def missing_shares(table: DataFrame, columns: list[str], by: str = "as_of_date") -> DataFrame:
    """(by, column, n, n_missing, share)."""
    counts = table.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(missing(F.col(c)).cast("long")).alias(c) for c in columns])
    long = counts.unpivot([by, "n"], columns, "column", "n_missing")
    return long.select(by, "column", "n", "n_missing", (F.col("n_missing") / F.col("n")).alias("share"))


def missing_gate(shares: DataFrame, limit: float = 0.35, by: str = "as_of_date") -> DataFrame:
    """Violations: columns of which more than ``limit`` is missing."""
    return violation(shares, "too_many_missing", F.col("share") > limit, F.concat_ws(":", F.col(by).cast("string"), "column"), F.col("share"))


def _medians(df: DataFrame, by: list[str], columns: list[str], large: int, name: str) -> DataFrame:
    """(by..., columns): exact medians, by an aggregate that holds a group's values, or without one where a group has over ``large`` rows."""
    if largest(df, by) <= large:
        return df.groupBy(*by).agg(*[F.median(c).alias(c) for c in columns])
    return medians(df, by, columns, name)


def impute(table: DataFrame, columns: list[str], *, by: str = "as_of_date", sector: str = "sector", large: int = 1_000_000) -> DataFrame:
    """Missing values by the sector's median, then by the median over all, taken after the sectors were filled.

    ``imputed_<column>`` tells whether a value was missing. A column without any value in a cross-section stays NULL
    (see ``unfilled``). Medians are exact; where a group has over ``large`` rows they come from running sums over ranges of values.
    """
    df = table
    for c in columns:
        df = df.withColumn(f"imputed_{c}", missing(F.col(c))).withColumn(c, nan_to_null(F.col(c)))
    named = lambda found, prefix: found.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})
    first = named(_medians(df, [by, sector], columns, large, "sector-medians"), "_s_")
    df = df.join(first, [by, sector], "left")
    for c in columns:
        df = df.withColumn(c, F.coalesce(c, f"_s_{c}"))
    second = named(_medians(df, [by], columns, large, "all-medians"), "_g_")
    df = df.join(second, by, "left")
    for c in columns:
        df = df.withColumn(c, F.coalesce(c, f"_g_{c}"))
    return df.drop(*[f"_s_{c}" for c in columns], *[f"_g_{c}" for c in columns])


def unfilled(table: DataFrame, columns: list[str], by: str = "as_of_date") -> DataFrame:
    return together([violation(table, "no_value_to_impute", F.col(c).isNull(), F.col(by), c) for c in columns]).distinct()


def factor_table(universe: DataFrame, momentum_table: DataFrame, fundamentals: DataFrame, *, by: str = "as_of_date") -> DataFrame:
    """(as_of_date, ticker, market_cap, momentum_12m, price_to_book, sector), before the gate and the imputation.

    ``fundamentals(as_of_date, ticker, market_cap, market_cap_2, price_to_book)``: the second cap is the fallback.
    """
    df = universe.join(momentum_table, [by, "ticker"], "left").join(fundamentals, [by, "ticker"], "left")
    return df.select(by, "ticker", clean_cap(F.col("market_cap"), F.col("market_cap_2")).alias("market_cap"), "momentum_12m", F.when(F.abs("price_to_book") < float("inf"), F.col("price_to_book")).alias("price_to_book"), "sector")


def finished(imputed: DataFrame, *, by: str = "as_of_date") -> DataFrame:
    """The four columns of the cross-section: ``log_market_cap = ln(market_cap)``."""
    return imputed.select(by, "ticker", F.log("market_cap").alias("log_market_cap"), "momentum_12m", "price_to_book", "sector")


def frame_violations(factors: DataFrame, by: str = "as_of_date") -> DataFrame:
    """Required columns and one row a ticker."""
    lacking = [c for c in [by, "ticker", *FACTORS, "sector"] if c not in factors.columns]
    if lacking:
        one = factors.sparkSession.createDataFrame([(c,) for c in lacking], "column string")
        return violation(one, "missing_column", F.lit(True), F.col("column"))
    twice = factors.groupBy(by, "ticker").count().where("count > 1")
    return violation(twice, "duplicate_ticker", F.lit(True), F.concat_ws(":", F.col(by).cast("string"), "ticker"), F.col("count"))


def synthetic_universe(spark, n: int, seed: int = 7, seeds: tuple[str, ...] = ()) -> DataFrame:
    """(ticker, sector, log_market_cap, momentum_12m, price_to_book): a made-up cross-section of ``n >= 50`` securities in 10 sectors."""
    if n < 50:
        raise ValueError("n must be 50 at least")
    ids = spark.range(n)
    named = F.when(F.col("id") < len(seeds), F.element_at(F.array(*[F.lit(s) for s in seeds]), (F.col("id") + 1).cast("int"))) if seeds else F.lit(None).cast("string")
    df = ids.select("id", F.coalesce(named, F.format_string("MOCK%03d.NS", F.col("id") - len(seeds))).alias("ticker"), F.format_string("Sector_%02d", F.col("id") % 10).alias("sector"), F.randn(seed).alias("a"), F.randn(seed + 1).alias("b"), F.randn(seed + 2).alias("c"))
    return df.select("ticker", "sector", (10 + 1.2 * F.col("a")).alias("log_market_cap"), (0.03 * F.col("a") + 0.25 * F.col("b")).alias("momentum_12m"), F.exp(0.8 + 0.45 * F.col("c")).alias("price_to_book"))
