"""Forward returns with as-of prices.

With a short lag a target date is exploded to its ``max_lag + 1`` candidate dates and met with prices by (ticker, date): an equi-join
whose fan-out is bounded by the lag. With a long one targets and prices are sorted together and each target takes the last price of a
sweep from late to early; a ticker's time is cut into blocks, so that a long or crowded history is many tasks. Neither
makes the product of a ticker's history and its targets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import missing


@dataclass(frozen=True)
class ReturnConfig:
    """Entry at ``as_of + entry_lag`` days, exit at ``as_of + horizon``; prices up to ``max_lag`` calendar days late are taken."""

    horizons: tuple[int, ...] = (30, 90, 180)
    entry_lag: int = 0
    max_lag: int = 7
    buffer: int = 30

    def __post_init__(self):
        if not self.horizons or any(h <= 0 for h in self.horizons) or len(set(self.horizons)) != len(self.horizons):
            raise ValueError("horizons must be positive and distinct")
        if self.entry_lag < 0 or self.max_lag < 1 or self.buffer <= self.max_lag:
            raise ValueError("entry_lag >= 0, max_lag >= 1 and buffer > max_lag are needed")


#: Up to this lag candidate dates are exploded, beyond it targets and prices are merged.
EXPLODED_LAG = 15


def forward_prices(targets: DataFrame, prices: DataFrame, max_lag: int = 7) -> DataFrame:
    """``targets`` (with ticker, target_date) -> with price_date and price: the first close on or after the target date.

    Missing closes are skipped; if the first close there is is infinite, the price is NULL. Of several closes on one date the least
    counts.
    """
    keys = targets.columns
    wanted = targets.select("ticker", "target_date").distinct()
    clean = prices.where(~missing(F.col("close"))).select("ticker", "trade_date", "close")
    found = _exploded(wanted, clean, max_lag) if max_lag <= EXPLODED_LAG else _merged(wanted, clean, max_lag)
    first = found.select("ticker", "target_date", F.col("x.trade_date").alias("price_date"), F.when(F.abs("x.close") < float("inf"), F.col("x.close")).alias("price"))
    return targets.join(first, ["ticker", "target_date"], "left").select(*keys, "price_date", "price")


def _exploded(wanted: DataFrame, clean: DataFrame, max_lag: int) -> DataFrame:
    """(ticker, target_date, x: struct<trade_date, close>) by the candidate dates of each target."""
    days = F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_lag)), lambda d: F.date_add("target_date", d))).alias("trade_date")
    return wanted.select("ticker", "target_date", days).join(clean, ["ticker", "trade_date"]).groupBy("ticker", "target_date").agg(F.min(F.struct("trade_date", "close")).alias("x"))


def _merged(wanted: DataFrame, clean: DataFrame, max_lag: int) -> DataFrame:
    """The same by one sorted sweep in each block of a ticker's time: a row a price or target, not one for each candidate date.

    A price also goes to the block before its own if it lies near enough to the block's start for targets there. The first price of a
    day is enough, so a day's closes are reduced before the sweep.
    """
    size = max(64, 8 * max_lag)
    day = lambda c: F.unix_date(c)
    daily = clean.groupBy("ticker", "trade_date").agg(F.min("close").alias("close"))
    place = F.floor(day(F.col("trade_date")) / size)
    near = day(F.col("trade_date")) - place * size < max_lag
    price = daily.select("ticker", F.explode(F.when(near, F.array(place, place - 1)).otherwise(F.array(place))).alias("block"), F.col("trade_date").alias("at"), F.struct("trade_date", "close").alias("x"))
    target = wanted.select("ticker", F.floor(day(F.col("target_date")) / size).alias("block"), F.col("target_date").alias("at"), F.lit(None).cast(price.schema["x"].dataType).alias("x"))
    # From late to early, a day's price before its target: the last price so far is the first one on or after the target.
    sweep = Window.partitionBy("ticker", "block").orderBy(F.desc("at"), F.col("x").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = price.unionByName(target).withColumn("first", F.last("x", ignorenulls=True).over(sweep)).where(F.col("x").isNull())
    return swept.where(F.datediff("first.trade_date", "at") <= max_lag).select("ticker", F.col("at").alias("target_date"), F.col("first").alias("x"))


def forward_returns(dates: DataFrame, tickers: DataFrame, prices: DataFrame, config: ReturnConfig = ReturnConfig()) -> DataFrame:
    """``dates(as_of_date)``, ``tickers(ticker)`` -> (as_of_date, horizon_days, ticker, ret), NULL where there is no return.

    The entry price of a (date, ticker) is looked up once for all horizons; prices are cut to the dates that can matter.
    """
    offsets = sorted({config.entry_lag, *config.horizons})
    dates = dates.select("as_of_date").distinct()
    grid = dates.crossJoin(tickers.select("ticker").distinct())  # the result has this size times the horizons
    targets = grid.select("as_of_date", "ticker", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset")).withColumn("target_date", F.date_add("as_of_date", F.col("offset")))
    span = dates.agg(F.min("as_of_date").alias("lo"), F.date_add(F.max("as_of_date"), max(offsets) + config.buffer).alias("hi")).first()
    if span.lo is not None:
        prices = prices.where(F.col("trade_date").between(F.lit(span.lo), F.lit(span.hi)))
    found = forward_prices(targets, prices, config.max_lag)
    places = F.map_from_entries(F.collect_list(F.struct("offset", F.struct("price_date", "price"))))
    at = found.groupBy("as_of_date", "ticker").agg(places.alias("at"))
    df = at.select("as_of_date", "ticker", F.explode(F.array(*[F.lit(h) for h in config.horizons])).alias("horizon_days"), F.element_at("at", F.lit(config.entry_lag)).alias("entry"), "at")
    df = df.withColumn("exit", F.element_at("at", F.col("horizon_days")))
    good = (F.col("entry.price") > 0) & (F.col("exit.price") > 0) & (F.col("exit.price_date") > F.col("entry.price_date"))
    return df.select("as_of_date", "horizon_days", "ticker", F.when(good, F.col("exit.price") / F.col("entry.price") - 1).alias("ret"))


def missing_fixture_keys(returns: DataFrame, dates: DataFrame, horizons: list[int]) -> DataFrame:
    """(as_of_date, horizon_days) that a table of given returns lacks altogether."""
    wanted = dates.select("as_of_date").distinct().select("as_of_date", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_days"))
    return wanted.join(returns, ["as_of_date", "horizon_days"], "left_anti")


def fixture_returns(returns: DataFrame, dates: DataFrame, tickers: DataFrame, horizons: list[int]) -> DataFrame:
    """Given returns, filled up: a missing ticker is NULL (check ``missing_fixture_keys`` first)."""
    wanted = dates.select("as_of_date").distinct().crossJoin(tickers.select("ticker").distinct()).withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return wanted.join(returns, ["as_of_date", "horizon_days", "ticker"], "left").select("as_of_date", "horizon_days", "ticker", "ret")
