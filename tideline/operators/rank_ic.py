"""Spearman rank IC per snapshot and horizon, and its means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.quality import finite
from ..functions.ranges import average_ranks, largest


def average_rank(keys: list[str], value: str) -> F.Column:
    by, same = Window.partitionBy(*keys).orderBy(value), Window.partitionBy(*keys, value)
    return F.rank().over(by) + (F.count("*").over(same) - 1) / 2


def rank_ic(snapshots: DataFrame, horizons: list[int], scores: DataFrame, returns: DataFrame, min_obs: int = 3, *, window_rows: int = 1_000_000) -> DataFrame:
    """(snapshot_id, as_of_date, horizon_days, rank_ic, n_obs, reason), a row for each snapshot and horizon.

    Cross-sections of up to ``window_rows`` are ranked in windows, many to a task; where one is larger, ranks come from running sums
    over ranges of values, so that it is many tasks. Both give the same ranks.
    ``snapshots(snapshot_id, as_of_date)``, ``scores(snapshot_id, ticker, score)``, ``returns(as_of_date, horizon_days, ticker, ret)``.
    """
    keys = ["snapshot_id", "horizon_days"]
    pairs = scores.join(snapshots.select("snapshot_id", "as_of_date"), "snapshot_id").join(returns, ["as_of_date", "ticker"])
    # -0.0 and 0.0 are one value for a rank
    pairs = pairs.where(finite(F.col("score")) & finite(F.col("ret"))).select(*keys, (F.round("score", 12) + 0.0).alias("score"), (F.col("ret") + 0.0).alias("ret"))
    pairs = written(pairs, "rank-pairs")
    if largest(pairs, keys) <= window_rows:
        ranked = pairs.withColumn("rs", average_rank(keys, "score")).withColumn("rr", average_rank(keys, "ret"))
        ranked = ranked.withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    else:
        ranked = average_ranks(pairs, keys, {"rs": "score", "rr": "ret"}).join(pairs.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    mid = (F.col("n") + 1) / 2  # the mean of average ranks
    ranked = ranked.withColumn("ds", F.col("rs") - mid).withColumn("dr", F.col("rr") - mid)
    sums = ranked.groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        (F.min("score") == F.max("score")).alias("flat_score"),
        (F.min("ret") == F.max("ret")).alias("flat_return"),
        F.try_divide(F.sum(F.col("ds") * F.col("dr")), F.sqrt(F.sum(F.col("ds") ** 2)) * F.sqrt(F.sum(F.col("dr") ** 2))).alias("value"),
    )
    grid = snapshots.select("snapshot_id", "as_of_date").distinct().withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    df = grid.join(sums, keys, "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    reason = (
        F.when(F.col("n_obs") < min_obs, "insufficient_observations")
        .when(F.col("flat_score"), "constant_score_cross_section")
        .when(F.col("flat_return"), "constant_return_cross_section")
        .when(~finite(F.col("value")), "non_finite_correlation")
    )
    return df.select("snapshot_id", "as_of_date", "horizon_days", F.when(reason.isNull(), F.col("value")).alias("rank_ic"), F.col("n_obs").cast("int").alias("n_obs"), reason.alias("reason"))


def mean_ic(ics: DataFrame) -> DataFrame:
    """(horizon_days, mean_ic, n_snapshots): means over the snapshots with a coefficient, NULL if none has one."""
    return ics.groupBy("horizon_days").agg(F.avg("rank_ic").alias("mean_ic"), F.count("rank_ic").alias("n_snapshots"))


def missing_horizons(returns: DataFrame, snapshots: DataFrame, horizons: list[int]) -> DataFrame:
    """(as_of_date, horizon_days) that a return provider left out."""
    wanted = snapshots.select("as_of_date").distinct().withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in horizons])))
    return wanted.join(returns, ["as_of_date", "horizon_days"], "left_anti")
