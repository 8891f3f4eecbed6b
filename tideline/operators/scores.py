"""Equity scores: thresholded signals times transmission weights, summed into full cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thresholded(signals: DataFrame, threshold: float) -> DataFrame:
    """``active`` where ``abs(s_raw) > threshold``, strictly; inactive candidates stay."""
    return signals.withColumn("active", F.abs("s_raw") > F.lit(threshold))


def contributions(signals: DataFrame, matrix: DataFrame, tickers: DataFrame) -> DataFrame:
    """(snapshot_id, candidate_id, ticker, value): ``s_raw * weight`` of the active candidates.

    ``signals(snapshot_id, candidate_id, node_id, s_raw, active)``, ``matrix(source, node_id, weight)``, ``tickers(node_id, ticker)``.
    """
    weights = matrix.select("source", F.col("node_id").alias("target"), "weight").join(tickers.select(F.col("node_id").alias("target"), "ticker"), "target")
    active = signals.where("active").select("snapshot_id", "candidate_id", F.col("node_id").alias("source"), "s_raw")
    return active.join(weights, "source").groupBy("snapshot_id", "candidate_id", "ticker").agg(F.sum(F.col("s_raw") * F.col("weight")).alias("value"))


def cross_section(snapshots: DataFrame, universe: DataFrame, values: DataFrame) -> DataFrame:
    """(snapshot_id, ticker, score): every ticker of the universe in every snapshot, 0.0 without contributions.

    Contributions to tickers outside the universe are dropped. Scores are rounded to 12 places, so that the order of the sums can't
    make or break ties.
    """
    sums = values.groupBy("snapshot_id", "ticker").agg(F.sum("value").alias("score"))
    full = snapshots.select("snapshot_id").distinct().crossJoin(universe.select("ticker").distinct())  # two small lists: the result has this size
    return full.join(sums, ["snapshot_id", "ticker"], "left").select("snapshot_id", "ticker", F.round(F.coalesce("score", F.lit(0.0)), 12).alias("score"))


def contribution_maps(values: DataFrame) -> DataFrame:
    """(snapshot_id, candidate_id, terminal_contributions map)."""
    return values.groupBy("snapshot_id", "candidate_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("ticker", "value")))).alias("terminal_contributions"))
