"""Walk-forward backtest: snapshots are masked, scored, propagated, and their scores ranked against forward returns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quality import require, together, violation
from ..functions.strings import blank
from ..operators import features, graph, masking, rank_ic, returns, scores


@dataclass(frozen=True)
class BacktestConfig:
    """Snapshots of the years ``start_year`` to ``end_year``; a candidate is active above ``threshold``."""

    start_year: int = 2018
    end_year: int = 2025
    horizons: tuple[int, ...] = (30, 90, 180)
    primary: int = 90
    threshold: float = 0.15
    min_obs: int = 3
    floor_year: int = 2016

    def __post_init__(self):
        if self.start_year < self.floor_year or self.end_year < self.start_year:
            raise ValueError(f"the window must start in {self.floor_year} or later and not end before it starts")
        if not self.horizons or any(h <= 0 for h in self.horizons) or len(set(self.horizons)) != len(self.horizons) or self.primary not in self.horizons:
            raise ValueError("horizons must be positive and distinct and hold the primary one")
        if not (0 <= self.threshold < float("inf")) or self.min_obs < 3:
            raise ValueError("threshold must be finite and >= 0, min_obs >= 3")


@dataclass
class Backtest:
    signals: DataFrame
    scores: DataFrame
    returns: DataFrame
    ics: DataFrame
    means: DataFrame
    contributed: Callable[[], DataFrame]

    @cached_property
    def contributions(self) -> DataFrame:
        """By candidate. They take the matrix of all candidates' nodes, which the scores don't, so they are computed when asked for."""
        return self.contributed()


def snapshot_violations(snapshots: DataFrame, candidates: DataFrame, nodes: DataFrame, config: BacktestConfig) -> DataFrame:
    """``snapshots(snapshot_id, as_of_date, source_text, ...)``, ``candidates(snapshot_id, anonymized_id, graph_node_id, physical_role)``."""
    twice = snapshots.groupBy("snapshot_id").count().where("count > 1")
    again = candidates.groupBy("snapshot_id", "anonymized_id").count().where("count > 1")
    lone = snapshots.join(candidates, "snapshot_id", "left_anti")
    placed = candidates.join(nodes.select(F.col("node_id").alias("graph_node_id"), "layer"), "graph_node_id", "left")
    name = F.concat_ws(":", "snapshot_id", "anonymized_id")
    return together(
        [
            violation(snapshots, "outside_window", ~F.coalesce(F.year("as_of_date").between(config.start_year, config.end_year), F.lit(False)), F.col("snapshot_id"), F.col("as_of_date")),
            violation(snapshots, "blank_text", blank("source_text"), F.col("snapshot_id")),
            violation(twice, "duplicate_snapshot", F.lit(True), F.col("snapshot_id")),
            violation(again, "duplicate_candidate", F.lit(True), name),
            violation(lone, "no_candidate", F.lit(True), F.col("snapshot_id")),
            violation(placed, "unknown_node", F.col("layer").isNull(), name, F.col("graph_node_id")),
            violation(placed, "terminal_node", F.col("layer") == graph.TERMINAL, name, F.col("graph_node_id")),
            violation(candidates, "unsafe_alias", features.alias_reason(F.col("anonymized_id")).isNotNull(), name, features.alias_reason(F.col("anonymized_id"))),
        ]
    )


def run(
    snapshots: DataFrame,
    candidates: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    prices: DataFrame | None = None,
    *,
    config: BacktestConfig = BacktestConfig(),
    scorer: Callable[[DataFrame], DataFrame] = features.scored,
    returns_of: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    return_config: returns.ReturnConfig | None = None,
    strict: bool = True,
) -> Backtest:
    """``scorer`` takes candidates with masked_text and physical_role and adds s_raw; ``returns_of(dates, tickers)`` may replace prices."""
    bad = snapshot_violations(snapshots, candidates, nodes, config)
    if strict:
        require(bad, "snapshots")
    else:
        # Entities are "snapshot" or "snapshot:candidate"; a snapshot with any fault is left out whole.
        snapshots = snapshots.join(bad.select(F.substring_index("entity", ":", 1).alias("snapshot_id")).distinct(), "snapshot_id", "left_anti")
    masked = masking.mask(snapshots, text="source_text", **{k: c for k, c in {"companies": "company_aliases", "tickers": "ticker_aliases", "events": "event_aliases", "executives": "executive_names"}.items() if c in snapshots.columns})
    texts = masked.select("snapshot_id", F.col("mask.masked_text").alias("masked_text"))
    asked = candidates.join(texts, "snapshot_id").withColumnsRenamed({"anonymized_id": "candidate_id", "graph_node_id": "node_id"})
    signals = scores.thresholded(scorer(asked), config.threshold)
    tickers = nodes.where(F.col("layer") == graph.TERMINAL).select("node_id", "ticker")
    contributed = lambda: scores.contributions(signals, graph.transmission_matrix(nodes, edges, signals.select("node_id")), tickers)
    section = scores.cross_section(snapshots, tickers, graph.signal_values(nodes, edges, signals, tickers))
    dates = snapshots.select("snapshot_id", "as_of_date")
    if returns_of is None:
        found = returns.forward_returns(dates, tickers, prices, return_config or returns.ReturnConfig(horizons=config.horizons))
    else:
        found = returns_of(dates, tickers)
        if strict and (lacking := rank_ic.missing_horizons(found, dates, list(config.horizons)).take(1)):
            raise ValueError(f"returns lack horizon {lacking[0].horizon_days} of {lacking[0].as_of_date}")
    ics = rank_ic.rank_ic(dates, list(config.horizons), section, found, config.min_obs)
    return Backtest(signals, section, found, ics.orderBy("as_of_date", "snapshot_id", "horizon_days"), rank_ic.mean_ic(ics), contributed)


def primary_mean(means: DataFrame, config: BacktestConfig = BacktestConfig()) -> DataFrame:
    return means.where(F.col("horizon_days") == config.primary)
