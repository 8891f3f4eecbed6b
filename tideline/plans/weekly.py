"""The weekly run: events to routed documents, masked and scored, propagated to the universe, neutralized and written."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import written
from ..functions.quality import finite, require, together, violation
from ..operators import features, graph, masking, neutralize, routing, scores

# The columns of the output, in order.
OUTPUT = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("as_of_utc", T.TimestampType()),
        T.StructField("module", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("pipeline_status", T.StringType()),
        T.StructField("raw_score", T.DoubleType()),
        T.StructField("alpha_z", T.DoubleType()),
        T.StructField("log_market_cap", T.DoubleType()),
        T.StructField("momentum_12m", T.DoubleType()),
        T.StructField("price_to_book", T.DoubleType()),
        T.StructField("sector", T.StringType()),
        T.StructField("event_count", T.LongType()),
        T.StructField("routed_candidate_count", T.LongType()),
        T.StructField("source_failure_count", T.LongType()),
    ]
)
NUMERIC = ["raw_score", "alpha_z", "log_market_cap", "momentum_12m", "price_to_book"]


@dataclass(frozen=True)
class WeeklyConfig:
    lookback_days: int = 7
    threshold: float = 0.15
    max_chars: int = 24_000
    mode: str = "mock"
    module: str = "supply_chain_alpha"

    def __post_init__(self):
        if self.lookback_days < 1 or not (0 <= self.threshold < float("inf")) or self.mode not in ("mock", "live"):
            raise ValueError("lookback_days >= 1, a finite threshold >= 0 and a known mode are needed")


class Weekly(NamedTuple):
    alpha: DataFrame
    metadata: DataFrame
    candidates: DataFrame


def output_violations(alpha: DataFrame) -> DataFrame:
    if alpha.columns != OUTPUT.names:
        raise ValueError("output columns differ from the schema")
    twice = alpha.groupBy("ticker").count().where("count > 1")
    checks = [violation(twice, "duplicate_ticker", F.lit(True), F.col("ticker"))]
    checks += [violation(alpha, "non_finite", ~F.coalesce(finite(F.col(c)), F.lit(False)), F.col("ticker"), c) for c in NUMERIC]
    return together(checks)


def run(
    events: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    factors: DataFrame,
    *,
    now: datetime,
    config: WeeklyConfig = WeeklyConfig(),
    scorer: Callable[[DataFrame], DataFrame] = features.scored,
    source_status: DataFrame | None = None,
    rules: list[tuple[str, str]] | None = None,
) -> Weekly:
    """``factors(ticker, log_market_cap, momentum_12m, price_to_book, sector)`` is the universe; ``events`` are already deduplicated."""
    spark = events.sparkSession
    now = (now if now.tzinfo else now.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    run_id, timings, began = now.strftime("%Y%m%dT%H%M%SZ"), {}, time.perf_counter()

    def lap(name: str) -> None:
        nonlocal began
        timings[name], began = time.perf_counter() - began, time.perf_counter()

    today = F.lit(now.date())
    start = F.date_sub(today, config.lookback_days - 1)
    # What is counted is counted while it is written; seconds are those of actions.
    counted = lambda df, name, **more: (seen := Observation(), written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()]), name))[::-1]
    events, seen = counted(events.where(F.col("published_date").between(start, today)), "weekly-events")
    n_events = seen.get["n"]
    failures = source_status.where(F.col("error").isNotNull()).count() if source_status is not None else 0
    lap("ingestion")
    routed = routing.route(events, nodes, rules)
    docs = routing.documents(routed, max_chars=config.max_chars).join(routing.aliases(routed), "node_id")
    docs, seen = counted(docs, "weekly-documents")
    n_routed = seen.get["n"]
    lap("routing")
    masked = masking.mask(docs, text="source_text", companies="company_aliases")
    role = F.concat("label", F.lit(" physical supply-chain choke point."))
    asked = masked.join(nodes.select("node_id", "label", "layer"), "node_id").withColumn("physical_role", role).withColumn("masked_text", F.col("mask.masked_text"))
    asked = asked.withColumn("leak_literal", masking.leak(F.col("masked_text"), masking.prohibited(F.col("mask.redactions"))))
    signals = scorer(asked.where(F.col("leak_literal").isNull())).withColumn("snapshot_id", F.lit(run_id))
    signals = scores.thresholded(signals.select("snapshot_id", "candidate_id", "node_id", "n_events", "s_raw"), config.threshold)
    signals, seen = counted(signals, "weekly-signals", active=F.coalesce(F.sum(F.col("active").cast("long")), F.lit(0)))
    n_active = seen.get["active"]
    lap("features")
    tickers = nodes.where(F.col("layer") == graph.TERMINAL).select("node_id", "ticker")
    matrix = graph.transmission_matrix(nodes, edges, signals.where("active").select("node_id"))
    one = spark.createDataFrame([(run_id,)], "snapshot_id string")
    section = scores.cross_section(one, factors, scores.contributions(signals, matrix, tickers)).select("ticker", F.col("score").alias("raw_score"))
    panel = written(factors.join(section, "ticker").withColumn("as_of_date", today), "weekly-panel")
    lap("propagation")
    neutral = neutralize.neutralize(panel)
    diag = neutral.diagnostics.first()
    if diag is None or diag.reason not in (None, "no_signal"):
        raise ValueError(f"neutralization: {diag.reason if diag else 'empty universe'}")
    lap("neutralization")
    status = "no_signal" if diag.reason else "ok"
    values = {"as_of_utc": F.lit(now), "module": F.lit(config.module), "run_id": F.lit(run_id), "pipeline_status": F.lit(status), "event_count": F.lit(n_events), "routed_candidate_count": F.lit(n_routed), "source_failure_count": F.lit(failures)}
    alpha = neutral.panel.withColumns(values).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in OUTPUT])
    bad = F.lit(False)
    for c in NUMERIC:
        bad = bad | ~F.coalesce(finite(F.col(c)), F.lit(False))
    alpha, seen = counted(alpha, "weekly-alpha", bad=F.sum(bad.cast("long")), alpha_mean=F.avg("alpha_z"), alpha_population_sd=F.stddev_pop("alpha_z"))
    found = seen.get
    twice = alpha.groupBy("ticker").count().where("count > 1")
    if found["bad"] or not twice.isEmpty():  # which ones is only looked up if there are any
        require(output_violations(alpha), "output")
    sums = {"n_securities": F.lit(found["n"]).cast("long"), "alpha_mean": F.lit(found["alpha_mean"]).cast("double"), "alpha_population_sd": F.lit(found["alpha_population_sd"]).cast("double"), "active_candidates": F.lit(n_active).cast("long")}
    lap("output")
    meta = spark.range(1).select(*[v.alias(k) for k, v in (sums | values).items()], F.create_map(*[x for k, s in timings.items() for x in (F.lit(k), F.lit(s))]).alias("stage_seconds"))  # one row each
    return Weekly(alpha, meta, signals)
