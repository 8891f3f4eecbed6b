"""The backtest and the weekly run, end to end, with deterministic stand-ins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import events, factors
from tideline.plans import backtest, seed, weekly
from tideline.plans.registry import ORACLES, QUERIES

D = dt.date
SCORES = {"solar": 0.82, "core": 0.71}


def scorer(df):
    return df.withColumn("s_raw", F.when(F.col("physical_role").contains("solar"), SCORES["solar"]).otherwise(SCORES["core"]))


def inputs(spark, second="COMP_TRANSFORMER_CORES"):
    snaps = spark.createDataFrame([("b", D(2022, 12, 21), "Transformer news of 2022."), ("a", D(2020, 12, 11), "Borosil solar glass news of 2020.")], "snapshot_id string, as_of_date date, source_text string")
    cands = spark.createDataFrame([("a", "C1", "COMP_SOLAR_GLASS", "solar glass"), ("b", "C1", second, "core")], "snapshot_id string, anonymized_id string, graph_node_id string, physical_role string")
    return snaps, cands, seed.nodes(spark), seed.edges(spark)


def given_returns(spark):
    def of(dates, tickers):
        rank = F.pmod(F.xxhash64("ticker"), F.lit(1000)) / 1000.0
        return dates.crossJoin(tickers.select("ticker")).select("as_of_date", F.explode(F.array(*[F.lit(h) for h in (30, 90, 180)])).alias("horizon_days"), "ticker", rank.alias("ret"))

    return of


def test_walk_forward(spark):
    out = backtest.run(*inputs(spark), scorer=scorer, returns_of=given_returns(spark))
    got = {(r.snapshot_id, r.ticker): r.score for r in out.scores.collect()}
    assert len(got) == 12
    assert got["a", "BORORENEW.NS"] == pytest.approx(0.82 * (0.95 * 0.82) * (0.95 * 0.85), abs=1e-12)
    assert got["b", "TRIL.NS"] == pytest.approx(0.147041568, abs=1e-12) and got["b", "VOLTAMP.NS"] == pytest.approx(0.1357865344, abs=1e-12)
    assert sum(v == 0 for v in got.values()) == 9
    rows = out.ics.collect()
    assert [(r.as_of_date, r.horizon_days) for r in rows] == [(d, h) for d in (D(2020, 12, 11), D(2022, 12, 21)) for h in (30, 90, 180)]
    assert all(r.reason is None and r.n_obs == 6 for r in rows)
    assert backtest.primary_mean(out.means).first().n_snapshots == 2


def test_threshold_is_strict(spark):
    flat = lambda df: df.withColumn("s_raw", F.lit(0.15))
    out = backtest.run(*inputs(spark), scorer=flat, returns_of=given_returns(spark))
    assert out.scores.where("score <> 0").count() == 0 and {r.reason for r in out.ics.collect()} == {"constant_score_cross_section"}
    assert out.signals.where("active").count() == 0 and out.signals.count() == 2


@pytest.mark.parametrize(("change", "rule"), [({"start_year": 2021}, "outside_window"), ({}, "terminal_node")])
def test_rejections(spark, change, rule):
    snaps, cands, nodes, edges = inputs(spark, "SRF.NS" if rule == "terminal_node" else "COMP_TRANSFORMER_CORES")
    config = backtest.BacktestConfig(**change)
    with pytest.raises(ValueError, match=rule):
        backtest.run(snaps, cands, nodes, edges, config=config, scorer=scorer, returns_of=given_returns(spark))
    out = backtest.run(snaps, cands, nodes, edges, config=config, scorer=scorer, returns_of=given_returns(spark), strict=False)
    assert out.ics.select("snapshot_id").distinct().count() == 1
    for bad in ({"start_year": 2015}, {"end_year": 2000}, {"horizons": (30, 30)}, {"primary": 7}, {"threshold": -1}, {"min_obs": 2}):
        with pytest.raises(ValueError):
            backtest.BacktestConfig(**bad)


def weekly_inputs(spark):
    now = dt.datetime(2024, 5, 10, 6, 0)
    rows = [(D(2024, 5, 9), "Solar glass duty", "1", "Borosil in 2024"), (D(2024, 5, 8), "CRGO import", "2", ""), (D(2024, 5, 8), "Fluorspar export", "3", ""), (D(2024, 1, 1), "Polysilicon", "4", "too old")]
    df = spark.createDataFrame(rows, "day date, title string, url string, text string")
    e = events.make_events(df, source=F.lit("MOCK"), event_type=F.lit("t"), published_date=F.col("day"), title=F.col("title"), url=F.col("url"), text=F.col("text"), fetched_at=F.lit(now))
    universe = factors.synthetic_universe(spark, 500, seeds=tuple(t for t, _ in seed.NODES[4]))
    return now, e, universe


def test_weekly_run(spark):
    now, e, universe = weekly_inputs(spark)
    runs = [weekly.run(e, seed.nodes(spark), seed.edges(spark), universe, now=now) for _ in range(2)]
    alpha = runs[0].alpha
    assert alpha.schema.names == weekly.OUTPUT.names and alpha.count() == 500
    a, b = (sorted((r.ticker, r.raw_score, round(r.alpha_z, 9)) for r in x.alpha.collect()) for x in runs)
    assert a == b and sum(r != 0 for _, r, _ in a) >= 5
    meta = runs[0].metadata.first()
    assert (meta.event_count, meta.routed_candidate_count, meta.active_candidates, meta.pipeline_status, meta.run_id) == (3, 3, 3, "ok", "20240510T060000Z")
    assert abs(meta.alpha_mean) < 1e-9 and abs(meta.alpha_population_sd - 1) < 1e-9 and len(meta.stage_seconds) == 6


def test_weekly_run_without_events(spark):
    now, e, universe = weekly_inputs(spark)
    out = weekly.run(e.limit(0), seed.nodes(spark), seed.edges(spark), universe, now=now)
    assert out.metadata.first().pipeline_status == "no_signal" and out.alpha.where("alpha_z <> 0").count() == 0
    with pytest.raises(ValueError):
        weekly.WeeklyConfig(lookback_days=0)


def test_entry_without_the_corpus_package(monkeypatch):
    import sys

    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql()) and set(ORACLES) <= set(QUERIES)
    for name in [n for n in sys.modules if n.startswith("tideline.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    for name in ("tideline.llm", "tideline.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)  # an import of it fails
    assert set(__spark_entry__.queries()) == set(QUERIES) and set(__spark_entry__.oracle_sql()) == set(ORACLES)


def test_backtest_scores_without_the_matrix(spark, monkeypatch):
    """The matrix of all candidates is computed when contributions are asked for."""
    from tideline.operators import graph

    asked, real = [], graph.transmission_matrix
    monkeypatch.setattr(graph, "transmission_matrix", lambda *a, **k: asked.append(1) or real(*a, **k))
    out = backtest.run(*inputs(spark), scorer=scorer, returns_of=given_returns(spark))
    got = {(r.snapshot_id, r.ticker): r.score for r in out.scores.where("score <> 0").collect()}
    assert len(got) == 3 and not asked
    assert {(r.snapshot_id, r.ticker): pytest.approx(r.value) for r in out.contributions.collect()} == got and len(asked) == 1
