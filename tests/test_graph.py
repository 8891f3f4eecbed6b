"""Closed-form shocks on the seed graph, and its checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline.operators import graph
from tideline.plans import seed


@pytest.fixture(scope="module")
def g(spark):
    return seed.nodes(spark), seed.edges(spark)


def terminal(spark, g, shocks):
    nodes, edges = g
    df = spark.createDataFrame(shocks, "shock_id string, node_id string, shock double")
    return {(r.shock_id, r.ticker): r.shock for r in graph.terminal_shocks(graph.propagate(nodes, edges, df), nodes).collect()}


def test_counts(spark, g):
    rows = {r.layer: (r.n_nodes, r.n_edges) for r in graph.layer_counts(*g).collect()}
    assert rows == {0: (6, 8), 1: (7, 7), 2: (6, 8), 3: (7, 6), 4: (6, 0)}
    assert graph.node_violations(g[0]).count() == 0 and graph.edge_violations(*g).count() == 0 and graph.ticker_violations(g[0]).count() == 0


def test_shocks(spark, g):
    out = terminal(spark, g, [("unit", "RAW_FLUORSPAR", 1.0), ("part", "RAW_FLUORSPAR", 0.8), ("neg", "RAW_FLUORSPAR", -0.5), ("zero", "RAW_FLUORSPAR", 0.0)])
    assert out["unit", "SRF.NS"] == pytest.approx(0.08748, abs=1e-12)
    assert out["unit", "NAVINFLUOR.NS"] == pytest.approx(0.101574, abs=1e-12)
    assert out["part", "SRF.NS"] == pytest.approx(0.069984, abs=1e-12) and out["part", "NAVINFLUOR.NS"] == pytest.approx(0.0812592, abs=1e-12)
    assert out["neg", "SRF.NS"] < 0
    assert out["zero", "SRF.NS"] == 0.0 and out["zero", "NAVINFLUOR.NS"] == 0.0
    assert {t for s, t in out if s == "unit"} == {"SRF.NS", "NAVINFLUOR.NS"}


def test_two_paths_are_summed(spark, g):
    nodes, edges = g
    pairs = spark.createDataFrame([("RAW_SILICA_SAND", "SUB_PV_MODULES"), ("RAW_FLUORSPAR", "SRF.NS"), ("SRF.NS", "SRF.NS"), ("RAW_CRUDE", "SRF.NS"), ("NOWHERE", "SRF.NS")], "source string, target string")
    w = {(r.source, r.target): (r.weight, r.error) for r in graph.transmission(nodes, edges, pairs).collect()}
    assert w["RAW_SILICA_SAND", "SUB_PV_MODULES"][0] == pytest.approx(0.0748952, abs=1e-12)
    assert w["SRF.NS", "SRF.NS"] == (1.0, None) and w["RAW_CRUDE", "SRF.NS"] == (0.0, None) and w["NOWHERE", "SRF.NS"] == (None, "unknown_node")
    paths = graph.paths(edges, pairs).collect()
    found = [r for r in paths if r.source == "RAW_FLUORSPAR"]
    assert len(found) == 1 and len(found[0].path) == 5 and found[0].transmission_weight == pytest.approx(0.08748, abs=1e-12)
    both = [r.transmission_weight for r in paths if r.source == "RAW_SILICA_SAND"]
    assert len(both) == 2 and sum(both) == pytest.approx(0.0748952, abs=1e-12)
    assert not [r for r in paths if r.source == r.target]


def test_bad_shocks(spark, g):
    nodes, edges = g
    df = spark.createDataFrame([("a", "NOWHERE", 1.0), ("b", "RAW_CRUDE", float("nan")), ("c", "RAW_CRUDE", float("inf")), ("d", "RAW_CRUDE", None)], "shock_id string, node_id string, shock double")
    assert {(r.shock_id, r.error) for r in graph.shock_errors(nodes, df).collect()} == {("a", "unknown_node"), ("b", "non_finite_shock"), ("c", "non_finite_shock"), ("d", "non_finite_shock")}
    assert graph.propagate(nodes, edges, df).count() == 0


def test_violations(spark, g):
    nodes, edges = g
    bad = spark.createDataFrame([("X", " ", 1, "raw", None), ("Y", "y", 4, "equity", None), ("RAW_CRUDE", "again", 0, "raw", "T")], nodes.schema)
    rules = {(r.rule, r.entity) for r in graph.node_violations(nodes.unionByName(bad)).collect()}
    assert rules == {("blank_label", "X"), ("kind_mismatch", "X"), ("ticker_layer", "Y"), ("ticker_layer", "RAW_CRUDE"), ("duplicate_node", "RAW_CRUDE")}
    e = spark.createDataFrame([("RAW_CRUDE", "COMP_PV_CELLS", 0.1, 0.1, 1.0), ("RAW_CRUDE", "GONE", 0.1, 1.1, 1.0), ("RAW_IRON_ORE", "INT_CRGO_STEEL", float("nan"), 0.1, -1.0)], edges.schema)
    rules = {r.rule for r in graph.edge_violations(nodes, edges.unionByName(e)).collect()}
    assert rules == {"layer_skip", "unknown_target", "cost_share_range", "substitutability_range", "lead_time_range", "duplicate_edge"}


def test_same_result_for_any_partitioning(spark, g):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            unit = g[0].where("layer = 0").select(F.col("node_id").alias("shock_id"), "node_id", F.lit(1.0).alias("shock"))
            out.append(sorted((r.shock_id, r.node_id, round(r.shock, 12)) for r in graph.propagate(*g, unit).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert out[0] == out[1]


def test_hubs_are_shared(spark):
    """A source with most edges is dealt to salts; the shocks are the same."""
    nodes = spark.createDataFrame([("R", 0), ("R2", 0)] + [(f"C{i}", 1) for i in range(300)] + [(f"S{i}", 2) for i in range(5)], "node_id string, layer int")
    nodes = nodes.withColumn("ticker", F.lit(None).cast("string"))
    edges = [("R", f"C{i}", 0.1 + (i % 7) / 10, 0.5) for i in range(300)] + [("R2", "C1", 0.2, 0.5)] + [(f"C{i}", f"S{i % 5}", 0.3, (i % 4) / 4) for i in range(300)]
    edges = spark.createDataFrame(edges, "source string, target string, cost_share double, substitutability double")
    shocks = spark.createDataFrame([("a", "R", 1.0), ("b", "R", -0.5), ("b", "R2", 2.0), ("b", "C3", 0.0)], "shock_id string, node_id string, shock double")
    steps, hubs = graph.salted(graph.weighted(edges).select(F.col("source").alias("node_id"), "target", "transmission_factor"), 50)
    assert [tuple(r) for r in hubs.collect()] == [("R", 6)] and steps.where("node_id = 'R'").groupBy("salt").count().count() == 6 and steps.count() == edges.count()
    one, two = ({(r.shock_id, r.node_id): (r.layer, round(r.shock, 12)) for r in graph.propagate(nodes, edges, shocks, hub_edges=n).collect()} for n in (50, 10**6))
    assert one == two and len(one) > 600


def layered(spark, widths=(3, 5, 8, 20, 60), seed=5):
    """A random layered graph with a doubled edge, and its edges with and without the layer of their source."""
    import random

    rng = random.Random(seed)
    name = lambda k, i: f"{'RNSPC'[k]}:{i}"
    nodes = spark.createDataFrame([(name(k, i), k, name(k, i).lower() if k == 4 else None) for k, w in enumerate(widths) for i in range(w)], "node_id string, layer int, ticker string")
    rows = [(name(k, i), name(k + 1, j), rng.random(), rng.random(), k) for k in range(4) for i in range(widths[k]) for j in rng.sample(range(widths[k + 1]), max(1, widths[k + 1] // 3))]
    edges = spark.createDataFrame([*rows, rows[-1]], "source string, target string, substitutability double, cost_share double, source_layer int").cache()
    return nodes, edges, edges.drop("source_layer")


class Written:
    """What ``written`` of a module writes: names and numbers of rows."""

    def __init__(self, monkeypatch, module=graph):
        self.rows, real = [], module.written
        monkeypatch.setattr(module, "written", lambda df, name: self.noted(real(df, name), name))

    def noted(self, df, name):
        self.rows.append((name, df.count()))
        return df


def test_layer_totals_without_the_last_state(spark, monkeypatch):
    nodes, edges, bare = layered(spark)
    shocks = [(f"s{i}", f"S:{i}", i - 3.0) for i in range(8)] + [("s1", "P:2", 1.0), ("s2", "R:1", 0.5), ("s2", "C:1", 2.0), ("s3", "N:2", 0.0), ("bad", "S:1", float("nan")), ("s4", "P:1", 0.0), (None, "R:0", 1.0)]
    shocks = spark.createDataFrame(shocks, "shock_id string, node_id string, shock double")
    want = {(r.shock_id, r.layer): (r.n, pytest.approx(r.total, abs=1e-9)) for r in graph.propagate(nodes, edges, shocks).groupBy("shock_id", "layer").agg(F.count("*").alias("n"), F.sum("shock").alias("total")).collect()}
    for e, listed, at_once in ((edges, 1000, 10**9), (bare, 3, 200)):
        monkeypatch.setattr(graph, "LISTED", listed)
        monkeypatch.setattr(graph, "AT_ONCE", at_once)
        got = {(r.shock_id, r.layer): (r.n_nodes, r.total) for r in graph.layer_totals(nodes, e, shocks).collect()}
        assert got == want and len(got) > 20
    assert graph.layer_totals(nodes, edges, shocks.where("shock_id = 'bad'")).count() == 0
    nodes, edges, _ = layered(spark, (3, 5, 20, 20, 60))
    many = nodes.where("layer = 2").select(F.col("node_id").alias("shock_id"), "node_id", F.lit(1.0).alias("shock"))
    seen = Written(monkeypatch)
    last = graph.layer_totals(nodes, edges, many).where("layer = 4").agg(F.sum("n_nodes")).first()[0]
    assert last > edges.count() > max(n for _, n in seen.rows)  # shocks x customers aren't written


def test_shuffle_files_go_with_their_query(spark):
    """What made a table isn't kept beside it."""
    from tideline.functions.lineage import written

    def kept():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()

    spark._jvm.System.gc()
    before = kept()
    for _ in range(3):
        written(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 5000).alias("k")).count(), "t")
    import time

    for _ in range(50):
        if kept() <= before:
            break
        time.sleep(0.2)
    assert kept() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_path_totals_list_no_paths(spark, monkeypatch):
    nodes, edges, bare = layered(spark)
    pairs = nodes.where("layer <= 1").select(F.col("node_id").alias("source")).crossJoin(nodes.where("layer <> 2").select(F.col("node_id").alias("target")))
    listed = graph.paths(bare, pairs).groupBy("source", "target").agg(F.count("*").alias("n"), F.min(F.size("path")).alias("k"), F.sum("transmission_weight").alias("w"))
    want = {(r.source, r.target): (r.n, r.k, pytest.approx(r.w, rel=1e-9)) for r in listed.collect()}
    assert len(want) > 300 and max(n for n, _, _ in want.values()) > 5
    for few, e in ((32, edges), (32, bare), (0, edges)):
        monkeypatch.setattr(graph, "FEW", few)
        got = {(r.source, r.target): (r.n_paths, r.n_nodes, r.weight) for r in graph.path_totals(e, pairs).collect()}
        assert got == want
    assert graph.path_totals(edges, pairs.limit(0)).count() == 0


def test_region_customer_paths_write_no_paths(spark, monkeypatch, tmp_path):
    from tideline.plans import graph_queries

    star(spark, tmp_path)
    seen = Written(monkeypatch)
    got = graph_queries.region_customer_paths(spark, str(tmp_path)).collect()
    n_paths = sum(r.n_paths for r in got)
    assert len(got) == 2 * 10 and n_paths == 400 and max(n for _, n in seen.rows) < n_paths / 4


def star(spark, path):
    """A little star schema: each of 10 customers bought each of 8 parts once; a part comes from 5 of 10 suppliers."""
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    at = dt.datetime(1997, 1, 1)
    put("region", [(i, f"R{i}") for i in range(2)], "r_regionkey int, r_name string")
    put("nation", [(i, f"N{i}", i % 2) for i in range(4)], "n_nationkey int, n_name string, n_regionkey int")
    put("supplier", [(i, f"S{i}", i % 4, 5000.0) for i in range(10)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    put("part", [(i, f"P{i}") for i in range(8)], "p_partkey long, p_name string")
    put("customer", [(i, f"C{i}") for i in range(10)], "c_custkey long, c_name string")
    put("orders", [(i, i, at) for i in range(10)], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    lines = [(c, p, (c + p) % 10 // 2 * 2 + p % 2, 100.0 + c + p, 0.05, at) for c in range(10) for p in range(8)]
    put("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_shipdate timestamp")


def test_few_shocks_lie_in_columns(spark, monkeypatch):
    """An edge is one row of a round's shuffle for eight shocks, and the shocks are the same as in rows, sent or joined by key."""
    nodes, edges, bare = layered(spark)
    shocks = spark.createDataFrame([(f"r{i}", f"R:{i}", 1.0 - i) for i in range(3)] + [("r0", "N:1", 0.25), ("z", "S:3", 0.0), (None, "S:3", 3.0)] + [(f"n{i}", f"N:{i}", 2.0) for i in range(5)], "shock_id string, node_id string, shock double")
    out, largest = [], []
    for few, small, e in ((32, 10**6, edges), (32, 0, bare), (0, 10**6, bare), (0, 0, edges)):
        monkeypatch.setattr(graph, "FEW", few)
        monkeypatch.setattr(graph, "SMALL", small)
        with monkeypatch.context() as m:
            seen = Written(m)
            rows = graph.propagate(nodes, e, shocks, hub_edges=10).collect()
        out.append(sorted((str(r.shock_id), r.node_id, r.layer, round(r.shock, 9)) for r in rows))
        largest.append(max(n for name, n in seen.rows if name == "shocks"))
    assert out[0] == out[1] == out[2] == out[3] and largest[0] * 4 < largest[2]
    lost = edges.withColumn("cost_share", F.when(F.col("target") != "P:1", F.col("cost_share")))  # edges without a weight still reach their target
    monkeypatch.setattr(graph, "FEW", 32)
    assert graph.propagate(nodes, lost, shocks).count() == len(out[0])


def test_transmission_goes_no_further_than_its_targets(spark, monkeypatch):
    nodes, edges, _ = layered(spark)
    pairs = spark.createDataFrame([("N:1", "P:3"), ("N:1", "P:3"), ("N:1", "N:1"), ("N:2", "S:1"), ("R:0", "?"), ("?", "P:1"), ("P:1", "N:1")], "source string, target string")
    want = {(r.source, r.target): r.n for r in graph.path_totals(edges, pairs).select("source", "target", F.col("weight").alias("n")).collect()}
    seen = Written(monkeypatch)
    got = {(r.source, r.target): (r.weight, r.error) for r in graph.transmission(nodes, edges, pairs).collect()}
    assert got["N:1", "N:1"] == (1.0, None) and got["R:0", "?"] == got["?", "P:1"] == (None, "unknown_node") and got["P:1", "N:1"] == (0.0, None) and len(got) == 6
    assert got["N:1", "P:3"][0] == pytest.approx(want.get(("N:1", "P:3"), 0.0)) and got["N:2", "S:1"][0] == pytest.approx(want.get(("N:2", "S:1"), 0.0))
    assert max(n for _, n in seen.rows) <= 20  # the parts; customers aren't reached


def test_edges_of_the_layers_that_are_asked_for(spark, monkeypatch, tmp_path):
    from tideline.plans import graph_queries, market

    star(spark, tmp_path)
    d = str(tmp_path)
    whole = {tuple(r) for r in market.edges(spark, d).collect()}
    assert {r[-1]: sum(x[-1] == r[-1] for x in whole) for r in whole} == {0: 4, 1: 10, 2: 40, 3: 80}
    for below in (2, 3):
        assert {tuple(r) for r in market.edges(spark, d, below).collect()} == {r for r in whole if r[-1] < below}
    monkeypatch.setattr(graph_queries, "written", lambda df, name, real=graph_queries.written: seen.noted(real(df, name), name))
    seen = Written(monkeypatch)
    graph_queries.contribution_maps(spark, d).collect()
    assert max(n for _, n in seen.rows) == 14


@pytest.mark.parametrize("n_snapshots", [2, 9])
def test_signals_of_a_snapshot_are_one_shock(spark, monkeypatch, n_snapshots):
    from tideline.operators import scores

    nodes, edges, _ = layered(spark)
    rows = [(f"t{t}", f"C{i}", f"N:{i}", (i - 2.0) * (t + 1), i != 3) for t in range(n_snapshots) for i in range(5)] + [("t0", "D", "N:0", 0.5, True), ("t0", "E", "?", 9.0, True)]
    signals = spark.createDataFrame(rows, "snapshot_id string, candidate_id string, node_id string, s_raw double, active boolean")
    tickers = nodes.where("layer = 4").select("node_id", "ticker")
    sums = lambda df: {(r.snapshot_id, r.ticker): pytest.approx(r.v, abs=1e-9) for r in df.groupBy("snapshot_id", "ticker").agg(F.sum("value").alias("v")).collect()}
    want = sums(scores.contributions(signals, graph.transmission_matrix(nodes, edges, signals.select("node_id")), tickers))
    seen = Written(monkeypatch)
    got = graph.signal_values(nodes, edges, signals, tickers)
    assert {k: v.expected for k, v in sums(got).items()} == want and len(want) > 50
    assert got.count() <= 60 * n_snapshots if n_snapshots == 2 else max(n for _, n in seen.rows) <= 60


def test_violations_of_ends_are_counted(spark):
    nodes, _, bare = layered(spark)
    bare = bare.withColumn("lead_time_months", F.lit(1.0))
    skip = bare.where("source = 'R:0'").withColumn("target", F.lit("P:1"))
    lost = bare.where("target = 'C:5'").withColumn("source", F.lit("?"))
    gone = bare.where("source = 'N:1'").withColumn("target", F.lit("?"))
    n = {"layer_skip": skip.count(), "unknown_source": lost.count(), "unknown_target": gone.count()}
    found = graph.edge_violations(nodes, bare.unionByName(skip.unionByName(skip)).unionByName(lost).unionByName(gone))
    got = {r.rule: (r.n, r.k, r.d) for r in found.groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("k"), F.max("detail").alias("d")).collect()}
    assert got["layer_skip"] == (2 * n["layer_skip"], 1, "0->3") and got["unknown_source"][:2] == (n["unknown_source"], 1) and got["unknown_target"][:2] == (n["unknown_target"], 1)
    assert got["duplicate_edge"][0] == got["duplicate_edge"][1] == 1 + 1 + (n["unknown_source"] > 1) + (n["unknown_target"] > 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Join LeftOuter") == 2  # ends are dealt once by source and once by target
