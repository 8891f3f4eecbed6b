"""Running sums and ranks in two levels against plain windows, with a group that holds a third of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import lineage
from tideline.functions.ranges import average_ranks, largest, medians, running
from tideline.operators import factors, rank_ic, returns, routing


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [("hot" if i % 3 == 0 else f"g{rng.randrange(40)}", i, rng.randrange(9), rng.choice([None, *range(-20, 20)]), rng.random()) for i in range(6000)]
    return spark.createDataFrame(data, "g string, id long, k int, v int, x double").repartition(7).cache()


@pytest.fixture(autouse=True)
def small_parts(spark):
    """Parts stay apart though they are small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sums(spark, rows):
    out = running(rows, ["g"], ["k", "id"], {"n": F.lit(1), "s": F.col("v"), "f": F.col("x")})
    w = Window.partitionBy("g").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.id: r for r in rows.select("id", F.row_number().over(Window.partitionBy("g").orderBy("k", "id")).alias("n"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.coalesce(F.sum("x").over(w), F.lit(0.0)).alias("f")).collect()}
    got = out.collect()
    assert len(got) == 6000 and out.columns == [*rows.columns, "n", "s", "f"]
    assert all(r.n + 1 == want[r.id].n and r.s == want[r.id].s and abs(r.f - want[r.id].f) < 1e-8 for r in got)
    # the hot group lies in several parts
    parts = rows.repartitionByRange("g", "k", "id").withColumn("p", F.spark_partition_id())
    assert parts.where("g = 'hot'").select("p").distinct().count() > 1


def test_numbers_without_one_window(spark, rows):
    out = running(rows, [], ["x", "id"], {"n": F.lit(1)})
    assert [r.id for r in out.orderBy("n").select("id").collect()] == [r.id for r in rows.orderBy("x", "id").select("id").collect()]
    assert sorted(r.n for r in out.collect()) == list(range(6000))
    assert "SinglePartition" not in plan(out)
    assert running(rows.limit(0), [], ["x"], {"n": F.lit(1)}).count() == 0 and running(rows.limit(0), ["g"], ["x"], {"n": F.lit(1)}).count() == 0


def test_average_ranks(spark, rows):
    got = {r.id: r.r for r in average_ranks(rows, ["g"], {"r": "v"}).collect()}
    frame = rows.select("g", "id", "v").toPandas()
    want = frame.groupby("g")["v"].rank()
    assert len(got) == 6000
    assert all((got[i] is None) if r != r else got[i] == r for i, r in zip(frame["id"], want))


def test_a_hot_node(spark):
    """A node that most events go to: the same text, count and issuers as by one window over the node."""
    events = spark.range(3000).selectExpr(
        "IF(id % 3 < 2, 'HOT', concat('N', id % 50)) AS node_id", "concat('e', lpad(id, 5, '0')) AS event_id", "date_add(DATE'2024-01-01', CAST(id % 2 AS INT)) AS published_date", "'S' AS source", "concat('t', id) AS title", "repeat('x', CAST(id % 90 AS INT)) AS text", "map('company_name', concat(' Co', id % 7, ' ')) AS metadata"
    )
    got = {r.node_id: r for r in routing.documents(events, max_chars=5000).collect()}
    held = {}
    for r in events.collect():
        held.setdefault(r.node_id, []).append(r)
    assert got.keys() == held.keys()
    for node, es in held.items():
        es.sort(key=lambda e: (e.published_date, e.event_id))
        chunks = [f"Source: S\nDate: {e.published_date}\nTitle: {e.title}\nText: {e.text}" for e in es]
        issuers = {e.metadata["company_name"].strip(): f"Issuer_{n:03d}" for n, e in enumerate(es, 1)}
        assert (got[node].n_events, got[node].source_text, got[node].company_aliases) == (len(es), routing.BREAK.join(chunks)[:5000], issuers)
    named = routing.aliases(events)
    assert {r.node_id: r.candidate_id for r in named.collect()} == {n: f"Candidate_{i:03d}" for i, n in enumerate(sorted(held), 1)}
    assert "SinglePartition" not in plan(named)


def test_medians(spark, rows):
    got = {r.g: (r.v, r.x) for r in medians(rows, ["g"], ["v", "x"]).collect()}
    want = {r.g: (r.v, r.x) for r in rows.groupBy("g").agg(F.median("v").alias("v"), F.median("x").alias("x")).collect()}
    assert got == want and largest(rows, ["g"]) == rows.where("g = 'hot'").count()
    none = rows.withColumn("v", F.lit(None).cast("double"))
    assert {r.v for r in medians(none, ["g"], ["v"]).collect()} == {None}


def test_imputation_of_large_groups(spark, rows):
    table = rows.select(F.lit("d").alias("as_of_date"), F.col("id").cast("string").alias("ticker"), F.col("g").alias("sector"), F.when(F.col("id") % 4 > 0, F.col("v")).cast("double").alias("v"))
    sort = lambda df: sorted((r.ticker, r.v, r.imputed_v) for r in df.collect())
    assert sort(factors.impute(table, ["v"], large=100)) == sort(factors.impute(table, ["v"]))


def test_rank_ic_of_one_large_cross_section(spark, rows):
    snaps = spark.createDataFrame([("s", dt.date(2020, 1, 1)), ("t", dt.date(2020, 2, 1))], "snapshot_id string, as_of_date date")
    s = rows.select(F.when(F.col("id") % 9 > 0, "s").otherwise("t").alias("snapshot_id"), F.col("id").alias("ticker"), F.col("v").cast("double").alias("score"))
    r = rows.select(F.explode(F.array(F.lit(dt.date(2020, 1, 1)), F.lit(dt.date(2020, 2, 1)))).alias("as_of_date"), F.lit(30).alias("horizon_days"), F.col("id").alias("ticker"), (F.round("x", 1) + F.col("v") / 40).alias("ret"))
    one, two = (sorted(map(tuple, rank_ic.rank_ic(snaps, [30, 90], s, r, window_rows=n).collect()), key=str) for n in (10, 10**6))
    assert len(one) == 4 and [x[:3] + x[4:] for x in one] == [x[:3] + x[4:] for x in two]
    assert all((a[3] is None) == (b[3] is None) and (a[3] is None or abs(a[3] - b[3]) < 1e-12) for a, b in zip(one, two))
    assert sum(x[3] is not None for x in one) == 2


@pytest.mark.parametrize("lag", [1, 7, 60])
def test_as_of_prices_by_merging(spark, lag):
    """Both ways agree, on a crowded ticker and around the borders of the blocks."""
    rng = random.Random(lag)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    prices = [("A" if rng.random() < 0.5 else f"T{rng.randrange(9)}", day(rng.randrange(-30, 2500)), rng.choice([1.0, 2.5, float("inf"), 7.0])) for _ in range(1500)]
    prices += prices[:50] + [("A", day(5), 0.5), ("A", day(5), 9.0)]
    wanted = spark.createDataFrame([(t, day(n)) for t in ("A", "T1", "T2", "none") for n in range(-5, 2520, 3)], "ticker string, target_date date")
    clean = spark.createDataFrame(prices, "ticker string, trade_date date, close double")
    one, two = (sorted((r.ticker, r.target_date, *r.x) for r in f(wanted, clean, lag).collect()) for f in (returns._exploded, returns._merged))
    assert one == two and len(one) > 100
    assert "UnboundedFollowing" not in plan(returns._merged(wanted, clean, lag))


def test_tables_go_with_their_scope(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_dir", lambda spark: str(tmp_path / "shared"))
    there = lambda: sorted(p.name.split("-")[0] for p in (tmp_path / "shared").iterdir())
    kept = lineage.written(rows.limit(3), "kept")
    with lineage.scope(spark):
        lineage.written(rows.limit(2), "outer")
        with pytest.raises(ZeroDivisionError), lineage.scope(spark):
            assert lineage.written(rows.limit(1), "inner").count() == 1
            1 / 0
        assert there() == ["kept", "outer"]
    assert there() == ["kept"] and kept.count() == 3
