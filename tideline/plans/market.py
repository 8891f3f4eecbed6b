"""The supply graph, prices, cross-sections and shocks that the star-schema tables give, and their SQL.

Layers: region, nation, supplier, part, customer. An edge's cost share is its revenue over all revenue into its target, its
substitutability the mean discount on it, its lead time the mean days from order to shipment over 30. Sums are decimals, so that
they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.quality import together

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag(letter: str, key: str) -> F.Column:
    return F.concat(F.lit(f"{letter}:"), F.col(key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    node = lambda df, letter, key, label, layer, kind, ticker=F.lit(None).cast("string"): df.select(tag(letter, key).alias("node_id"), F.col(label).alias("label"), F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), ticker.alias("ticker"))
    return (
        node(t("region"), "R", "r_regionkey", "r_name", 0, "raw")
        .unionByName(node(t("nation"), "N", "n_nationkey", "n_name", 1, "intermediate"))
        .unionByName(node(t("supplier"), "S", "s_suppkey", "s_name", 2, "component"))
        .unionByName(node(t("part"), "P", "p_partkey", "p_name", 3, "subassembly"))
        .unionByName(node(t("customer"), "C", "c_custkey", "c_name", 4, "equity", F.col("c_name")))
    )


NODES_SQL = """
nodes AS (
  SELECT 'R:' || r_regionkey AS node_id, r_name AS label, 0 AS layer, 'raw' AS kind, NULL::VARCHAR AS ticker FROM region
  UNION ALL SELECT 'N:' || n_nationkey, n_name, 1, 'intermediate', NULL FROM nation
  UNION ALL SELECT 'S:' || s_suppkey, s_name, 2, 'component', NULL FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, p_name, 3, 'subassembly', NULL FROM part
  UNION ALL SELECT 'C:' || c_custkey, c_name, 4, 'equity', c_name FROM customer)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their customer, by exact amounts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast(MONEY).alias("amount"), F.col("l_discount").cast(MONEY).alias("discount"), F.to_date("l_shipdate").alias("shipped"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey"), F.to_date("o_orderdate").alias("ordered"))
    return lines.join(orders, "l_orderkey").withColumn("lead", F.greatest(F.datediff("shipped", "ordered"), F.lit(0)))


TRADES_SQL = """
trades AS (
  SELECT l_partkey, l_suppkey, o_custkey, l_extendedprice::DECIMAL(18,2) AS amount, l_discount::DECIMAL(18,2) AS discount, l_shipdate::DATE AS shipped, o_orderdate::DATE AS ordered,
         greatest(date_diff('day', o_orderdate::DATE, l_shipdate::DATE), 0) AS lead
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def edges(spark: SparkSession, sf_dir: str, below: int = 4) -> DataFrame:
    """(source, target, substitutability, cost_share, lead_time_months, source_layer) of the sources in layers under ``below``.

    The trades are written once where several layers need them. An edge's rows are dealt by its target, as two numbers and three
    amounts, so the sums of an edge and the total into a target come from one shuffle; the few rows of suppliers become edges into
    the supplier and into its nation.
    """
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    t = trades(spark, sf_dir).select("l_suppkey", "l_partkey", "o_custkey", "amount", "discount", "lead")
    t = written(t, "trades") if below > 2 else t
    sums = [F.sum("amount").alias("revenue"), F.sum("discount").alias("discounts"), F.sum("lead").alias("leads"), F.count("*").alias("n")]
    again = [F.sum(c).alias(c) for c in ("revenue", "discounts", "leads", "n")]
    suppliers = t.groupBy("l_suppkey").agg(*sums).join(s, "l_suppkey").join(n, "s_nationkey")
    d = lambda c: F.col(c).cast("double")

    def layer(k: int, rows: DataFrame, source: tuple[str, str], target: tuple[str, str], aggs: list) -> DataFrame:
        keys = [source[1], target[1]]
        rows = rows.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())
        flows = rows.select(*keys, *(c for c in rows.columns if c in ("amount", "discount", "lead", "revenue", "discounts", "leads", "n")))
        flows = flows.repartition(keys[1]).groupBy(*keys).agg(*aggs).withColumn("total", F.sum("revenue").over(Window.partitionBy(keys[1])))
        return flows.select(tag(*source).alias("source"), tag(*target).alias("target"), (d("discounts") / d("n")).alias("substitutability"), (d("revenue") / d("total")).alias("cost_share"), (d("leads") / d("n") / 30).alias("lead_time_months"), F.lit(k).alias("source_layer"))

    layers = [
        lambda: layer(0, suppliers, ("R", "n_regionkey"), ("N", "s_nationkey"), again),
        lambda: layer(1, suppliers, ("N", "s_nationkey"), ("S", "l_suppkey"), again),
        lambda: layer(2, t, ("S", "l_suppkey"), ("P", "l_partkey"), sums),
        lambda: layer(3, t, ("P", "l_partkey"), ("C", "o_custkey"), sums),
    ]
    return together([f() for f in layers[:below]])


EDGES_SQL = (
    TRADES_SQL
    + """,
placed AS (SELECT trades.*, s_nationkey, n_regionkey FROM trades JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
flows AS (
  SELECT 'R:' || n_regionkey AS source, 'N:' || s_nationkey AS target, sum(amount) AS revenue, sum(discount) AS discounts, sum(lead) AS leads, count(*) AS n FROM placed GROUP BY ALL
  UNION ALL SELECT 'N:' || s_nationkey, 'S:' || l_suppkey, sum(amount), sum(discount), sum(lead), count(*) FROM placed GROUP BY ALL
  UNION ALL SELECT 'S:' || l_suppkey, 'P:' || l_partkey, sum(amount), sum(discount), sum(lead), count(*) FROM trades GROUP BY ALL
  UNION ALL SELECT 'P:' || l_partkey, 'C:' || o_custkey, sum(amount), sum(discount), sum(lead), count(*) FROM trades GROUP BY ALL),
edges AS (
  SELECT source, target, discounts::DOUBLE / n AS substitutability, revenue::DOUBLE / (sum(revenue) OVER (PARTITION BY target))::DOUBLE AS cost_share, leads::DOUBLE / n / 30 AS lead_time_months,
         (1 - discounts::DOUBLE / n) * (revenue::DOUBLE / (sum(revenue) OVER (PARTITION BY target))::DOUBLE) AS w
  FROM flows)"""
)


def region_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("shock_id"), tag("R", "r_regionkey").alias("node_id"), F.lit(1.0).alias("shock"))


def supplier_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("shock_id"), tag("S", "s_suppkey").alias("node_id"), (F.col("s_acctbal") / 10000).alias("shock"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, trade_date, close): a supplier's price per unit on each day with shipments."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("trade_date"), F.col("l_extendedprice").cast(MONEY).alias("a"), F.col("l_quantity").cast(MONEY).alias("q"))
    return lines.groupBy(tag("S", "l_suppkey").alias("ticker"), "trade_date").agg((F.sum("a").cast("double") / F.sum("q").cast("double")).alias("close"))


PRICES_SQL = """
prices AS (SELECT 'S:' || l_suppkey AS ticker, l_shipdate::DATE AS trade_date, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / sum(l_quantity::DECIMAL(18,2))::DOUBLE AS close FROM lineitem GROUP BY ALL)"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, as_of_date): the first of each month with orders in the backtest window, 1996 to 2000."""
    months = table(spark, sf_dir, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("as_of_date")).distinct()
    return months.where(F.year("as_of_date").between(1996, 2000)).select(F.date_format("as_of_date", "yyyy-MM").alias("snapshot_id"), "as_of_date")


SNAPSHOTS_SQL = """
snapshots AS (SELECT strftime(m, '%Y-%m') AS snapshot_id, m AS as_of_date FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders) WHERE year(m) BETWEEN 1996 AND 2000)"""


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(tag("S", "s_suppkey").alias("ticker"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, ticker, score): the mean discount that a supplier gave on what was ordered in the month before, 0.0 without orders."""
    t = trades(spark, sf_dir).groupBy(F.add_months(F.trunc("ordered", "month"), 1).alias("as_of_date"), tag("S", "l_suppkey").alias("ticker")).agg((F.sum("discount").cast("double") / F.count("*")).alias("value"))
    full = snapshots(spark, sf_dir).crossJoin(universe(spark, sf_dir))
    return full.join(t, ["as_of_date", "ticker"], "left").select("snapshot_id", "ticker", F.round(F.coalesce("value", F.lit(0.0)), 12).alias("score"))


SCORES_SQL = """
monthly AS (SELECT (date_trunc('month', ordered) + INTERVAL 1 MONTH)::DATE AS as_of_date, 'S:' || l_suppkey AS ticker, sum(discount)::DOUBLE / count(*) AS value FROM trades GROUP BY ALL),
scores AS (
  SELECT snapshot_id, as_of_date, 'S:' || s_suppkey AS ticker, round(coalesce(value, 0.0), 12) AS score
  FROM snapshots CROSS JOIN supplier LEFT JOIN monthly USING (as_of_date) WHERE monthly.ticker = 'S:' || s_suppkey
  UNION ALL
  SELECT snapshot_id, as_of_date, 'S:' || s_suppkey, 0.0 FROM snapshots CROSS JOIN supplier
  WHERE NOT EXISTS (SELECT 1 FROM monthly m WHERE m.as_of_date = snapshots.as_of_date AND m.ticker = 'S:' || s_suppkey))"""


def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(as_of_date, ticker, raw_score, log_market_cap, momentum_12m, price_to_book, sector) of the customers, by year of the order.

    Size is the log of the year's spend, momentum the second half's spend over the first's, value comes from the account balance,
    the raw score is the mean discount that the customer got; customers need orders in both halves.
    """
    t = trades(spark, sf_dir).withColumn("year", F.year("ordered"))
    late = F.month("ordered") > 6
    by = t.groupBy("year", F.col("o_custkey").alias("c_custkey")).agg(F.sum("amount").cast("double").alias("spend"), F.sum(F.when(late, F.col("amount"))).cast("double").alias("late"), F.sum(F.when(~late, F.col("amount"))).cast("double").alias("early"), (F.sum("discount").cast("double") / F.count("*")).alias("raw_score"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    df = by.where(F.col("late").isNotNull() & F.col("early").isNotNull()).join(c, "c_custkey")
    return df.select(F.make_date("year", F.lit(12), F.lit(31)).alias("as_of_date"), F.col("c_name").alias("ticker"), "raw_score", F.log("spend").alias("log_market_cap"), (F.col("late") / F.col("early") - 1).alias("momentum_12m"), F.exp(F.col("c_acctbal") / 10000).alias("price_to_book"), F.col("c_mktsegment").alias("sector"))


_YEARLY = """
yearly AS (
  SELECT year(ordered) AS y, o_custkey, sum(amount)::DOUBLE AS spend, (sum(amount) FILTER (month(ordered) > 6))::DOUBLE AS late, (sum(amount) FILTER (month(ordered) <= 6))::DOUBLE AS early,
         sum(discount)::DOUBLE / count(*) AS raw_score
  FROM trades GROUP BY ALL),
panel AS (
  SELECT make_date(y::INT, 12, 31) AS as_of_date, c_name AS ticker, raw_score, ln(spend) AS log_market_cap, late / early - 1 AS momentum_12m, exp(c_acctbal / 10000) AS price_to_book, c_mktsegment AS sector
  FROM yearly JOIN customer ON o_custkey = c_custkey WHERE late IS NOT NULL AND early IS NOT NULL)"""
CROSS_SECTION_SQL = TRADES_SQL + "," + _YEARLY


def yearly_panel_sql() -> str:
    """The cross-sections where the trades are there already."""
    return _YEARLY
