"""Returns, rank IC, factors, neutralization and report queries over the star schema, and their SQL."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import shared_dir, written
from ..operators import factors, neutralize, rank_ic, report, returns
from ..sources import sinks, tables
from . import backtest, weekly
from . import market as m

HORIZONS = (3, 30, 90)
CONFIG = returns.ReturnConfig(horizons=HORIZONS, max_lag=2, buffer=30)
_RETURNS = (
    "WITH "
    + m.PRICES_SQL
    + ","
    + m.SNAPSHOTS_SQL
    + ","
    + m.TRADES_SQL
    + ","
    + m.SCORES_SQL
    + f""",
offsets AS (SELECT unnest([0, {", ".join(map(str, HORIZONS))}]) AS o),
lookups AS (SELECT as_of_date, 'S:' || s_suppkey AS ticker, o, (as_of_date + o::INT)::DATE AS t FROM snapshots CROSS JOIN supplier CROSS JOIN offsets),
found AS (SELECT as_of_date, l.ticker, o, min(trade_date) AS d, arg_min(close, trade_date) AS p FROM lookups l LEFT JOIN prices ON prices.ticker = l.ticker AND trade_date BETWEEN t AND t + 2 GROUP BY ALL),
rets AS (
  SELECT x.as_of_date, x.o AS horizon_days, x.ticker, CASE WHEN e.p > 0 AND x.p > 0 AND x.d > e.d THEN x.p / e.p - 1 END AS ret
  FROM found x JOIN found e ON e.as_of_date = x.as_of_date AND e.ticker = x.ticker AND e.o = 0 WHERE x.o > 0),
pairs AS (SELECT snapshot_id, horizon_days, score, ret FROM scores JOIN rets USING (as_of_date, ticker) WHERE ret IS NOT NULL),
ranked AS (
  SELECT snapshot_id, horizon_days, score, ret, rank() OVER (PARTITION BY snapshot_id, horizon_days ORDER BY score) + (count(*) OVER (PARTITION BY snapshot_id, horizon_days, score) - 1) / 2 AS rs,
         rank() OVER (PARTITION BY snapshot_id, horizon_days ORDER BY ret) + (count(*) OVER (PARTITION BY snapshot_id, horizon_days, ret) - 1) / 2 AS rr FROM pairs),
sums AS (SELECT snapshot_id, horizon_days, count(*) AS n, min(score) = max(score) AS fs, min(ret) = max(ret) AS fr, CASE WHEN min(score) < max(score) AND min(ret) < max(ret) THEN corr(rs, rr) END AS c FROM ranked GROUP BY ALL),
ics AS (
  SELECT snapshot_id, s.as_of_date, o AS horizon_days, coalesce(n, 0)::INT AS n_obs, c AS ic,
         CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient_observations' WHEN fs THEN 'constant_score_cross_section' WHEN fr THEN 'constant_return_cross_section' END AS reason
  FROM snapshots s CROSS JOIN offsets LEFT JOIN sums USING (snapshot_id) WHERE o > 0 AND sums.horizon_days = o
  UNION ALL
  SELECT snapshot_id, s.as_of_date, o, 0, NULL, 'insufficient_observations' FROM snapshots s CROSS JOIN offsets WHERE o > 0 AND NOT EXISTS (SELECT 1 FROM sums WHERE sums.snapshot_id = s.snapshot_id AND sums.horizon_days = o))"""
)


def _returns(spark, d):
    return returns.forward_returns(m.snapshots(spark, d), m.universe(spark, d), m.prices(spark, d), CONFIG)


def _ics(spark, d):
    return rank_ic.rank_ic(m.snapshots(spark, d), list(HORIZONS), m.scores(spark, d), _returns(spark, d))


def forward_returns(spark, d):
    return _returns(spark, d).select("as_of_date", "horizon_days", "ticker", F.round("ret", 6).alias("ret"))


def rank_ics(spark, d):
    return _ics(spark, d).select("snapshot_id", "as_of_date", "horizon_days", F.round("rank_ic", 6).alias("rank_ic"), "n_obs", "reason")


def mean_rank_ic(spark, d):
    return rank_ic.mean_ic(_ics(spark, d)).select("horizon_days", F.round("mean_ic", 6).alias("mean_ic"), "n_snapshots")


def rank_ic_history(spark, d):
    out = report.ic_history(_ics(spark, d), list(HORIZONS))
    return out.select("as_of_date", *[F.round(str(h), 6).alias(f"h{h}") for h in HORIZONS])


def supplier_momentum(spark, d):
    out = factors.momentum(m.prices(spark, d), min_history=50, lookback=120)
    return out.select("ticker", F.round("momentum_12m", 6).alias("momentum_12m"))


def _raw_factors(spark, d):
    """Suppliers by their nation as sector: caps with bad values, momentum with gaps."""
    s = m.table(spark, d, "supplier").join(m.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    base = s.select(F.to_date(F.lit("2001-12-31")).alias("as_of_date"), m.tag("S", "s_suppkey").alias("ticker"), F.concat(F.lit("Sector_"), F.col("n_regionkey").cast("string")).alias("sector"), "s_acctbal", "s_suppkey")
    first = F.when(F.col("s_suppkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    second = F.when(F.col("s_suppkey") % 2 == 0, F.abs("s_acctbal") + 1)
    fundamentals = base.select("as_of_date", "ticker", first.alias("market_cap"), second.alias("market_cap_2"), F.when(F.col("s_suppkey") % 7 > 0, F.col("s_acctbal") / 1000).alias("price_to_book"))
    mom = factors.momentum(m.prices(spark, d), min_history=50, lookback=120).withColumn("as_of_date", F.to_date(F.lit("2001-12-31")))
    return factors.factor_table(base.select("as_of_date", "ticker", "sector"), mom, fundamentals)


RAW = ["market_cap", "momentum_12m", "price_to_book"]


def factor_gaps(spark, d):
    shares = factors.missing_shares(_raw_factors(spark, d), RAW)
    return shares.select("as_of_date", "column", "n", "n_missing", F.round("share", 6).alias("share"), (F.col("share") > 0.1).alias("over_a_tenth"))


def factor_table(spark, d):
    df = factors.impute(_raw_factors(spark, d), RAW)
    flags = F.concat(*[F.col(f"imputed_{c}").cast("int").cast("string") for c in RAW]).alias("imputed")
    return df.select("as_of_date", "ticker", F.round(F.log("market_cap"), 6).alias("log_market_cap"), F.round("momentum_12m", 6).alias("momentum_12m"), F.round("price_to_book", 6).alias("price_to_book"), "sector", flags)


_MOMENTUM = "mom AS (SELECT ticker, CASE WHEN max(n) >= 50 AND max(close) FILTER (rn = 1) > 0 THEN max(close) FILTER (rn = 1) / max(close) FILTER (rn = least(n, 120)) - 1 END AS momentum FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM prices) GROUP BY ticker)"
_RAW = f"""WITH {m.PRICES_SQL}, {_MOMENTUM},
raw AS (
  SELECT DATE '2001-12-31' AS as_of_date, 'S:' || s_suppkey AS ticker, 'Sector_' || n_regionkey AS sector,
         CASE WHEN s_suppkey % 5 <> 0 AND s_acctbal > 0 THEN s_acctbal WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal) + 1 END AS market_cap, momentum AS momentum_12m, CASE WHEN s_suppkey % 7 > 0 THEN s_acctbal / 1000 END AS price_to_book
  FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN mom ON mom.ticker = 'S:' || s_suppkey)"""
_FILL = ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY as_of_date, sector)) AS {c}, ({c} IS NULL)::INT AS i{k}" for k, c in enumerate(RAW))
_FILL2 = ", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY as_of_date)) AS {c}" for c in RAW)


def neutral_alpha(spark, d):
    # Only what the panel needs is computed here; neutralize() adds diagnostics.
    df = neutralize.residuals(written(m.cross_section(spark, d), "cross-section"), neutralize.NeutralizeConfig(), "raw_score")
    cols = ["raw_residual", "winsorized_residual", "reprojected_residual", "alpha_z"]
    return df.select("as_of_date", "ticker", *[F.round(c, 6).alias(c) for c in cols])


def neutral_diagnostics(spark, d):
    out = neutralize.neutralize(m.cross_section(spark, d)).diagnostics
    return out.select("as_of_date", "n", "n_sectors", "reason", "n_columns", "design_rank", F.round("residual_sd", 6).alias("residual_sd"), "n_below", "n_above", (F.abs("alpha_mean") < 1e-10).alias("centred"), (F.abs(F.col("alpha_sd") - 1) < 1e-10).alias("scaled"), (F.col("max_abs_correlation") < 1e-8).alias("neutral"))


def neutral_coefficients(spark, d):
    return neutralize.neutralize(m.cross_section(spark, d)).coefficients.select("as_of_date", "term", F.round("coefficient", 6).alias("coefficient"))


def neutral_correlations(spark, d):
    """Each exposure's correlation with the raw score, and whether alpha is neutral to it."""
    panel = written(m.cross_section(spark, d), "cross-section")
    raw = neutralize.correlations(panel, "raw_score").select("as_of_date", "exposure", F.round("correlation", 6).alias("raw_correlation"))
    alpha = neutralize.neutralize(panel).correlations.select("as_of_date", "exposure", (F.abs("correlation") < 1e-8).alias("alpha_is_neutral"))
    return raw.join(alpha, ["as_of_date", "exposure"])


def neutral_failures(spark, d):
    """The cross-section with a fault planted in each year: the reason of each, and what stays in the panel."""
    p = m.cross_section(spark, d)
    year = F.year("as_of_date")
    first = F.row_number().over(Window.partitionBy("as_of_date").orderBy("ticker"))
    p = p.withColumn("rn", first).where((year != 1995) | (F.col("rn") <= 12))
    p = p.withColumn("raw_score", F.when(year == 1996, F.lit(0.25)).when((year == 1997) & (F.col("rn") == 3), F.lit(float("inf"))).when(year == 2000, 2 * F.col("price_to_book") + 1).otherwise(F.col("raw_score")))
    p = p.withColumn("sector", F.when((year == 1998) & (F.col("rn") == 2), F.lit(" \t")).when(year == 1999, F.lit("ALL")).otherwise(F.col("sector")))
    p = p.withColumn("momentum_12m", F.when(year == 2001, F.lit(0.5)).otherwise(F.col("momentum_12m")))
    out = neutralize.neutralize(p.drop("rn"))
    kept = out.panel.groupBy("as_of_date").agg(F.count("*").alias("n_kept"), F.sum((F.col("alpha_z") != 0).cast("long")).alias("n_moved"))
    return out.diagnostics.join(kept, "as_of_date", "left").select("as_of_date", "n", "reason", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.coalesce("n_moved", F.lit(0)).alias("n_moved"))


def snapshot_faults(spark, d):
    """Monthly snapshots with planted faults: what each check finds."""
    s = m.snapshots(spark, d).withColumn("source_text", F.when(F.month("as_of_date") == 2, F.lit(" \n")).otherwise(F.lit("news")))
    s = s.unionByName(s.where("month(as_of_date) = 3"))
    n = m.nodes(spark, d).where("layer <= 1")
    cands = m.snapshots(spark, d).where("month(as_of_date) <> 4").join(n.where("layer = 1"), F.pmod(F.crc32("node_id"), F.lit(12)) + 1 == F.month("as_of_date"))
    cands = cands.select("snapshot_id", F.concat(F.lit("Candidate_"), F.substring("node_id", 3, 9)).alias("anonymized_id"), F.col("node_id").alias("graph_node_id"))
    five = m.snapshots(spark, d).where("month(as_of_date) = 5")
    odd = [five.select("snapshot_id", F.lit(a).alias("anonymized_id"), F.lit(g).alias("graph_node_id")) for a, g in (("Twice", "N:1"), ("Twice", "N:2"), ("Lost", "?"), ("Listed", "C:1"), ("Old_1999", "N:3"))]
    for x in odd:
        cands = cands.unionByName(x)
    nodes = m.nodes(spark, d)
    config = backtest.BacktestConfig(start_year=1997, end_year=2000, floor_year=1990)
    return backtest.snapshot_violations(s, cands, nodes, config).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("n_entities"))


def given_returns(spark, d):
    """Returns read from a table that lacks a horizon in some months and tickers in others."""
    dates, tickers = m.snapshots(spark, d), m.universe(spark, d)
    number = F.substring("ticker", 3, 9).cast("int")
    full = dates.crossJoin(tickers).withColumn("horizon_days", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))  # the given table's size
    table = full.where(~((F.month("as_of_date") == 6) & (F.col("horizon_days") == 30)) & (number % 7 != F.month("as_of_date") % 7)).select("as_of_date", "horizon_days", "ticker", (number / 1000 + F.col("horizon_days")).alias("ret"))
    lacking = returns.missing_fixture_keys(table, dates, list(HORIZONS)).withColumn("is_lacking", F.lit(True))
    other = rank_ic.missing_horizons(table, dates, list(HORIZONS)).withColumn("provider_lacks", F.lit(True))
    out = returns.fixture_returns(table, dates, tickers, list(HORIZONS))
    sums = out.groupBy("as_of_date", "horizon_days").agg(F.count("*").alias("n"), F.count("ret").alias("n_given"), F.round(F.sum("ret"), 6).alias("total"))
    return sums.join(lacking, ["as_of_date", "horizon_days"], "left").join(other, ["as_of_date", "horizon_days"], "left").select(*sums.columns, F.coalesce("is_lacking", F.lit(False)).alias("is_lacking"), F.coalesce("provider_lacks", F.lit(False)).alias("provider_lacks"))


def walk_forward(spark, d):
    """The whole backtest: a third of the nations is a candidate each New Year, customers are the universe, with prices from their orders."""
    nodes = m.nodes(spark, d)
    snaps = m.table(spark, d, "orders").select(F.trunc(F.to_date("o_orderdate"), "year").alias("as_of_date")).distinct().select(F.date_format("as_of_date", "yyyy").alias("snapshot_id"), "as_of_date", F.concat(F.lit("Notes on SRF in "), F.date_format("as_of_date", "yyyy")).alias("source_text"))
    key = F.substring("node_id", 3, 9).cast("int")
    role = F.element_at(F.array(F.lit("solar glass"), F.lit("transformer core"), F.lit("fluor"), F.lit("other")), key % 4 + 1)
    cands = snaps.join(nodes.where("layer = 1"), (key + F.year("as_of_date")) % 3 == 0).select("snapshot_id", F.concat(F.lit("Candidate_"), key.cast("string")).alias("anonymized_id"), F.col("node_id").alias("graph_node_id"), role.alias("physical_role"))
    config = backtest.BacktestConfig(start_year=1990, end_year=2010, horizons=(180, 365), primary=180, threshold=0.3, floor_year=1990)
    lookup = returns.ReturnConfig(horizons=(180, 365), max_lag=60, buffer=90)
    out = backtest.run(snaps, cands, nodes, written(m.edges(spark, d), "edges"), _customer_prices(spark, d), config=config, return_config=lookup)
    means = out.means.select("horizon_days", F.round("mean_ic", 6).alias("mean_ic"))
    return out.ics.join(means, "horizon_days").select("snapshot_id", "as_of_date", "horizon_days", F.round("rank_ic", 6).alias("rank_ic"), "n_obs", "reason", "mean_ic")


def _customer_prices(spark, d):
    """A customer's mean order value on each day with orders."""
    o = m.table(spark, d, "orders").join(m.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return o.groupBy(F.col("c_name").alias("ticker"), F.to_date("o_orderdate").alias("trade_date")).agg((F.sum(F.col("o_totalprice").cast(m.MONEY)).cast("double") / F.count("*")).alias("close"))


def factor_faults(spark, d):
    """The factor table with doubled tickers, and columns of which over a tenth is missing."""
    df = factors.finished(factors.impute(_raw_factors(spark, d), RAW))
    twice = df.unionByName(df.where(F.substring("ticker", 3, 9).cast("int") % 10 == 0))
    gate = factors.missing_gate(factors.missing_shares(_raw_factors(spark, d), RAW), limit=0.1)
    lacking = factors.frame_violations(df.drop("sector"))
    return factors.frame_violations(twice).unionByName(gate.withColumn("detail", F.lit("")).select("rule", "entity", "detail")).unionByName(lacking)


def _neutral_2000(spark, d):
    return neutralize.neutralize(m.cross_section(spark, d).where("year(as_of_date) = 2000"))


def output_faults(spark, d):
    """The output check on an alpha table with doubled tickers and values that are no numbers.

    What is checked is the output of one run, in which a ticker stands once: the whole cross-section of the last full year.
    """
    a = _neutral_2000(spark, d).panel.join(m.table(spark, d, "customer").select(F.col("c_name").alias("ticker"), "c_custkey"), "ticker")
    k = F.col("c_custkey")
    a = a.withColumn("alpha_z", F.when(k % 50 == 0, float("nan")).otherwise(F.col("alpha_z"))).withColumn("price_to_book", F.when(k % 40 == 0, float("-inf")).otherwise(F.col("price_to_book")))
    a = a.unionByName(a.where(k % 60 == 0))
    same = {f.name: F.lit(None) for f in weekly.OUTPUT if f.name not in a.columns}
    out = weekly.output_violations(a.withColumns(same).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in weekly.OUTPUT]))
    return out.groupBy("rule", "entity", "detail").agg(F.count("*").alias("n"))


def report_table(spark, d):
    """The report's seven columns, with the pair of raw and neutral values beside them.

    A report shows the output of one run, which is one cross-section: the whole one of the last full year.
    """
    a = _neutral_2000(spark, d).panel
    pair = report.raw_against_neutral(a).select("ticker", F.round(F.col("alpha_z") - F.col("raw_score"), 6).alias("moved"))
    v = report.alpha_view(a).join(pair, "ticker")
    return v.select("ticker", "sector", *[F.round(c, 6).alias(c) for c in ("raw_score", "alpha_z", "log_market_cap", "momentum_12m", "price_to_book")], "moved")


def report_files(spark, d):
    """Tables and metadata written twice and read back by the report, with and without a rank-IC history."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    c = m.table(spark, d, "customer").select(F.col("c_name").alias("ticker"), F.col("c_acctbal").alias("alpha_z"))
    for part in (c.where("alpha_z < 0"), c):
        sinks.commit_table(part, f"{path}/alpha")
        sinks.commit_metadata(part.agg(F.count("*").alias("n"), F.lit("ok").alias("a_status")), f"{path}/meta")
    sinks.write_table(m.snapshots(spark, d).select("as_of_date", F.lit(30).alias("horizon_days"), F.lit(0.5).alias("rank_ic")), f"{path}/ics")
    alpha, meta, ics, _ = tables.read_report(spark, f"{path}/alpha", f"{path}/meta", f"{path}/ics")
    lost = tables.read_report(spark, f"{path}/alpha", f"{path}/meta", f"{path}/none")[3]
    odd = tables.read_report(spark, f"{path}/alpha", f"{path}/meta", f"{path}/alpha")[3]
    one = meta.select("a_status", "n").crossJoin(ics.agg(F.count("*").alias("n_ics")))  # one row each
    return alpha.crossJoin(F.broadcast(one)).select("ticker", "alpha_z", "a_status", "n", "n_ics", F.lit(lost.split(":")[0]).alias("lost"), F.lit(odd).alias("odd"))


def _step(name: str, source: str, y: str) -> str:
    zs = ("z0", "z1", "z2")
    dz = [f"(z{i} - m{i})" for i in range(3)]
    s = ", ".join(f"sum({dz[i]} * {dz[j]}) AS s{i}{j}" for i in range(3) for j in range(i, 3))
    t = ", ".join(f"sum({dz[i]} * ({y} - my)) AS t{i}" for i in range(3))
    det = "(s00*(s11*s22-s12*s12) - s01*(s01*s22-s12*s02) + s02*(s01*s12-s11*s02))"
    b = [
        f"(t0*(s11*s22-s12*s12) - s01*(t1*s22-s12*t2) + s02*(t1*s12-s11*t2)) / {det}",
        f"(s00*(t1*s22-t2*s12) - t0*(s01*s22-s12*s02) + s02*(s01*t2-t1*s02)) / {det}",
        f"(s00*(s11*t2-s12*t1) - s01*(s01*t2-t1*s02) + t0*(s01*s12-s11*s02)) / {det}",
    ]
    return f"""
{name}_m AS (SELECT *, avg({y}) OVER g AS my, {", ".join(f"avg({z}) OVER g AS m{i}" for i, z in enumerate(zs))} FROM {source} WINDOW g AS (PARTITION BY as_of_date, sector)),
{name}_s AS (SELECT as_of_date, {s}, {t} FROM {name}_m GROUP BY as_of_date),
{name}_b AS (SELECT as_of_date, {", ".join(f"{x} AS b{i}" for i, x in enumerate(b))} FROM {name}_s),
{name} AS (SELECT p.* EXCLUDE (my, m0, m1, m2), p.my AS {name}_my, p.m0 AS {name}_m0, p.m1 AS {name}_m1, p.m2 AS {name}_m2, b0 AS {name}_b0, b1 AS {name}_b1, b2 AS {name}_b2, {y} - my - b0 * {dz[0]} - b1 * {dz[1]} - b2 * {dz[2]} AS {name}_r FROM {name}_m p JOIN {name}_b USING (as_of_date))"""


_Z = ", ".join(f"({c} - avg({c}) OVER d) / stddev_pop({c}) OVER d AS z{i}" for i, c in enumerate(factors.FACTORS))



def neutral_sql(tables: str, panel: str) -> str:
    """``final``: the rows of ``panel`` with their residuals, bounds and alpha."""
    return f"""WITH {tables},
z AS (SELECT *, {_Z} FROM {panel} WINDOW d AS (PARTITION BY as_of_date)),{_step("p1", "z", "raw_score")},
bounded AS (SELECT *, avg(p1_r) OVER d AS rm, stddev_pop(p1_r) OVER d AS rs FROM p1 WINDOW d AS (PARTITION BY as_of_date)),
w AS (SELECT *, greatest(rm - 3 * rs, least(rm + 3 * rs, p1_r)) AS clipped FROM bounded),{_step("p2", "w", "clipped")},
final AS (SELECT *, (p2_r - avg(p2_r) OVER d) / stddev_pop(p2_r) OVER d AS alpha FROM p2 WINDOW d AS (PARTITION BY as_of_date))"""


_NEUTRAL = neutral_sql(m.CROSS_SECTION_SQL, "panel")


def alpha_histogram(spark, d):
    df = neutralize.residuals(written(m.cross_section(spark, d), "cross-section"), neutralize.NeutralizeConfig(), "raw_score")
    return report.histogram(df, F.round("alpha_z", 6), by=["as_of_date"], bins=40)


def headline(spark, d):
    """Figures of the raw score and of alpha."""
    df = neutralize.residuals(written(m.cross_section(spark, d), "cross-section"), neutralize.NeutralizeConfig(), "raw_score")
    raw = report.headline(df, F.col("raw_score"), by=["as_of_date"]).select("as_of_date", "n_rows", F.round("mean", 6).alias("raw_mean"), F.round("population_sd", 6).alias("raw_sd"))
    alpha = report.headline(df, F.col("alpha_z"), by=["as_of_date"]).select("as_of_date", (F.abs("mean") < 1e-9).alias("centred"), F.round("population_sd", 6).alias("alpha_sd"))
    return raw.join(alpha, "as_of_date")


QUERIES = {f.__name__: f for f in (forward_returns, rank_ics, mean_rank_ic, rank_ic_history, supplier_momentum, factor_gaps, factor_table, neutral_alpha, neutral_diagnostics, neutral_coefficients, neutral_correlations, neutral_failures, snapshot_faults, given_returns, walk_forward, factor_faults, output_faults, report_table, report_files, alpha_histogram, headline)}
_GAPS = " UNION ALL ".join(f"SELECT as_of_date, '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS n_missing FROM raw GROUP BY as_of_date" for c in RAW)
_TERMS = " UNION ALL ".join(f"SELECT as_of_date, 'z_{c}' AS term, any_value(p1_b{i}) AS coefficient FROM e GROUP BY as_of_date" for i, c in enumerate(factors.FACTORS))
_CORR = " UNION ALL ".join(f"SELECT as_of_date, '{c}' AS exposure, corr(raw_score, {c}) AS r, corr(alpha, {c}) AS a FROM final GROUP BY as_of_date" for c in factors.FACTORS)
# Months without a candidate: the fourth, and those to which no nation's checksum falls.
_MONTH_OF = [zlib.crc32(f"N:{i}".encode()) % 12 + 1 for i in range(25)]
_BARE = ", ".join(str(i) for i in range(1, 13) if i == 4 or (i not in _MONTH_OF and i != 5))
ORACLES = {
    "forward_returns": f"{_RETURNS} SELECT as_of_date, horizon_days, ticker, round(ret, 6) AS ret FROM rets",
    "rank_ics": f"{_RETURNS} SELECT snapshot_id, as_of_date, horizon_days, round(CASE WHEN reason IS NULL THEN ic END, 6) AS rank_ic, n_obs, reason FROM ics",
    "mean_rank_ic": f"{_RETURNS} SELECT horizon_days, round(avg(CASE WHEN reason IS NULL THEN ic END), 6) AS mean_ic, count(CASE WHEN reason IS NULL THEN ic END) AS n_snapshots FROM ics GROUP BY horizon_days",
    "rank_ic_history": f"{_RETURNS} SELECT as_of_date, {', '.join(f'round(max(CASE WHEN horizon_days = {h} AND reason IS NULL THEN ic END), 6) AS h{h}' for h in HORIZONS)} FROM ics GROUP BY as_of_date",
    "supplier_momentum": f"WITH {m.PRICES_SQL}, {_MOMENTUM} SELECT ticker, round(momentum, 6) AS momentum_12m FROM mom",
    "factor_gaps": f'{_RAW} SELECT as_of_date, "column", n, n_missing, round(n_missing / n, 6) AS share, n_missing / n > 0.1 AS over_a_tenth FROM ({_GAPS})',
    "factor_table": f"{_RAW}, f1 AS (SELECT as_of_date, ticker, sector, {_FILL} FROM raw), f2 AS (SELECT as_of_date, ticker, sector, i0, i1, i2, {_FILL2} FROM f1) SELECT as_of_date, ticker, round(ln(market_cap), 6) AS log_market_cap, round(momentum_12m, 6) AS momentum_12m, round(price_to_book, 6) AS price_to_book, sector, i0 || '' || i1 || '' || i2 AS imputed FROM f2",
    "neutral_alpha": f"{_NEUTRAL} SELECT as_of_date, ticker, round(p1_r, 6) AS raw_residual, round(clipped, 6) AS winsorized_residual, round(p2_r, 6) AS reprojected_residual, round(alpha, 6) AS alpha_z FROM final",
    "neutral_diagnostics": f"{_NEUTRAL} SELECT as_of_date, count(*) AS n, count(DISTINCT sector) AS n_sectors, NULL::VARCHAR AS reason, (3 + count(DISTINCT sector))::INT AS n_columns, (3 + count(DISTINCT sector))::INT AS design_rank, round(any_value(rs), 6) AS residual_sd, count(*) FILTER (p1_r < rm - 3 * rs) AS n_below, count(*) FILTER (p1_r > rm + 3 * rs) AS n_above, true AS centred, true AS scaled, true AS neutral FROM final GROUP BY as_of_date",
    "neutral_coefficients": f"""{_NEUTRAL}, e AS (SELECT as_of_date, sector, any_value(p1_my - p1_b0 * p1_m0 - p1_b1 * p1_m1 - p1_b2 * p1_m2) AS effect, any_value(p1_b0) AS p1_b0, any_value(p1_b1) AS p1_b1, any_value(p1_b2) AS p1_b2 FROM p1 GROUP BY ALL),
        base AS (SELECT as_of_date, min(sector) AS sector, arg_min(effect, sector) AS base FROM e GROUP BY as_of_date)
        SELECT as_of_date, term, round(coefficient, 6) AS coefficient FROM (SELECT as_of_date, 'intercept' AS term, base AS coefficient FROM base UNION ALL {_TERMS}
        UNION ALL SELECT as_of_date, 'sector[' || e.sector || ']', effect - base FROM e JOIN base USING (as_of_date) WHERE e.sector <> base.sector)""",
    "neutral_correlations": f"""{_NEUTRAL} SELECT as_of_date, exposure, round(r, 6) AS raw_correlation, abs(a) < 1e-8 AS alpha_is_neutral FROM ({_CORR}
        UNION ALL SELECT p.as_of_date, 'sector[' || s.sector || ']', corr(raw_score, (p.sector = s.sector)::INT), corr(alpha, (p.sector = s.sector)::INT) FROM final p JOIN (SELECT DISTINCT as_of_date, sector FROM panel) s ON s.as_of_date = p.as_of_date GROUP BY ALL)""",
    "neutral_failures": f"""WITH {m.CROSS_SECTION_SQL} SELECT as_of_date, n, reason, CASE WHEN reason IS NULL OR reason = 'no_signal' THEN n ELSE 0 END AS n_kept, CASE WHEN reason IS NULL THEN n ELSE 0 END AS n_moved FROM (
        SELECT as_of_date, CASE WHEN year(as_of_date) = 1995 THEN least(count(*), 12) ELSE count(*) END AS n, CASE year(as_of_date) WHEN 1995 THEN 'too_few_rows' WHEN 1996 THEN 'no_signal' WHEN 1997 THEN 'non_finite_value' WHEN 1998 THEN 'blank_sector' WHEN 1999 THEN 'one_sector' WHEN 2000 THEN 'degenerate_residual' WHEN 2001 THEN 'constant_factor:momentum_12m' END AS reason FROM panel GROUP BY as_of_date)""",
    "snapshot_faults": f"""WITH {m.SNAPSHOTS_SQL}, s AS (SELECT *, month(as_of_date) AS mo, year(as_of_date) AS y FROM snapshots), again AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE mo = 3)
        SELECT rule, count(*) AS n, count(DISTINCT entity) AS n_entities FROM (
        SELECT 'outside_window' AS rule, snapshot_id AS entity FROM again WHERE y < 1997 UNION ALL SELECT 'blank_text', snapshot_id FROM again WHERE mo = 2 UNION ALL SELECT 'duplicate_snapshot', snapshot_id FROM s WHERE mo = 3
        UNION ALL SELECT r, snapshot_id || ':' || r FROM s, (SELECT unnest(['duplicate_candidate', 'unknown_node', 'terminal_node', 'unsafe_alias']) AS r) WHERE mo = 5
        UNION ALL SELECT 'no_candidate', snapshot_id FROM again WHERE mo IN ({_BARE})) GROUP BY rule""",
    "given_returns": f"""WITH {m.SNAPSHOTS_SQL}, g AS (SELECT as_of_date, h AS horizon_days, s_suppkey AS k, month(as_of_date) AS mo FROM snapshots, supplier, (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS h))
        SELECT as_of_date, horizon_days, count(*) AS n, count(*) FILTER (given) AS n_given, round(sum(k / 1000 + horizon_days) FILTER (given), 6) AS total, NOT bool_or(given) AS is_lacking, NOT bool_or(given) AS provider_lacks
        FROM (SELECT *, NOT (mo = 6 AND horizon_days = 30) AND k % 7 <> mo % 7 AS given FROM g) GROUP BY ALL""",
    "walk_forward": f"""WITH {m.EDGES_SQL}, snaps AS (SELECT DISTINCT date_trunc('year', o_orderdate)::DATE AS as_of_date FROM orders),
        h0 AS (SELECT as_of_date AS t, 'N:' || n_nationkey AS node_id, [0.92, 0.71, 0.5, 0.235][n_nationkey % 4 + 1]::DOUBLE AS shock FROM snaps, nation WHERE (n_nationkey + year(as_of_date)) % 3 = 0 AND n_nationkey % 4 < 3),
        h1 AS (SELECT t, target AS node_id, sum(shock * w) AS shock FROM h0 JOIN edges ON node_id = source GROUP BY ALL), h2 AS (SELECT t, target AS node_id, sum(shock * w) AS shock FROM h1 JOIN edges ON node_id = source GROUP BY ALL),
        h3 AS (SELECT t, target AS node_id, sum(shock * w) AS shock FROM h2 JOIN edges ON node_id = source GROUP BY ALL),
        section AS (SELECT as_of_date, c_name AS ticker, round(coalesce(shock, 0.0), 12) AS score FROM snaps CROSS JOIN customer LEFT JOIN h3 ON h3.t = as_of_date AND h3.node_id = 'C:' || c_custkey),
        prices AS (SELECT c_name AS ticker, o_orderdate::DATE AS trade_date, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        lookups AS (SELECT as_of_date, c_name AS ticker, o, (as_of_date + o::INT)::DATE AS t FROM snaps, customer, (SELECT unnest([0, 180, 365]) AS o)),
        found AS (SELECT as_of_date, l.ticker, o, min(trade_date) AS d, arg_min(close, trade_date) AS p FROM lookups l JOIN prices ON prices.ticker = l.ticker AND trade_date BETWEEN t AND t + 60 GROUP BY ALL),
        pairs AS (SELECT as_of_date, x.o AS h, score, x.p / e.p - 1 AS ret FROM found x JOIN found e USING (as_of_date, ticker) JOIN section USING (as_of_date, ticker) WHERE e.o = 0 AND x.o > 0 AND e.p > 0 AND x.p > 0 AND x.d > e.d),
        ranked AS (SELECT *, rank() OVER (PARTITION BY as_of_date, h ORDER BY score) + (count(*) OVER (PARTITION BY as_of_date, h, score) - 1) / 2 AS rs, rank() OVER (PARTITION BY as_of_date, h ORDER BY ret) + (count(*) OVER (PARTITION BY as_of_date, h, ret) - 1) / 2 AS rr FROM pairs),
        sums AS (SELECT as_of_date, h, count(*) AS n, min(score) = max(score) AS fs, min(ret) = max(ret) AS fr, CASE WHEN min(score) < max(score) AND min(ret) < max(ret) THEN corr(rs, rr) END AS c FROM ranked GROUP BY ALL),
        ics AS (SELECT s.as_of_date, k.h, coalesce(n, 0)::INT AS n_obs, CASE WHEN coalesce(n, 0) < 3 THEN 'insufficient_observations' WHEN fs THEN 'constant_score_cross_section' WHEN fr THEN 'constant_return_cross_section' END AS reason, c
          FROM snaps s CROSS JOIN (SELECT unnest([180, 365]) AS h) k LEFT JOIN sums ON sums.as_of_date = s.as_of_date AND sums.h = k.h)
        SELECT strftime(as_of_date, '%Y') AS snapshot_id, as_of_date, h AS horizon_days, round(CASE WHEN reason IS NULL THEN c END, 6) AS rank_ic, n_obs, reason, round(avg(CASE WHEN reason IS NULL THEN c END) OVER (PARTITION BY h), 6) AS mean_ic FROM ics""",
    "factor_faults": f"""{_RAW} SELECT 'duplicate_ticker' AS rule, '2001-12-31:' || ticker AS entity, '2' AS detail FROM raw WHERE substr(ticker, 3)::INT % 10 = 0
        UNION ALL SELECT 'too_many_missing', '2001-12-31:' || "column", '' FROM ({_GAPS}) WHERE n_missing / n > 0.1 UNION ALL SELECT 'missing_column', 'sector', ''""",
    "output_faults": f"""WITH {m.CROSS_SECTION_SQL}, a AS (SELECT ticker, c_custkey AS k FROM panel JOIN customer ON ticker = c_name WHERE year(as_of_date) = 2000), b AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE k % 60 = 0)
        SELECT rule, entity, detail, count(*) AS n FROM (SELECT DISTINCT 'duplicate_ticker' AS rule, ticker AS entity, '' AS detail FROM a WHERE k % 60 = 0 UNION ALL SELECT 'non_finite', ticker, 'alpha_z' FROM b WHERE k % 50 = 0 UNION ALL SELECT 'non_finite', ticker, 'price_to_book' FROM b WHERE k % 40 = 0) GROUP BY ALL""",
    "report_table": f"""{_NEUTRAL} SELECT ticker, sector, round(raw_score, 6) AS raw_score, round(alpha, 6) AS alpha_z, round(log_market_cap, 6) AS log_market_cap, round(momentum_12m, 6) AS momentum_12m, round(price_to_book, 6) AS price_to_book, round(alpha - raw_score, 6) AS moved FROM final WHERE year(as_of_date) = 2000""",
    "report_files": f"""WITH {m.SNAPSHOTS_SQL} SELECT c_name AS ticker, c_acctbal AS alpha_z, 'ok' AS a_status, (SELECT count(*) FROM customer) AS n, (SELECT count(*) FROM snapshots) AS n_ics, 'no rank-IC history' AS lost, 'rank-IC history lacks as_of_date, horizon_days, rank_ic' AS odd FROM customer""",
    "alpha_histogram": f"""{_NEUTRAL}, v AS (SELECT as_of_date, round(alpha, 6) AS x FROM final), b AS (SELECT as_of_date, min(x) AS lo, max(x) AS hi FROM v GROUP BY as_of_date)
        SELECT as_of_date, least(floor((x - lo) / (hi - lo) * 40)::INT, 39) AS bin, count(*) AS n FROM v JOIN b USING (as_of_date) GROUP BY ALL""",
    "headline": f"{_NEUTRAL} SELECT as_of_date, count(*) AS n_rows, round(avg(raw_score), 6) AS raw_mean, round(stddev_pop(raw_score), 6) AS raw_sd, true AS centred, round(stddev_pop(alpha), 6) AS alpha_sd FROM final GROUP BY as_of_date",
}
