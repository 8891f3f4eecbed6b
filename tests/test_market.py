"""Forward returns, rank IC, factors, neutralization."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import factors, neutralize, rank_ic, report, returns

D = dt.date


def prices(spark, rows):
    return spark.createDataFrame(rows, "ticker string, trade_date date, close double")


@pytest.mark.parametrize(
    ("rows", "config", "expected"),
    [
        ([("A", D(2020, 1, 3), 100.0), ("A", D(2020, 1, 6), 105.0)], returns.ReturnConfig(horizons=(2,)), 0.05),
        ([("A", D(2020, 1, 3), 100.0), ("A", D(2020, 1, 20), 110.0)], returns.ReturnConfig(horizons=(5,), max_lag=3), None),
        ([("A", D(2020, 1, 3), 100.0), ("A", D(2020, 1, 5), float("inf")), ("A", D(2020, 1, 6), 110.0)], returns.ReturnConfig(horizons=(2,)), None),
        ([("A", D(2020, 1, 3), 100.0), ("A", D(2020, 1, 5), float("nan")), ("A", D(2020, 1, 6), 110.0)], returns.ReturnConfig(horizons=(2,)), 0.1),
        ([("A", D(2020, 1, 6), 100.0)], returns.ReturnConfig(horizons=(2,)), None),
        ([("A", D(2020, 1, 3), -1.0), ("A", D(2020, 1, 5), 2.0)], returns.ReturnConfig(horizons=(2,)), None),
    ],
)
def test_forward_returns(spark, rows, config, expected):
    dates = spark.createDataFrame([(D(2020, 1, 3),)], "as_of_date date")
    tickers = spark.createDataFrame([("A",), ("A",)], "ticker string")
    out = returns.forward_returns(dates, tickers, prices(spark, rows), config).collect()
    assert len(out) == 1 and out[0].ret == (expected if expected is None else pytest.approx(expected, abs=1e-12))


def test_config_checks():
    for bad in ({"horizons": ()}, {"horizons": (0,)}, {"entry_lag": -1}, {"max_lag": 0}, {"max_lag": 40}):
        with pytest.raises(ValueError):
            returns.ReturnConfig(**bad)


def ics(spark, score, ret, **kw):
    snaps = spark.createDataFrame([("s", D(2020, 1, 1))], "snapshot_id string, as_of_date date")
    s = spark.createDataFrame([("s", t, float(v)) for t, v in score.items()], "snapshot_id string, ticker string, score double")
    r = spark.createDataFrame([(D(2020, 1, 1), 90, t, v) for t, v in ret.items()], "as_of_date date, horizon_days int, ticker string, ret double")
    return rank_ic.rank_ic(snaps, [90], s, r, **kw).first()


def test_rank_ic(spark):
    x = ics(spark, {"A": 3, "B": 2, "C": 1, "D": 0}, {"A": 0.3, "B": None, "C": 0.1, "D": 0.0})
    assert (x.n_obs, x.reason) == (3, None) and x.rank_ic == pytest.approx(1.0)
    assert ics(spark, {"A": 1, "B": 1, "C": 1}, {"A": 0.3, "B": 0.2, "C": 0.1}).reason == "constant_score_cross_section"
    assert ics(spark, {"A": 1, "B": 2, "C": 3}, {"A": 0.1, "B": 0.1, "C": 0.1}).reason == "constant_return_cross_section"
    assert ics(spark, {"A": 1, "B": 2}, {"A": 0.1, "B": 0.2}).reason == "insufficient_observations"
    # one of six moved, the others tied at zero
    x = ics(spark, {"A": 0.5, "B": 0, "C": 0, "D": 0, "E": 0, "F": 0}, {"A": 0.9, "B": 0.5, "C": 0.4, "D": 0.3, "E": 0.2, "F": 0.1})
    assert x.rank_ic == pytest.approx(0.6546536707079772, abs=1e-12)


def closes(n, by="A"):
    return [(by, D(2020, 1, 1) + dt.timedelta(days=i), 100.0 + i) for i in range(n)]


@pytest.mark.parametrize(("n", "base"), [(199, None), (200, 0), (253, 0), (254, 1), (300, 47)])
def test_momentum(spark, n, base):
    x = factors.momentum(prices(spark, closes(n))).first().momentum_12m
    assert x == (None if base is None else pytest.approx((100 + n - 1) / (100 + base) - 1, abs=1e-12))


def test_imputation(spark):
    nan = float("nan")
    rows = [("d", "A", "x", 1.0), ("d", "B", "x", 3.0), ("d", "C", "x", nan), ("d", "E", "y", None), ("d", "F", "z", 9.0)]
    t = spark.createDataFrame(rows, "as_of_date string, ticker string, sector string, v double")
    got = {r.ticker: (r.v, r.imputed_v) for r in factors.impute(t, ["v"]).collect()}
    # the sector's median first, then the median of all, the filled one included: 1 2 3 9
    assert got == {"A": (1.0, False), "B": (3.0, False), "C": (2.0, True), "E": (2.5, True), "F": (9.0, False)}
    share = factors.missing_shares(t, ["v"]).first()
    assert (share.n, share.n_missing, share.share) == (5, 2, 0.4)
    assert factors.missing_gate(factors.missing_shares(t, ["v"])).count() == 1
    none = spark.createDataFrame([("d", "A", "x", None)], t.schema)
    assert factors.unfilled(factors.impute(none, ["v"]), ["v"]).count() == 1


def test_caps(spark):
    t = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (float("nan"), 0.0), (float("inf"), 5.0)], "a double, b double")
    assert [r.c for r in t.select(factors.clean_cap(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 2.0, None, 5.0]


def panel(days=2, n=500, seed=3, **changes):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        effect = [rng.gauss(0, 0.5) for _ in range(10)]
        for i in range(n):
            size = rng.gauss(10, 1.2)
            mom, value, s = 0.3 * size + rng.gauss(0, 1), math.exp(rng.gauss(0.8, 0.45)), i % 10
            raw = 0.85 * size - 0.6 * mom + 0.4 * value + effect[s] + rng.gauss(0, 0.35) + {7: 8.0, 77: -7.0, 177: 9.0}.get(i, 0.0)
            rows.append([D(2024, 1, 1 + d), f"T{i:03d}", raw, size, mom, value, f"Sector {s}"])
    return rows


COLUMNS = "as_of_date date, ticker string, raw_score double, log_market_cap double, momentum_12m double, price_to_book double, sector string"


def test_neutrality(spark):
    out = neutralize.neutralize(spark.createDataFrame(panel(), COLUMNS))
    assert out.panel.count() == 1000
    for d in out.diagnostics.collect():
        assert d.reason is None and d.max_abs_correlation < 1e-10 and abs(d.alpha_mean) < 1e-12 and abs(d.alpha_sd - 1) < 1e-12
        assert d.n_below >= 1 and d.n_above >= 2 and d.design_rank == d.n_columns == 13 and d.condition_number < 1e10
        assert d.upper == pytest.approx(d.residual_mean + 3 * d.residual_sd)
    clipped = out.panel.where("winsorized_residual <> raw_residual").count()
    assert 0 < clipped < 50
    terms = {r.term for r in out.coefficients.collect()}
    assert {"intercept", "z_log_market_cap", "z_momentum_12m", "z_price_to_book", "sector[Sector 9]"} <= terms and "sector[Sector 0]" not in terms
    raw = neutralize.correlations(spark.createDataFrame(panel(), COLUMNS), "raw_score").agg(F.max(F.abs("correlation"))).first()[0]
    assert raw > 0.2  # the exposure was there


def test_regression_matches_full_least_squares(spark):
    import numpy as np

    rows = panel(days=1, n=120)
    out = neutralize.neutralize(spark.createDataFrame(rows, COLUMNS))
    x = np.array([r[3:6] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    dummies = np.array([[r[6] == f"Sector {s}" for s in range(1, 10)] for r in rows], float)
    a = np.c_[np.ones(len(rows)), z, dummies]
    y = np.array([r[2] for r in rows])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    got = {r.ticker: r.raw_residual for r in out.panel.collect()}
    assert max(abs(got[r[1]] - e) for r, e in zip(rows, y - a @ beta)) < 1e-11
    coef = {r.term: r.coefficient for r in out.coefficients.collect()}
    names = ["intercept", "z_log_market_cap", "z_momentum_12m", "z_price_to_book", *[f"sector[Sector {s}]" for s in range(1, 10)]]
    assert max(abs(coef[n] - b) for n, b in zip(names, beta)) < 1e-10
    assert out.diagnostics.first().condition_number == pytest.approx(np.linalg.cond(a), rel=1e-8)


def spoiled(kind):
    rows = panel(days=2, n=60)
    bad = [r for r in rows if r[0] == D(2024, 1, 2)]
    if kind == "duplicate_key":
        bad[0][1] = bad[1][1]
    elif kind == "too_few_rows":
        rows = [r for r in rows if r[0] != D(2024, 1, 2)] + bad[:20]
    elif kind == "non_finite_value":
        bad[0][3] = float("inf")
    elif kind == "blank_sector":
        bad[0][6] = "  "
    elif kind == "one_sector":
        for r in bad:
            r[6] = "S"
    elif kind == "constant_factor:price_to_book":
        for r in bad:
            r[5] = 2.0
    elif kind == "rank_deficient":
        for r in bad:
            r[4] = r[3]
    elif kind == "null_key":
        bad[0][1] = None
    elif kind == "no_signal":
        for r in bad:
            r[2] = 1.5
    return rows


@pytest.mark.parametrize("kind", ["duplicate_key", "too_few_rows", "non_finite_value", "blank_sector", "one_sector", "constant_factor:price_to_book", "rank_deficient", "null_key", "no_signal"])
def test_a_bad_date_fails_alone(spark, kind):
    out = neutralize.neutralize(spark.createDataFrame(spoiled(kind), COLUMNS))
    reasons = {r.as_of_date.day: r.reason for r in out.diagnostics.collect()}
    assert reasons[1] is None and reasons[2] == kind
    left = out.panel.where(F.col("as_of_date") == D(2024, 1, 2))
    assert left.count() == (60 if kind == "no_signal" else 0)
    if kind == "no_signal":
        assert left.where("alpha_z <> 0").count() == 0


def test_missing_column(spark):
    with pytest.raises(Exception, match="momentum_12m"):
        neutralize.check(spark.createDataFrame(panel(1, 60), COLUMNS).drop("momentum_12m"), neutralize.NeutralizeConfig())


def test_histogram(spark):
    t = spark.createDataFrame([(float(i),) for i in range(81)], "v double")
    got = {r.bin: r.n for r in report.histogram(t, F.col("v")).collect()}
    assert sum(got.values()) == 81 and got[39] == 3 and max(got) == 39
    assert report.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), F.col("v")).collect()[0].n == 3


def test_universe_and_ic_history(spark):
    u = factors.synthetic_universe(spark, 60, seeds=("A.NS", "B.NS"))
    assert u.count() == 60 and u.select("ticker").distinct().count() == 60 and u.where("ticker = 'B.NS'").count() == 1
    with pytest.raises(ValueError):
        factors.synthetic_universe(spark, 10)
    h = report.ic_history(spark.createDataFrame([(D(2020, 1, 1), 30, 0.5), (D(2020, 1, 1), 90, None)], "as_of_date date, horizon_days int, rank_ic double"), [30, 90]).first()
    assert h["30"] == 0.5 and h["90"] is None


def test_rank_by_a_tree_of_factors(spark):
    """R's stacked level by level give the rank and condition number of the whole design."""
    df = spark.createDataFrame(panel(days=2, n=300), "as_of_date date, ticker string, raw_score double, z0 double, z1 double, z2 double, sector string").repartition(40)
    one, two = (sorted(map(tuple, neutralize.design_rank(df, ["z0", "z1", "z2"], fan_in=k).collect())) for k in (3, 1000))
    assert len(one) == 2 and all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) for a, b in zip(one, two))
