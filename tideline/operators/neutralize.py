"""Cross-sectional neutralization: OLS residual against three factors and sectors, winsorized, projected again, z-scored.

A cross-section is all rows of one ``as_of_date``. Sector dummies are never built: demeaning within sectors removes them
(Frisch-Waugh), which leaves three normal equations per date, made from group sums. Every step is a partial aggregate by (date) or
(date, sector) whose small result is joined back, so the panel itself is never shuffled, and one huge date is summed in parallel
like many small ones. The panel is written once before the passes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import written
from ..functions.quality import finite, missing
from ..functions.strings import strip
from .factors import FACTORS

RESULTS = ["raw_residual", "winsorized_residual", "reprojected_residual", "alpha_z", "fitted"]


@dataclass(frozen=True)
class NeutralizeConfig:
    """Clip at ``sigma`` population standard deviations; cross-sections of under ``min_rows`` or a condition number over the limit fail."""

    sigma: float = 3.0
    min_rows: int = 30
    max_condition: float = 1e10
    tolerance: float = 1e-8
    eps: float = 1e-12

    def __post_init__(self):
        if not (self.sigma > 0 and self.min_rows >= 5 and self.max_condition > 1 and self.tolerance > 0):
            raise ValueError("sigma > 0, min_rows >= 5, max_condition > 1 and tolerance > 0 are needed")


class Neutralized(NamedTuple):
    """``panel``: one row a security; ``diagnostics``: one a date, also for failed dates; long ``coefficients`` and ``correlations``."""

    panel: DataFrame
    diagnostics: DataFrame
    coefficients: DataFrame
    correlations: DataFrame


def check(panel: DataFrame, config: NeutralizeConfig, score: str = "raw_score", factors: list[str] = FACTORS) -> DataFrame:
    """(as_of_date, n, n_sectors, reason): the first check that fails for the date, else NULL."""
    need = ["as_of_date", "ticker", score, *factors, "sector"]
    if lacking := [c for c in need if c not in panel.columns]:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    numeric = [score, *factors]
    if wrong := [c for c, kind in panel.dtypes if c in numeric and kind.split("(")[0] not in ("double", "float", "int", "bigint", "decimal", "smallint", "tinyint")]:
        raise ValueError(f"columns are not numeric: {', '.join(wrong)}")
    sector = strip("sector")
    tickers = panel.groupBy("as_of_date", "ticker").agg(F.count("*").alias("k"))
    keys = tickers.groupBy("as_of_date").agg(F.max("k").alias("most"), F.max(F.col("ticker").isNull()).alias("null_key"))
    sums = panel.groupBy("as_of_date").agg(
        F.count("*").alias("n"),
        F.max(F.greatest(*[(~F.coalesce(finite(F.col(c).cast("double")), F.lit(False))).cast("int") for c in numeric])).alias("odd"),
        F.max((sector.isNull() | (sector == "")).cast("int")).alias("blank"),
        F.count_distinct(sector).alias("n_sectors"),
        *[F.stddev_pop(F.when(finite(F.col(c).cast("double")), F.col(c))).alias(f"sd_{c}") for c in factors],
    )
    df = sums.join(keys, "as_of_date")
    reason = (
        F.when(F.col("null_key"), "null_key")
        .when(F.col("most") > 1, "duplicate_key")
        .when(F.col("n") < config.min_rows, "too_few_rows")
        .when(F.col("odd") == 1, "non_finite_value")
        .when(F.col("blank") == 1, "blank_sector")
        .when(F.col("n_sectors") < 2, "one_sector")
    )
    for c in factors:
        reason = reason.when(~(F.col(f"sd_{c}") > config.eps), f"constant_factor:{c}")
    return df.select("as_of_date", "n", "n_sectors", reason.alias("reason"))


def _solve(s: dict[tuple[int, int], Column], t: list[Column]) -> list[Column]:
    """Cramer's rule for the symmetric 3x3 system S b = t; NULL where S is singular."""
    g = lambda i, j: s[min(i, j), max(i, j)]
    minor = lambda i, j, k, m: g(i, k) * g(j, m) - g(i, m) * g(j, k)
    det = g(0, 0) * minor(1, 2, 1, 2) - g(0, 1) * minor(1, 2, 0, 2) + g(0, 2) * minor(1, 2, 0, 1)
    inverse = [
        [minor(1, 2, 1, 2), -minor(0, 2, 1, 2), minor(0, 1, 1, 2)],
        [-minor(1, 2, 0, 2), minor(0, 2, 0, 2), -minor(0, 1, 0, 2)],
        [minor(1, 2, 0, 1), -minor(0, 2, 0, 1), minor(0, 1, 0, 1)],
    ]
    return [F.try_divide(inverse[i][0] * t[0] + inverse[i][1] * t[1] + inverse[i][2] * t[2], det) for i in range(3)]


def project(panel: DataFrame, y: str, out: str, prefix: str, zs: list[str]) -> tuple[DataFrame, DataFrame]:
    """(panel with ``out`` = residual of ``y`` on intercept, zs and sectors; slopes by date as ``<prefix>_b0..2``).

    The panel also gets ``<prefix>_mean``: y's mean in the sector, for fitted values and coefficients.
    """
    means = panel.groupBy("as_of_date", "sector").agg(F.avg(y).alias(f"{prefix}_mean"), *[F.avg(z).alias(f"{prefix}_m_{z}") for z in zs])
    df = panel.join(means, ["as_of_date", "sector"])
    dz = [F.col(z) - F.col(f"{prefix}_m_{z}") for z in zs]
    dy = F.col(y) - F.col(f"{prefix}_mean")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    sums = df.groupBy("as_of_date").agg(*[F.sum(dz[i] * dz[j]).alias(f"s{i}{j}") for i, j in pairs], *[F.sum(dz[i] * dy).alias(f"t{i}") for i in range(3)])
    b = _solve({(i, j): F.col(f"s{i}{j}") for i, j in pairs}, [F.col(f"t{i}") for i in range(3)])
    slopes = sums.select("as_of_date", *[b[i].alias(f"{prefix}_b{i}") for i in range(3)])
    df = df.join(slopes, "as_of_date")
    residual = dy - sum((F.col(f"{prefix}_b{i}") * dz[i] for i in range(3)), F.lit(0.0))
    return df.withColumn(out, residual).drop(*[f"{prefix}_m_{z}" for z in zs]), slopes


def standardized(df: DataFrame, column: str, out: str, eps: float) -> DataFrame:
    """``out`` = (column - mean) / population sd by date; NULL where the sd is not over ``eps``."""
    stats = df.groupBy("as_of_date").agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.when(F.col("_s") > eps, (F.col(column) - F.col("_m")) / F.col("_s"))
    return df.join(stats, "as_of_date").withColumn(out, z).drop("_m", "_s")


def design_rank(panel: DataFrame, zs: list[str], fan_in: int = 64) -> DataFrame:
    """(as_of_date, n_columns, design_rank, condition_number) of the design matrix, by a tree of QR factorizations and an SVD of the last R.

    Each partition reduces its rows of a date to one R of (4 + sectors - 1)^2 numbers before anything is shuffled. R's are stacked
    ``fan_in`` at a time, level by level, so that no task gets one from each partition.
    """
    sectors = panel.groupBy("as_of_date").agg(F.sort_array(F.collect_set("sector")).alias("names"))
    rows = panel.join(sectors, "as_of_date").select("as_of_date", F.array(*zs).alias("z"), (F.array_position("names", F.col("sector")) - 1).cast("int").alias("s"), F.size("names").alias("k"))
    schema = "as_of_date date, part int, r array<double>, width int"

    def local(parts):
        part = TaskContext.get().partitionId()
        for pdf in parts:
            for day, g in pdf.groupby("as_of_date", sort=False):
                k = int(g["k"].iloc[0])
                x = np.zeros((len(g), 3 + k))
                x[:, 0] = 1
                x[:, 1:4] = np.stack(g["z"].to_numpy())
                s = g["s"].to_numpy()
                x[np.flatnonzero(s), 3 + s[s > 0]] = 1
                r = np.linalg.qr(x, mode="r")
                yield pd.DataFrame({"as_of_date": [day], "part": [part], "r": [r.ravel().tolist()], "width": [x.shape[1]]})

    def stacked(pdf: pd.DataFrame) -> pd.DataFrame:
        """One R of the R's of a date and a group of parts, which is a part of the next level."""
        width = int(pdf["width"].iloc[0])
        r = np.linalg.qr(np.concatenate([np.asarray(r, float).reshape(-1, width) for r in pdf["r"]]), mode="r")
        return pd.DataFrame({"as_of_date": [pdf["as_of_date"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // fan_in], "r": [r.ravel().tolist()], "width": [width]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        width = int(pdf["width"].iloc[0])
        stacked = np.concatenate([np.asarray(r, float).reshape(-1, width) for r in pdf["r"]])
        sv = np.linalg.svd(np.linalg.qr(stacked, mode="r"), compute_uv=False)
        tol = sv[0] * max(width, len(stacked)) * np.finfo(float).eps if len(sv) else 0
        rank = int((sv > tol).sum())
        cond = float(sv[0] / sv[-1]) if len(sv) == width and sv[-1] > 0 else float("inf")
        return pd.DataFrame({"as_of_date": [pdf["as_of_date"].iloc[0]], "n_columns": [width], "design_rank": [rank], "condition_number": [cond]})

    # A partition may give several R's of a date, one a batch; they are of one part.
    factors, parts = rows.mapInPandas(local, schema), rows.rdd.getNumPartitions()
    while parts > fan_in:
        factors = factors.groupBy("as_of_date", F.floor(F.col("part") / fan_in)).applyInPandas(stacked, schema)
        parts = -(-parts // fan_in)
    return factors.groupBy("as_of_date").applyInPandas(joined, "as_of_date date, n_columns int, design_rank int, condition_number double")


def correlations(panel: DataFrame, alpha: str, factors: list[str] = FACTORS) -> DataFrame:
    """(as_of_date, exposure, correlation) of alpha with each raw factor and each sector's dummy; constant exposures give NULL."""
    stats = panel.groupBy("as_of_date").agg(F.count("*").alias("n"), F.avg(alpha).alias("ma"), F.stddev_pop(alpha).alias("sa"), *[F.avg(f).alias(f"m_{f}") for f in factors], *[F.stddev_pop(f).alias(f"s_{f}") for f in factors])
    df = panel.join(stats, "as_of_date")
    cov = df.groupBy("as_of_date").agg(*[F.avg((F.col(alpha) - F.col("ma")) * (F.col(f) - F.col(f"m_{f}"))).alias(f"c_{f}") for f in factors])
    wide = cov.join(stats, "as_of_date").select("as_of_date", *[F.try_divide(F.col(f"c_{f}"), F.col("sa") * F.col(f"s_{f}")).alias(f) for f in factors])
    one = wide.unpivot("as_of_date", factors, "exposure", "correlation")
    by = panel.groupBy("as_of_date", "sector").agg(F.count("*").alias("ns"), F.avg(alpha).alias("ms")).join(stats.select("as_of_date", "n", "ma", "sa"), "as_of_date")
    share = F.col("ns") / F.col("n")
    dummy = F.try_divide(share * (F.col("ms") - F.col("ma")), F.col("sa") * F.sqrt(share * (1 - share)))
    return one.unionByName(by.select("as_of_date", F.concat(F.lit("sector["), "sector", F.lit("]")).alias("exposure"), dummy.alias("correlation")))


def coefficients(fitted: DataFrame, prefix: str, zs: list[str], factors: list[str] = FACTORS) -> DataFrame:
    """(as_of_date, term, coefficient): intercept, ``z_<factor>``, ``sector[<name>]`` against the first sorted sector."""
    by = fitted.groupBy("as_of_date", "sector").agg(F.first(f"{prefix}_mean").alias("my"), *[F.avg(z).alias(f"m{i}") for i, z in enumerate(zs)], *[F.first(f"{prefix}_b{i}").alias(f"b{i}") for i in range(3)])
    effect = F.col("my") - sum((F.col(f"b{i}") * F.col(f"m{i}") for i in range(3)), F.lit(0.0))
    effects = by.select("as_of_date", "sector", effect.alias("effect"), "b0", "b1", "b2")
    base = effects.groupBy("as_of_date").agg(F.min_by("effect", "sector").alias("base"), F.min("sector").alias("baseline"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(3)])
    terms = base.select("as_of_date", F.col("base").alias("intercept"), *[F.col(f"b{i}").alias(f"z_{f}") for i, f in enumerate(factors)])
    one = terms.unpivot("as_of_date", ["intercept", *[f"z_{f}" for f in factors]], "term", "coefficient")
    two = effects.join(base.select("as_of_date", "base", "baseline"), "as_of_date").where("sector <> baseline")
    return one.unionByName(two.select("as_of_date", F.concat(F.lit("sector["), "sector", F.lit("]")).alias("term"), (F.col("effect") - F.col("base")).alias("coefficient")))


def residuals(panel: DataFrame, config: NeutralizeConfig, score: str, factors: list[str] = FACTORS) -> DataFrame:
    """The panel of good dates with z-factors, both projections, bounds and the final z-score; DataFrame operations only."""
    zs = [f"z_{f}" for f in factors]
    stats = panel.groupBy("as_of_date").agg(*[F.avg(f).alias(f"m_{f}") for f in factors], *[F.stddev_pop(f).alias(f"s_{f}") for f in factors])
    df = panel.join(stats, "as_of_date").withColumns({z: (F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}") for z, f in zip(zs, factors)}).drop(*stats.columns[1:])
    df, _ = project(df, score, "raw_residual", "p1", zs)
    bounds = df.groupBy("as_of_date").agg(F.avg("raw_residual").alias("residual_mean"), F.stddev_pop("raw_residual").alias("residual_sd"))
    df = df.join(bounds, "as_of_date").withColumn("lower", F.col("residual_mean") - config.sigma * F.col("residual_sd")).withColumn("upper", F.col("residual_mean") + config.sigma * F.col("residual_sd"))
    df = df.withColumn("winsorized_residual", F.greatest("lower", F.least("upper", "raw_residual"))).withColumn("fitted", F.col(score) - F.col("raw_residual"))
    df, _ = project(df, "winsorized_residual", "reprojected_residual", "p2", zs)
    df = standardized(df, "reprojected_residual", "_z", config.eps)
    return standardized(df, "_z", "alpha_z", config.eps).drop("_z")  # once more, for what rounding left


def neutralize(panel: DataFrame, config: NeutralizeConfig = NeutralizeConfig(), score: str = "raw_score") -> Neutralized:
    """``panel(as_of_date, ticker, raw_score, log_market_cap, momentum_12m, price_to_book, sector)`` -> ``Neutralized``.

    Failed dates have a reason in the diagnostics and no panel rows; a date whose raw scores are all equal has reason
    ``no_signal`` and alpha 0.0 for all.
    """
    factors, zs = FACTORS, [f"z_{f}" for f in FACTORS]
    panel = written(panel.select("as_of_date", "ticker", F.col(score).cast("double").alias("raw_score"), *[F.col(f).cast("double").alias(f) for f in factors], strip("sector").alias("sector")), "panel")
    status = check(panel, config)
    flat = panel.groupBy("as_of_date").agg(F.stddev_pop("raw_score").alias("score_sd"))
    status = written(status.join(flat, "as_of_date").withColumn("reason", F.when(F.col("reason").isNull() & ~(F.col("score_sd") > config.eps), "no_signal").otherwise(F.col("reason"))), "status")
    good = panel.join(status.where(F.col("reason").isNull()).select("as_of_date"), "as_of_date")
    df = written(residuals(good, config, "raw_score"), "residuals")
    ranks = design_rank(df.select("as_of_date", *zs, "sector"), zs)
    corr = correlations(df, "alpha_z", factors)
    worst = corr.groupBy("as_of_date").agg(F.max(F.abs("correlation")).alias("max_abs_correlation"))
    sums = df.groupBy("as_of_date").agg(
        F.first("residual_mean").alias("residual_mean"),
        F.first("residual_sd").alias("residual_sd"),
        F.first("lower").alias("lower"),
        F.first("upper").alias("upper"),
        F.sum((F.col("raw_residual") < F.col("lower")).cast("long")).alias("n_below"),
        F.sum((F.col("raw_residual") > F.col("upper")).cast("long")).alias("n_above"),
        F.avg("alpha_z").alias("alpha_mean"),
        F.stddev_pop("alpha_z").alias("alpha_sd"),
    )
    diag = status.join(ranks, "as_of_date", "left").join(sums, "as_of_date", "left").join(worst, "as_of_date", "left")
    late = (
        F.when(F.col("design_rank") < F.col("n_columns"), "rank_deficient")
        .when(~(F.col("condition_number") <= config.max_condition), "ill_conditioned")
        .when(~(F.col("residual_sd") > config.eps), "degenerate_residual")
        .when(missing(F.col("alpha_sd")), "degenerate_alpha")
        .when(F.col("max_abs_correlation") >= config.tolerance, "not_neutral")
    )
    diag = written(diag.withColumn("reason", F.coalesce("reason", late)), "diagnostics")
    kept = diag.where(F.col("reason").isNull()).select("as_of_date")
    coefs = coefficients(df, "p1", zs).join(kept, "as_of_date")
    flat_rows = panel.join(diag.where("reason = 'no_signal'").select("as_of_date"), "as_of_date")
    columns = ["as_of_date", "ticker", "raw_score", *factors, "sector", *RESULTS]
    zero = {c: F.lit(0.0) for c in RESULTS}
    result = df.join(kept, "as_of_date").select(*columns).unionByName(flat_rows.withColumns(zero | {"fitted": F.col("raw_score")}).select(*columns))
    return Neutralized(result, diag, coefs, corr.join(kept, "as_of_date"))
