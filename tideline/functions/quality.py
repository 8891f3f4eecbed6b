"""Violations: long tables ``(rule, entity, detail)``; an input is valid if its table is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Invalid(ValueError):
    """Raised in strict mode; holds the first violations."""


def violation(df: DataFrame, rule: str, bad: Column, entity: Column, detail: Column | str = "") -> DataFrame:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return df.where(bad).select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), text.cast("string").alias("detail"))


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def require(violations: DataFrame, what: str, show: int = 5) -> None:
    """Strict mode: an exception that names the first few violations."""
    if first := violations.take(show):
        raise Invalid(f"{what}: " + "; ".join(f"{r.rule}({r.entity}) {r.detail}".strip() for r in first))


def missing(value: Column) -> Column:
    return value.isNull() | F.isnan(value)


def finite(value: Column) -> Column:
    return ~missing(value) & (F.abs(value) < float("inf"))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
