"""Running sums over sorted rows of groups of any size, in two levels.

A window over a group is one task, however large the group. Here rows are dealt by ranges of (group, order), so that a large group lies in
many parts; each part is summed, the parts' sums are added up in their order (a row a part and group), and a window within the part
adds what stands before it there. All rows of equal group and order lie in one part, so ties are seen whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], name: str = "ranges") -> DataFrame:
    """``df`` with, for each entry of ``sums``, the sum of its expression over the rows of the group ``by`` that come before in ``order``.

    ``order`` should tell the rows of a group apart; rows that it doesn't tell apart come in any order.
    """
    held = df.withColumns({f"_s{i}": c.cast("double") if dict(df.select(c.alias("c")).dtypes)["c"] in ("double", "float") else c.cast("long") for i, c in enumerate(sums.values())})
    held = written(held.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), name)
    cols = [f"_s{i}" for i in range(len(sums))]
    parts = held.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in cols])
    before = _before(parts, by, cols)
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(before, [*by, "_part"])
    return out.select(*df.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"{c}_before")).alias(k) for c, k in zip(cols, sums)])


def _before(parts: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """For each group and part the sums of the group's parts before it."""
    names = [f"{c}_before" for c in cols]
    if by:
        over = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
        return parts.select(*by, "_part", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(n) for c, n in zip(cols, names)])
    total, rows = [0] * len(cols), []
    for r in sorted(parts.collect(), key=lambda r: r._part):  # as many rows as there are partitions
        rows.append((r._part, *total))
        total = [t + (r[c] or 0) for t, c in zip(total, cols)]
    kinds = dict(parts.dtypes)
    return parts.sparkSession.createDataFrame(rows, ", ".join(["_part int", *[f"{n} {kinds[c]}" for n, c in zip(names, cols)]]))


def medians(df: DataFrame, by: list[str], columns: list[str], name: str = "medians") -> DataFrame:
    """(by..., columns): the exact medians of the groups, nulls left out. No group is held in one place: values are counted, and the
    middle ones are found by the running sums of the counts."""
    out = df.select(*by).distinct()
    for c in columns:
        each = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("_k"))
        each = running(each, by, [c], {"_less": F.col("_k")}, f"{name}-{c}")
        sizes = each.groupBy(*by).agg(F.sum("_k").alias("_n"))
        at = lambda place: F.max(F.when((F.col("_less") <= place) & (place < F.col("_less") + F.col("_k")), F.col(c)))  # noqa: E731, B023
        low, high = F.expr("(_n - 1) div 2"), F.expr("_n div 2")
        found = each.join(sizes, by).groupBy(*by).agg((at(low) * 0.5 + at(high) * 0.5).alias(c))
        out = out.join(found, by, "left")
    return out


def largest(df: DataFrame, by: list[str]) -> int:
    """The number of rows of the largest group."""
    return df.groupBy(*by).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0


def average_ranks(df: DataFrame, by: list[str], values: dict[str, str], name: str = "ranks") -> DataFrame:
    """``df`` with the average rank of each column of ``values`` (out -> column) within the group ``by``, ties sharing theirs.

    Equal values are counted first, so a value that most rows have is one row of the sums. A null value has a null rank.
    """
    for out, value in values.items():
        each = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
        ranked = running(each, by, [value], {"_less": F.col("_k")}, f"{name}-{value}")
        ranked = ranked.select(*by, value, (F.col("_less") + (F.col("_k") + 1) / 2).alias(out))
        df = df.join(ranked, [*by, value], "left")
    return df
