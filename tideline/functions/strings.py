"""White space by Unicode rules; Spark's own trim takes off spaces only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def collapse(text: Column | str) -> Column:
    """Stripped, and with single spaces inside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(text: Column | str) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(strip(text) == "", F.lit(True))
