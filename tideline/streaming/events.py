"""The event table as a stream: normalised rows in, each event id once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_of_each(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """A streaming form of the weekly re-read: an id that comes again within ``lateness`` of its fetch time is dropped; state older than that is freed."""
    return events.withWatermark("fetched_at_utc", lateness).dropDuplicatesWithinWatermark(["event_id"])
