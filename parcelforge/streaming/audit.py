"""Audit stream: daily throughput, reviewer sessions, content dedup and service-level breaches.

State is bounded by the watermark: windows close when it passes them, and
duplicates are remembered for its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def throughput(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events, corrections and decisions by reviewer and window."""
    rows = events.withWatermark("created_at", late).groupBy(F.window("created_at", width), "reviewer")
    return rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("action") == "corrected").alias("corrections"), F.count_if(F.col("action") == "status_changed").alias("decisions")).select(F.col("window.start").alias("start"), "reviewer", "events", "corrections", "decisions")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Spells of activity of a reviewer with pauses shorter than ``gap``."""
    rows = events.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("s"), "reviewer")
    return rows.agg(F.count(F.lit(1)).alias("events")).select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "reviewer", "events")


def first_of_content(documents: DataFrame, key: str = "sha256", at: str = "ingested_at", late: str = "1 day") -> DataFrame:
    return documents.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def breaches(parcels: DataFrame, now: Column) -> DataFrame:
    """Open records past their due time."""
    from ..operators.reads import is_overdue

    return parcels.filter(is_overdue(now))
