"""Page views as a stream: an extension, for what the daily job counts from whole logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, ts: str, key: str, id_col: str, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Counts for each window and key, each event once, with late events awaited for ``late``."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_col])
    return once.groupBy(F.window(ts, span).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def failing_now(events: DataFrame, *, ts: str, key: str, failed: str, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of failures: how many in a row of events no further apart than ``gap``."""
    bad = events.where(failed).withWatermark(ts, late)
    return bad.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
