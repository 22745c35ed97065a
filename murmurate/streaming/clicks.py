"""Click bursts of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_stream(clicks: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """``key, start, end, singles, doubles`` of each burst once the watermark has passed it.

    Unlike the batch form, two clicks exactly ``gap`` apart are one burst: session windows
    include their end."""
    session = F.session_window(ts, gap)
    bursts = clicks.withWatermark(ts, late).groupBy(key, session.alias("s")).agg(F.count("*").alias("n"))
    return bursts.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), (F.col("n") % 2).alias("singles"), F.floor(F.col("n") / 2).alias("doubles"))
