"""Gap sessions of events as they arrive, an extension beyond batch work.

``session_window`` holds a session's state until the watermark passes its end, so late rows within ``delay``
still join their session, and state stays bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(events: DataFrame, call: str, speaker: str, ts: str = "ts", gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """call, speaker, start, end and events of sessions without a pause of ``gap``; batch or stream."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("_ts", delay)
    grouped = timed.groupBy(F.session_window("_ts", gap).alias("w"), call, speaker).agg(F.count("*").alias("n_events"))
    return grouped.select(call, speaker, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def turn_stream(segments: DataFrame, call: str, delay: str = "10 minutes") -> DataFrame:
    """Speaking time per call and speaker in tumbling minutes of arrival, for dashboards over live calls."""
    timed = segments.withWatermark("arrived", delay) if segments.isStreaming else segments
    return timed.groupBy(F.window("arrived", "1 minute").alias("w"), call, "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("seconds")).select(call, "speaker", F.col("w.start").alias("minute"), "seconds")
