"""Windowed counts of events, the same on a stream and on a stored table.

Each function takes either kind. On a stream it sets the watermark, which drops
late rows and lets finished windows leave the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(df: DataFrame, ts: str, watermark: str) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming else df


def _counted(df: DataFrame, span, keys: list[str], value: str | None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs += [F.sum(value).alias("total"), F.max(value).alias("largest")]
    return df.groupBy(span.alias("w"), *keys).agg(*aggs).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
        "n", *(["total", "largest"] if value else []),
    )


def velocity(
    events: DataFrame, ts: str = "ts", user: str = "user_id", length: str = "10 minutes",
    slide: str | None = "5 minutes", watermark: str = "1 hour", value: str | None = None,
) -> DataFrame:
    """Events per user in tumbling (``slide=None``) or sliding windows."""
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return _counted(_timed(events, ts, watermark), span, [user], value)


def sessions(
    events: DataFrame, ts: str = "ts", user: str = "user_id", gap: str = "30 minutes",
    watermark: str = "1 hour", value: str | None = None,
) -> DataFrame:
    """Events per user and burst, bursts being ``gap`` apart."""
    return _counted(_timed(events, ts, watermark), F.session_window(ts, gap), [user], value)


def daily_summary(
    events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", watermark: str = "1 day"
) -> DataFrame:
    """Events and their sum per day and kind."""
    return _counted(_timed(events, ts, watermark), F.window(ts, "1 day"), [kind], value)


def alerts(
    rows: DataFrame, key: list[str], ts: str, score: str, threshold: float, above: bool = True,
    watermark: str = "1 hour",
) -> DataFrame:
    """Rows beyond the threshold, each key once (within the watermark, on a stream)."""
    beyond = F.col(score) > threshold if above else F.col(score) < threshold
    hits = _timed(rows, ts, watermark).filter(beyond)
    return hits.dropDuplicatesWithinWatermark(key) if rows.isStreaming else hits.dropDuplicates(key)
