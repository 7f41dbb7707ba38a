"""Event-time aggregates and alert streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of the alert stream.
ALERT_ABOVE, CRITICAL_ABOVE = 8.0, 10.0


EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def with_event_time(df: DataFrame, at: str) -> DataFrame:
    """Watermarks need TIMESTAMP. A column without a zone is read as UTC, so that windows do
    not depend on the session's zone."""
    if dict(df.dtypes)[at] != "timestamp_ntz":
        return df
    return df.withColumn(at, F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, {EPOCH}, `{at}`))"))


def utc_wall_clock(instant: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), {EPOCH})")


def tumbling(df: DataFrame, at: str, length: str, delay: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate per key and event-time window. The watermark bounds the state: in append and
    update mode a window is dropped from it once it is older than ``delay``."""
    counted = df.withWatermark(at, delay).groupBy(F.window(at, length), *keys).agg(*aggs)
    return counted.select(
        utc_wall_clock("window.start").alias("window_start"),
        utc_wall_clock("window.end").alias("window_end"),
        *[c for c in counted.columns if c != "window"],
    )


def keyed(df: DataFrame, at: str, delay: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Running aggregate per key. Keys are not windows, so their state is never dropped: use
    it only for key sets of bounded size."""
    return df.withWatermark(at, delay).groupBy(*keys).agg(*aggs)


def alerts(df: DataFrame, measure: str, above: float = ALERT_ABOVE, critical: float = CRITICAL_ABOVE) -> DataFrame:
    """Rows over a limit with their severity; no state."""
    severity = F.when(F.col(measure) > critical, "critical").otherwise("warning")
    return df.where(F.col(measure) > above).withColumn("alert_severity", severity)
