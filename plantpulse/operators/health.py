"""Stream health snapshots per tenant and tumbling window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.times import seconds, whole_seconds, with_bucket


KEYS = ("tenant_id", "observed_at")


def health_parts(
    readings: DataFrame,
    dead_letters: DataFrame | None = None,
    gaps: DataFrame | None = None,
    width: str = "5 minutes",
    max_lag_seconds: int = 600,
) -> DataFrame:
    """Partial counts per tenant and window; :func:`health_rows` adds up those of any number of batches."""
    lag = seconds("event_time", "ingest_time")
    late = whole_seconds("event_time", "ingest_time") > max_lag_seconds
    parts = _part(readings, "event_time", width, F.count(F.lit(1)), F.max(lag), F.count_if(late), F.lit(0), F.lit(0))
    none = F.lit(None).cast("double")
    if dead_letters is not None:
        parts = parts.union(_part(dead_letters, "event_time", width, F.lit(0), none, F.lit(0), F.count(F.lit(1)), F.lit(0)))
    if gaps is not None:
        parts = parts.union(_part(gaps, "window_end", width, F.lit(0), none, F.lit(0), F.lit(0), F.count(F.lit(1))))
    return parts


def _part(rows: DataFrame, time_col: str, width: str, *measures: Column) -> DataFrame:
    kinds = ("bigint", "double", "bigint", "bigint", "bigint")
    cast = [m.cast(kind).alias(name) for m, kind, name in zip(measures, kinds, PART, strict=True)]
    return with_bucket(rows, time_col, width, "observed_at").groupBy(*KEYS).agg(*cast)


PART = ("reading_count", "watermark_lag_seconds", "late_event_count", "dlq_count", "missing_heartbeat_count")


def health_rows(parts: DataFrame) -> DataFrame:
    """The 10-column rows of the windows that have readings, from all their partial counts."""
    totals = parts.groupBy(*KEYS).agg(*[(F.max if c == "watermark_lag_seconds" else F.sum)(c).alias(c) for c in PART])
    return shaped(totals.filter("reading_count > 0"))


def shaped(totals: DataFrame) -> DataFrame:
    return totals.select(
        F.lit("stream_health.v1").alias("schema_version"),
        F.concat(F.col("tenant_id"), F.lit("-stream_health")).alias("job_name"),
        "tenant_id",
        "watermark_lag_seconds",
        "late_event_count",
        "dlq_count",
        "missing_heartbeat_count",
        F.lit(0.0).alias("processing_time_ms"),
        F.lit("streaming_active").alias("checkpoint_status"),
        "observed_at",
    )


def health_snapshot(
    readings: DataFrame,
    dead_letters: DataFrame | None = None,
    gaps: DataFrame | None = None,
    width: str = "5 minutes",
    max_lag_seconds: int = 600,
) -> DataFrame:
    """Lag, late, dead-letter and heartbeat counts per tenant and window (10 columns).

    ``dead_letters`` needs ``tenant_id, event_time``; ``gaps`` (missing-heartbeat
    anomalies) needs ``tenant_id, window_end``.
    """
    return health_rows(health_parts(readings, dead_letters, gaps, width, max_lag_seconds))
