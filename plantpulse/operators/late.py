"""Late readings: by ingestion lag (stateless) or by watermark (arrival order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantpulse.functions.times import seconds, whole_seconds, with_bucket
from plantpulse.operators.series import with_ranges

WATERMARK_DELAY = "5 MINUTES"
ALLOWED_LATENESS = "10 MINUTES"


def late_by_ingest_lag(enriched: DataFrame, max_lag_seconds: int = 600) -> DataFrame:
    """Readings ingested more than ``max_lag_seconds`` after they were taken (15 columns)."""
    lag = whole_seconds("event_time", "ingest_time")
    return enriched.filter(lag > max_lag_seconds).select(
        "event_id",
        F.lit("late_event.v1").alias("schema_version"),
        "tenant_id",
        F.col("site_id").alias("plant_id"),
        "asset_id",
        "component_id",
        "tag_id",
        "tag_name",
        "metric_name",
        "event_time",
        "ingest_time",
        (F.col("event_time") - F.expr(f"INTERVAL {WATERMARK_DELAY}")).alias("watermark_time"),
        (lag / F.lit(60.0)).alias("lateness_minutes"),
        F.lit("ingestion_lag_exceeded").alias("reason"),
        "quality_flags",
    )


def late_by_watermark(
    events: DataFrame,
    delay: str = WATERMARK_DELAY,
    allowed: str = ALLOWED_LATENESS,
    cell: str = "1 minute",
    target_rows: int = 1_000_000,
) -> DataFrame:
    """Readings older than the tenant's watermark minus the allowed lateness on arrival.

    The watermark before a reading is the newest event time among earlier arrivals of
    the tenant, minus ``delay``.  Arrivals are ordered by (ingest_time, event_id) and cut into arrival
    cells; a cell of more than ``target_rows`` rows (a backfill has one ingest time) into ranges of that
    order.  Maxima per cell and range come first, a running maximum over those few rows, then a window
    inside each: no task sees a whole tenant or instant.
    """
    order = ("ingest_time", "event_id")
    arrivals = with_ranges(with_bucket(events, "ingest_time", cell, "_cell"), ["tenant_id", "_cell"], order, target_rows)
    # a struct, so that arrivals without a tenant are joined as well
    part = F.struct("tenant_id", "_cell", "_range")
    arrivals = arrivals.withColumn("_part", part).drop("_cell", "_range")
    tops = arrivals.groupBy("_part").agg(F.max("event_time").alias("_top"))
    before = Window.partitionBy("_part.tenant_id").orderBy("_part._cell", "_part._range").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_part", F.max("_top").over(before).alias("_earlier"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.col("_earlier"), F.max("event_time").over(inside))
    marked = arrivals.join(tops, "_part").withColumn("watermark_time", seen - F.expr(f"INTERVAL {delay}"))
    return late_against(marked, allowed)


def late_against(events: DataFrame, allowed: str = ALLOWED_LATENESS) -> DataFrame:
    """Rows whose own ``watermark_time`` column already passed them by more than ``allowed``."""
    lateness = F.greatest(F.lit(0.0), seconds("event_time", "watermark_time") / 60.0)
    return events.filter(F.col("event_time") < F.col("watermark_time") - F.expr(f"INTERVAL {allowed}")).select(
        "event_id",
        F.lit("late_event.v1").alias("schema_version"),
        "tenant_id",
        "tag_id",
        "event_time",
        "ingest_time",
        "watermark_time",
        F.round(lateness, 3).alias("lateness_minutes"),
        F.lit("beyond_allowed_lateness").alias("reason"),
    )
