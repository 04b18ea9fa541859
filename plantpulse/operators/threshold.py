"""Per-event metric limits: the stateless anomaly test of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Highest accepted reading per metric.
METRIC_LIMITS = {
    "temperature": 150.0,
    "vibration": 10.0,
    "vibration_rms": 10.0,
    "pressure": 25.0,
    "flow_rate": 300.0,
    "power_draw": 600.0,
    "power": 600.0,
    "motor_current": 250.0,
}


def flag_breaches(readings: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """One anomaly row per reading above its metric's limit.  Narrow: no shuffle, batch or stream."""
    limits = METRIC_LIMITS if limits is None else limits
    breach = F.lit(False)
    for limit in sorted(set(limits.values())):
        metrics = sorted(m for m, v in limits.items() if v == limit)
        breach = breach | (F.col("metric_name").isin(*metrics) & (F.col("value") > limit))
    none = F.lit(None)
    return readings.filter(breach).select(
        F.concat(F.lit("anom_"), F.col("event_id")).alias("anomaly_id"),
        F.lit("anomaly_event.v1").alias("schema_version"),
        F.lit("threshold_spike_e2e").alias("rule_id"),
        "tenant_id",
        "plant_id",
        "asset_id",
        F.coalesce("asset_name", F.lit("")).alias("asset_name"),
        "component_id",
        "tag_id",
        F.coalesce("tag_name", F.lit("")).alias("tag_name"),
        F.coalesce("metric_name", F.lit("")).alias("metric_name"),
        F.col("value").alias("observed_value"),
        F.lit(0.0).alias("baseline_value"),
        F.lit(0.0).alias("expected_value"),
        F.lit(1).alias("event_count"),
        F.lit(1).alias("breach_count"),
        F.col("event_time").alias("window_start"),
        F.col("event_time").alias("window_end"),
        F.lit("warning").alias("severity"),
        "quality_flags",
        none.cast("array<string>").alias("quality_event_ids"),
        F.lit("sensor_fault").alias("fault_type"),
        none.cast("string").alias("failure_mode_id"),
        F.lit(0.85).alias("detection_confidence"),
        F.array("event_id").alias("source_event_ids"),
    )
