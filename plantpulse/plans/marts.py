"""Serving marts.  Each is a function of DataFrames and ``as_of``; the sink is the caller's choice.

Sources are filtered by time first and aggregated to the mart's grain before they meet,
so only small partial results are combined.  Distinct-id counts go through one row per
id first: copies of a row collapse map-side and no single key carries a distinct set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.text import sorted_set
from plantpulse.functions.times import AsOf, as_of_column, since, with_bucket

ASSET = ("tenant_id", "asset_id")


def distinct_counts(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    conditions: dict[str, Column],
    latest: dict[str, Column] | None = None,
) -> DataFrame:
    """Per key: exact number of distinct ids for each condition, and the newest of each time column."""
    latest = latest or {}
    per_id = df.groupBy(*keys, id_col).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()],
        *[F.max(c).alias(name) for name, c in latest.items()],
    )
    known = F.col(id_col).isNotNull()
    return per_id.groupBy(*keys).agg(
        *[F.count_if(F.col(name) & known).alias(name) for name in conditions],
        *[F.max(name).alias(name) for name in latest],
    )


def stack(*parts: DataFrame) -> DataFrame:
    """Union of partial results with different measures; missing measures are NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).alias(name)


def flags_text() -> Column:
    """Distinct flags of a group as sorted ``|``-joined text (the vocabulary bounds its size)."""
    return F.array_join(sorted_set(F.flatten(F.collect_set("quality_flags"))), "|")


# --- building blocks ------------------------------------------------------------------------


def base_assets(anomalies: DataFrame, diagnoses: DataFrame, readings: DataFrame, as_of: AsOf, lookback: str) -> DataFrame:
    """Assets with any anomaly, diagnosis or reading in the look-back."""
    return (
        anomalies.filter(since("window_end", as_of, lookback)).select(*ASSET)
        .union(diagnoses.filter(since("created_at", as_of, lookback)).select(*ASSET))
        .union(readings.filter(since("event_time", as_of, lookback)).select(*ASSET))
        .distinct()
    )


def expected_tags(tags: DataFrame) -> DataFrame:
    """Mapped tags per asset (current mappings only)."""
    current = tags.filter(F.col("valid_to").isNull()) if "valid_to" in tags.columns else tags
    return current.select(*ASSET, "tag_id").distinct().groupBy(*ASSET).agg(
        F.count("tag_id").alias("total_expected")
    )


def active_tags(readings: DataFrame, keys: Sequence[str] = ASSET) -> DataFrame:
    """Tags with at least one reading per key, and the newest reading."""
    per_tag = readings.groupBy(*keys, "tag_id").agg(F.max("event_time").alias("last_event_time"))
    return per_tag.groupBy(*keys).agg(
        F.count("tag_id").alias("active_count"), F.max("last_event_time").alias("last_event_time")
    )


def stale_tags(tags: DataFrame, readings: DataFrame, as_of: AsOf, lookback: str = "15 MINUTES") -> DataFrame:
    """Expected against active tags per asset; assets known to either side only are kept."""
    active = active_tags(readings.filter(since("event_time", as_of, lookback))).drop("last_event_time")
    both = expected_tags(tags).join(active, list(ASSET), "full")
    return both.select(
        *ASSET,
        _zero("total_expected"),
        _zero("active_count"),
        F.greatest(F.coalesce("total_expected", F.lit(0)) - F.coalesce("active_count", F.lit(0)), F.lit(0)).alias(
            "stale_count"
        ),
    )


def base_components(
    failures: DataFrame, work_orders: DataFrame, maintenance: DataFrame, components: DataFrame, as_of: AsOf, lookback: str
) -> DataFrame:
    """Components with failure, work-order or maintenance records in the look-back, and all current ones."""
    keys = (*ASSET, "component_id")
    return (
        failures.filter(since("occurred_at", as_of, lookback) | since("detected_at", as_of, lookback)).select(*keys)
        .union(
            work_orders.filter(since("created_at", as_of, lookback) | since("completed_at", as_of, lookback)).select(*keys)
        )
        .union(maintenance.filter(since("performed_at", as_of, lookback)).select(*keys))
        .union(components.select(*keys))
        .distinct()
    )


# --- marts ----------------------------------------------------------------------------------


def condition_snapshot(
    anomalies: DataFrame,
    diagnoses: DataFrame,
    readings: DataFrame,
    health: DataFrame,
    tags: DataFrame,
    assets: DataFrame,
    as_of: AsOf,
    lookback: str = "15 MINUTES",
) -> DataFrame:
    """Condition per asset: critical, else warning, else unknown (stale tags), else healthy (14 columns).

    Anomalies, diagnoses and readings are reduced per asset and stacked, so they meet in
    one aggregation instead of a chain of joins.
    """
    now = as_of_column(as_of)
    an = distinct_counts(
        anomalies.filter(since("window_end", as_of, lookback)),
        ASSET,
        "anomaly_id",
        {
            "critical_anomaly_count_15m": F.col("severity") == "critical",
            "warning_anomaly_count_15m": F.col("severity") == "warning",
        },
        {"last_anomaly_time": F.col("window_end")},
    )
    di = distinct_counts(
        diagnoses.filter(since("created_at", as_of, lookback)),
        ASSET,
        "diagnosis_id",
        {"high_risk_diagnosis_count_15m": F.col("risk_level").isin("critical", "high")},
        {"last_diagnosis_time": F.col("created_at")},
    )
    si = active_tags(readings.filter(since("event_time", as_of, lookback)))
    measures = (
        "critical_anomaly_count_15m warning_anomaly_count_15m high_risk_diagnosis_count_15m active_count "
        "last_event_time last_anomaly_time last_diagnosis_time"
    ).split()
    base = stack(an, di, si).groupBy(*ASSET).agg(*[F.max(m).alias(m) for m in measures])
    beats = distinct_counts(
        health.filter(since("observed_at", as_of, lookback)),
        ["tenant_id"],
        "job_name",
        {"missing_heartbeat_count_15m": F.col("late_event_count") > 0},
    )
    side = expected_tags(tags).join(assets.select(*ASSET, "asset_name"), list(ASSET), "full")
    df = base.join(side, list(ASSET), "left").join(beats, "tenant_id", "left")
    stale = F.greatest(F.coalesce("total_expected", F.lit(0)) - F.coalesce("active_count", F.lit(0)), F.lit(0))
    df = df.withColumn("stale_tag_count_15m", stale)
    status = (
        F.when(F.col("critical_anomaly_count_15m") > 0, "critical")
        .when(F.col("warning_anomaly_count_15m") > 0, "warning")
        .when(F.col("stale_tag_count_15m") > 0, "unknown")
        .otherwise("healthy")
    )
    return df.filter(F.col("asset_id") != "").select(
        *ASSET,
        now.alias("snapshot_time"),
        F.coalesce("asset_name", F.lit("")).alias("asset_name"),
        status.alias("condition_status"),
        _zero("critical_anomaly_count_15m"),
        _zero("warning_anomaly_count_15m"),
        _zero("high_risk_diagnosis_count_15m"),
        "stale_tag_count_15m",
        _zero("missing_heartbeat_count_15m"),
        "last_event_time",
        "last_anomaly_time",
        "last_diagnosis_time",
        now.alias("load_time"),
    )


def signal_series(
    readings: DataFrame, tags: DataFrame, as_of: AsOf, lookback: str = "1 HOUR", bucket: str = "1 minute"
) -> DataFrame:
    """Per-tag series with late, flat-line and missing-heartbeat flags (18 columns).

    Group size is bounded by one tag's readings per bucket; everything combines map-side.
    """
    keys = ("tenant_id", "asset_id", "component_id", "tag_id", "metric_name", "bucket_minute")
    recent = with_bucket(readings.filter(since("event_time", as_of, lookback)), "event_time", bucket, "bucket_minute")
    s = recent.groupBy(*keys).agg(
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("event_time", "event_id"))).alias("last_value"),
        F.count(F.lit(1)).alias("event_count"),
        flags_text().alias("quality_flags"),
    )
    t = tags.select("tenant_id", "tag_id", "normal_range_min", "normal_range_max", "sampling_rate_seconds")
    rate_hz = F.lit(1.0) / F.nullif(F.col("sampling_rate_seconds"), F.lit(0.0))
    bucket_seconds = F.expr(f"timestampdiff(SECOND, DATE'2000-01-01', DATE'2000-01-01' + INTERVAL {bucket})")
    sparse = (rate_hz > 0) & (F.col("event_count") < rate_hz * bucket_seconds * 0.5)
    return s.join(t, ["tenant_id", "tag_id"], "left").select(
        *keys,
        "avg_value",
        "min_value",
        "max_value",
        "last_value",
        "event_count",
        "quality_flags",
        F.col("quality_flags").contains("late").alias("has_late_arrival"),
        F.coalesce((F.col("min_value") == F.col("max_value")) & (F.col("event_count") > 1), F.lit(False)).alias(
            "has_flatline"
        ),
        F.coalesce(sparse, F.lit(False)).alias("has_missing_heartbeat"),
        "normal_range_min",
        "normal_range_max",
        as_of_column(as_of).alias("load_time"),
    )


def anomaly_enriched(
    anomalies: DataFrame,
    assets: DataFrame,
    components: DataFrame,
    failure_modes: DataFrame,
    work_orders: DataFrame,
    maintenance: DataFrame,
    as_of: AsOf,
    lookback: str = "30 DAYS",
) -> DataFrame:
    """Anomalies with asset, component and failure-mode names and related-record flags (20 columns).

    The related-record flags ignore time: any work order or maintenance of the asset counts.
    Everything known per asset is stacked into one row, so anomalies meet it in one join.
    """
    side = (
        stack(
            assets.select(*ASSET, F.col("asset_name").alias("current_name")),
            work_orders.select(*ASSET, F.lit(True).alias("has_work_order")),
            maintenance.select(*ASSET, F.lit(True).alias("has_maintenance")),
        )
        .groupBy(*ASSET)
        .agg(*[F.max(c).alias(c) for c in ("current_name", "has_work_order", "has_maintenance")])
    )
    c = components.select("tenant_id", "component_id", "component_type")
    fm = failure_modes.groupBy("failure_mode_id").agg(F.max("label").alias("failure_mode_label"))
    a = anomalies.filter(since("window_start", as_of, lookback)).withColumn("failure_mode_id", F.col("fault_type"))
    df = (
        a.join(side, list(ASSET), "left")
        .join(c, ["tenant_id", "component_id"], "left")
        .join(fm, "failure_mode_id", "left")
    )
    no = F.lit(False)
    return df.select(
        "anomaly_id",
        "tenant_id",
        "window_start",
        "window_end",
        "asset_id",
        F.coalesce("current_name", "asset_name").alias("asset_name"),
        "component_type",
        "tag_id",
        "metric_name",
        "rule_id",
        "severity",
        "observed_value",
        "expected_value",
        "detection_confidence",
        F.array_join("quality_flags", "|").alias("quality_flags"),
        "failure_mode_id",
        F.coalesce("failure_mode_label", F.lit("")).alias("failure_mode_label"),
        F.coalesce("has_work_order", no).alias("has_related_workorder"),
        F.coalesce("has_maintenance", no).alias("has_related_maintenance"),
        as_of_column(as_of).alias("load_time"),
    )


def diagnosis_kpi(diagnoses: DataFrame, as_of: AsOf, lookback: str = "24 HOURS") -> DataFrame:
    """Diagnosis counts and mean confidence per asset (12 columns)."""
    recent = diagnoses.filter(since("created_at", as_of, lookback))
    counts = {
        "diagnosis_count_24h": F.lit(True),
        "high_risk_diagnosis_count_24h": F.col("risk_level") == "high",
        "critical_risk_diagnosis_count_24h": F.col("risk_level") == "critical",
        "escalation_required_count_24h": F.col("escalation_required"),
        "diagnosis_with_quality_caveats_24h": F.col("quality_caveats") != "",
        "diagnosis_linked_to_anomaly_count_24h": F.col("anomaly_id").isNotNull(),
    }
    per_id = recent.groupBy(*ASSET, "diagnosis_id").agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()],
        F.sum("confidence").alias("_sum"),
        F.count("confidence").alias("_n"),
        F.max("created_at").alias("latest_diagnosis_time"),
    )
    now = as_of_column(as_of)
    out = per_id.groupBy(*ASSET).agg(
        *[F.count_if(F.col(n) & F.col("diagnosis_id").isNotNull()).alias(n) for n in counts],
        (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("avg_confidence_24h"),
        F.max("latest_diagnosis_time").alias("latest_diagnosis_time"),
    )
    return out.select(
        *ASSET,
        now.alias("snapshot_time"),
        "diagnosis_count_24h",
        "high_risk_diagnosis_count_24h",
        "critical_risk_diagnosis_count_24h",
        "escalation_required_count_24h",
        "avg_confidence_24h",
        "diagnosis_with_quality_caveats_24h",
        "diagnosis_linked_to_anomaly_count_24h",
        "latest_diagnosis_time",
        now.alias("load_time"),
    )


HEALTH_SOURCES = ("kafka", "flink", "clickhouse")


def stream_health(
    health: DataFrame, late: DataFrame, dead_letters: DataFrame, as_of: AsOf, lookback: str = "5 MINUTES"
) -> DataFrame:
    """Health per tenant and job, one row per source label (12 columns).  The labels share one
    aggregate, which is repeated per label."""
    now = as_of_column(as_of)
    sh = (
        health.filter(since("observed_at", as_of, lookback))
        .groupBy("tenant_id", "job_name")
        .agg(
            F.count(F.lit(1)).alias("message_count_5m"),
            F.max("watermark_lag_seconds").alias("event_lag_seconds"),
            F.avg("watermark_lag_seconds").alias("ingest_lag_seconds"),
            F.count_if(F.col("late_event_count") > 0).alias("missing_heartbeat_count"),
        )
    )

    def counted(df: DataFrame, name: str) -> DataFrame:
        recent = df.filter(since("event_time", as_of, lookback))
        return recent.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name))

    side = stack(counted(late, "late_event_count_5m"), counted(dead_letters, "dlq_count_5m")).groupBy("tenant_id").agg(
        F.max("late_event_count_5m").alias("late_event_count_5m"), F.max("dlq_count_5m").alias("dlq_count_5m")
    )
    df = sh.join(side, "tenant_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("late_event_count_5m", "dlq_count_5m")}
    )
    status = (
        F.when((F.col("event_lag_seconds") > 300) | (F.col("dlq_count_5m") > 0), "critical")
        .when(F.col("event_lag_seconds") > 60, "degraded")
        .otherwise("healthy")
    )
    return df.select(
        "tenant_id",
        F.explode(F.array(*[F.lit(s) for s in HEALTH_SOURCES])).alias("source_system"),
        F.col("job_name").alias("pipeline_name"),
        now.alias("snapshot_time"),
        "message_count_5m",
        "late_event_count_5m",
        "missing_heartbeat_count",
        "dlq_count_5m",
        "event_lag_seconds",
        "ingest_lag_seconds",
        status.alias("health_status"),
        now.alias("load_time"),
    )


def failure_evidence(
    failures: DataFrame,
    work_orders: DataFrame,
    maintenance: DataFrame,
    components: DataFrame,
    as_of: AsOf,
    lookback: str = "30 DAYS",
) -> DataFrame:
    """Suspected and confirmed failures, work orders and maintenance per component (14 columns)."""
    keys = (*ASSET, "component_id")
    now = as_of_column(as_of)
    f = distinct_counts(
        failures.filter(since("occurred_at", as_of, lookback) | since("detected_at", as_of, lookback)),
        keys,
        "failure_event_id",
        {
            "suspected_failure_count": F.col("event_status") == "suspected",
            "confirmed_failure_count": F.col("event_status") == "confirmed",
        },
        {"latest_failure_time": F.col("occurred_at")},
    )
    created = since("created_at", as_of, lookback)
    w = distinct_counts(
        work_orders.filter(created | since("completed_at", as_of, lookback)),
        keys,
        "work_order_id",
        {
            "open_workorder_count": created & (F.col("work_order_status") != "completed"),
            "completed_workorder_count": created & (F.col("work_order_status") == "completed"),
        },
        {"latest_workorder_time": F.when(created, F.col("created_at"))},
    )
    about_sensor = F.col("maintenance_reason").contains("sensor") | F.col("maintenance_type").contains("sensor")
    m = distinct_counts(
        maintenance.filter(since("performed_at", as_of, lookback)),
        keys,
        "maintenance_id",
        {"maintenance_count": F.lit(True), "sensor_related_maintenance_count": about_sensor},
        {"latest_maintenance_time": F.col("performed_at")},
    )
    counts = (
        "suspected_failure_count confirmed_failure_count open_workorder_count completed_workorder_count "
        "maintenance_count sensor_related_maintenance_count"
    ).split()
    times = ("latest_failure_time", "latest_workorder_time", "latest_maintenance_time")
    base = stack(f, w, m, components.select(*keys)).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in (*counts, *times)]
    )
    return base.filter(F.col("asset_id") != "").select(
        *keys, now.alias("snapshot_time"), *[_zero(c) for c in counts], *times, now.alias("load_time")
    )


def condition_series(
    readings: DataFrame,
    anomalies: DataFrame,
    tags: DataFrame,
    as_of: AsOf,
    lookback: str = "1 HOUR",
    bucket: str = "1 minute",
) -> DataFrame:
    """Condition per asset and minute from active tags and anomalies (12 columns)."""
    keys = (*ASSET, "window_start")
    s = active_tags(
        with_bucket(readings.filter(since("event_time", as_of, lookback)), "event_time", bucket, "window_start"), keys
    ).drop("last_event_time")
    recent = anomalies.filter(since("window_start", as_of, lookback)).withColumnRenamed("window_start", "_at")
    a = (
        with_bucket(recent, "_at", bucket, "window_start")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.count_if(F.col("severity") == "critical").alias("critical_count"),
            F.count_if(F.col("severity") == "warning").alias("warning_count"),
            flags_text().alias("quality_flags"),
        )
    )
    measures = ("active_count", "anomaly_count", "critical_count", "warning_count", "quality_flags")
    both = stack(s, a).groupBy(*keys).agg(*[F.max(m).alias(m) for m in measures])
    df = both.join(expected_tags(tags), list(ASSET), "left").withColumn("active_tags", F.coalesce("active_count", F.lit(0)))
    df = df.withColumn(
        "stale_tags", F.greatest(F.coalesce("total_expected", F.lit(0)) - F.col("active_tags"), F.lit(0))
    )
    status = (
        F.when(F.col("critical_count") > 0, "critical")
        .when(F.col("warning_count") > 0, "warning")
        .when((F.col("active_tags") == 0) | (F.col("stale_tags") > 0), "unknown")
        .otherwise("healthy")
    )
    return df.filter(F.col("asset_id") != "").select(
        *keys,
        (F.col("window_start") + F.expr(f"INTERVAL {bucket}")).alias("window_end"),
        status.alias("condition_status"),
        _zero("critical_count"),
        _zero("warning_count"),
        _zero("anomaly_count"),
        "active_tags",
        "stale_tags",
        "quality_flags",
        as_of_column(as_of).alias("load_time"),
    )


# Units shown where the mapping has none.
DEFAULT_UNITS = {"temperature": "celsius", "power_draw": "kW", "pressure": "bar", "flow_rate": "m3/h", "vibration": "mm/s"}


def signal_trend(series: DataFrame, assets_feed: DataFrame, tags_feed: DataFrame, tag_unit: str = "unit") -> DataFrame:
    """Series with asset and tag attributes (26 columns); the newest feed row gives each attribute."""
    a = assets_feed.groupBy(*ASSET).agg(
        *[F.max_by(c, "updated_at").alias(c) for c in ("asset_name", "site_id", "line_id")]
    )
    t = tags_feed.groupBy(*ASSET, "tag_id").agg(
        F.max_by(tag_unit, "updated_at").alias("_unit"),
        *[F.max_by(c, "updated_at").alias(c) for c in ("tag_name", "source_system", "measurement_point")],
    )
    default = F.lit("")
    for metric, unit in DEFAULT_UNITS.items():
        default = F.when(F.col("metric_name") == metric, F.lit(unit)).otherwise(default)
    df = series.join(t, [*ASSET, "tag_id"], "left").join(a, list(ASSET), "left")
    return df.select(
        "tenant_id",
        "asset_id",
        "asset_name",
        "site_id",
        "line_id",
        "component_id",
        "tag_id",
        "tag_name",
        "metric_name",
        F.coalesce(F.nullif("_unit", F.lit("")), default).alias("unit"),
        "source_system",
        "measurement_point",
        F.col("bucket_minute").alias("signal_time"),
        F.col("avg_value").alias("signal_value"),
        "min_value",
        "max_value",
        "last_value",
        "event_count",
        "normal_range_min",
        "normal_range_max",
        "quality_flags",
        "has_late_arrival",
        "has_flatline",
        "has_missing_heartbeat",
        F.concat(F.col("tag_id"), F.lit(" / "), F.col("metric_name")).alias("series_name"),
        "load_time",
    )
