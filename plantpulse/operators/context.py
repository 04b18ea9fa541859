"""Context of an anomaly: signal window, latest rows, asset and mapping attributes, evidence records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.operators.latest import latest_n
from plantpulse.operators.quality import late_id_text
from plantpulse.operators.series import positions

_SIGNAL = ("tenant_id", "tag_id", "metric_name")


def signal_positions(readings: DataFrame) -> DataFrame:
    """Readings with their 1-based position within (tenant, tag, metric), by time and id."""
    return positions(readings, _SIGNAL, ["event_time", "event_id"], "event_time")


def anomaly_signal_window(
    anomalies: DataFrame, readings: DataFrame, back: str = "15 MINUTES", ahead: str = "15 MINUTES"
) -> DataFrame:
    """Readings around each anomaly, from ``back`` before its start to ``ahead`` after its end.

    The window is given as a position range of the series (``first_position`` to
    ``last_position`` of :func:`signal_positions`), so overlapping windows of one busy tag
    cost one row per anomaly instead of one row per anomaly and reading.  Bounds are
    found by counting readings along the series with the bounds as markers: linear work,
    no pairs.
    """
    bounds = anomalies.select(
        "anomaly_id",
        *_SIGNAL,
        (F.col("window_start") - F.expr(f"INTERVAL {back}")).alias("signal_from"),
        (F.col("window_end") + F.expr(f"INTERVAL {ahead}")).alias("signal_to"),
    )
    markers = bounds.select(
        *_SIGNAL,
        F.inline(
            F.array(
                F.struct(F.col("signal_from").alias("at"), F.lit(0).alias("kind"), "anomaly_id", "signal_from", "signal_to"),
                F.struct(F.col("signal_to").alias("at"), F.lit(2).alias("kind"), "anomaly_id", "signal_from", "signal_to"),
            )
        ),
    )
    points = readings.select(*_SIGNAL, F.col("event_time").alias("at"), F.lit(1).alias("kind"))
    line = markers.unionByName(points, allowMissingColumns=True)
    # markers at the same instant: starts before the readings, ends after them
    counted = positions(line, _SIGNAL, ["at", "kind"], "at", counted=F.col("kind") == 1, name="seen")
    found = (
        counted.filter(F.col("kind") != 1)
        .groupBy("anomaly_id", *_SIGNAL, "signal_from", "signal_to")
        .agg(
            F.max(F.when(F.col("kind") == 0, F.col("seen"))).alias("_before"),
            F.max(F.when(F.col("kind") == 2, F.col("seen"))).alias("last_position"),
        )
    )
    return found.select(
        "anomaly_id",
        *_SIGNAL,
        "signal_from",
        "signal_to",
        (F.col("_before") + 1).alias("first_position"),
        "last_position",
        (F.col("last_position") - F.col("_before")).alias("reading_count"),
    )


def latest_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str], n: int, name: str, **made: Column
) -> DataFrame:
    """Newest ``n`` rows per key as one array, oldest first (at most ``n`` items).

    ``made`` are further fields, computed for the rows that are kept.
    """
    kept = latest_n(df.select(*dict.fromkeys([*keys, *order, *fields])), keys, order, n)
    rest = [f for f in fields if f not in order]
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *rest, *[v.alias(c) for c, v in made.items()]))).alias(name))


def latest_context(
    anomalies: DataFrame, readings: DataFrame, late: DataFrame, health: DataFrame, n: int = 5
) -> DataFrame:
    """Anomalies with the tag's newest readings and late readings and the tenant's newest health row.

    Missing context is an empty array.
    """
    window = latest_rows(
        readings, ["tenant_id", "tag_id"], ["event_time", "event_id"], ["metric_name", "value", "quality_flags"], n,
        "sensor_window",
    )
    lates = latest_rows(
        late,
        ["tenant_id", "tag_id"],
        ["event_time", "event_id"],
        ["plant_id", "asset_id", "metric_name", "watermark_time", "lateness_minutes", "reason"],
        n,
        "late_records",
        id_text=late_id_text(),
    )
    state = latest_rows(
        health,
        ["tenant_id"],
        ["observed_at", "job_name"],
        ["watermark_lag_seconds", "late_event_count", "checkpoint_status"],
        1,
        "stream_health",
    )
    # the two per-tag arrays meet first, so the anomalies are shuffled once; a health row per tenant is broadcast:
    # by a shuffle for that join a tenant's anomalies, and all that is made of them, would come to one task
    per_tag = window.join(lates, ["tenant_id", "tag_id"], "full")
    out = anomalies.join(per_tag, ["tenant_id", "tag_id"], "left").join(F.broadcast(state), "tenant_id", "left")
    return out.withColumns({c: F.coalesce(c, F.array()) for c in ("sensor_window", "late_records", "stream_health")})


_ASSET_TEXT = (
    "asset_name asset_type asset_class site_id area_id line_id functional_location component_type manufacturer model"
).split()


def anomaly_context(anomalies: DataFrame, assets: DataFrame, components: DataFrame, tags: DataFrame) -> DataFrame:
    """Asset, component and mapping attributes of each anomaly; unknown attributes are empty text."""
    a = assets.select(
        "tenant_id", "asset_id", *[c for c in _ASSET_TEXT if c in assets.columns and c != "component_type"]
    )
    c = components.select(
        "tenant_id", "component_id", *[x for x in ("component_type", "manufacturer", "model") if x in components.columns]
    )
    t = tags.select(
        "tenant_id", "tag_id", "source_system", "measurement_point", "expected_unit", "normal_range_min",
        "normal_range_max", "sampling_rate_seconds",
    )
    base = anomalies.select("anomaly_id", "tenant_id", "asset_id", "component_id", "tag_id")
    out = base.join(a, ["tenant_id", "asset_id"], "left").join(c, ["tenant_id", "component_id"], "left")
    out = out.join(t, ["tenant_id", "tag_id"], "left")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")).alias(name) if name in out.columns else F.lit("").alias(name)

    return out.select(
        "anomaly_id", "tenant_id", "asset_id", "component_id", "tag_id",
        *[text(n) for n in _ASSET_TEXT],
        *[text(n) for n in ("source_system", "measurement_point", "expected_unit")],
        "normal_range_min", "normal_range_max", "sampling_rate_seconds",
    )


# The group a record's entity (or record type) belongs to.
ENTITY_GROUPS = {
    "failure_mode": "failure_modes",
    "apm_failuremode": "failure_modes",
    "failure_event": "failure_events",
    "apm_failureevent": "failure_events",
    "work_order": "work_orders",
    "workorder": "work_orders",
    "maintenance": "maintenance_records",
    "maintenance_record": "maintenance_records",
}


def evidence_by_entity(records: DataFrame, entity: str = "entity") -> DataFrame:
    """Records with their evidence group; records of unknown kinds are left out.

    The result stays long (one row per record): an asset may have any number of them.
    """
    group = F.lit(None).cast("string")
    for kind in sorted(set(ENTITY_GROUPS.values())):
        group = F.when(F.col(entity).isin(*[k for k, v in ENTITY_GROUPS.items() if v == kind]), F.lit(kind)).otherwise(group)
    return records.withColumn("evidence_group", group).filter(F.col("evidence_group").isNotNull())
