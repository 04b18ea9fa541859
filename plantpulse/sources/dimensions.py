"""Change-data dimensions: schema registry, typed landing, current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantpulse.functions.text import text_bool
from plantpulse.functions.times import parse_iso
from plantpulse.operators.latest import latest_by_key

# Columns of the twelve change feeds, in wire order.  A bare name is
# text; ":d" double, ":i" int, ":l" long, ":b" boolean word, ":t" nullable time,
# ":T" time where missing means the epoch.
_FEEDS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "tenants": (
        "tenant_id tenant_name region tenant_status created_at:T updated_at:T",
        ("tenant_id",),
        "updated_at",
    ),
    "assets": (
        "tenant_id asset_id asset_name asset_type asset_class parent_asset_id site_id area_id line_id "
        "functional_location criticality lifecycle_state created_at:T updated_at:T",
        ("tenant_id", "asset_id"),
        "updated_at",
    ),
    "asset_components": (
        "tenant_id component_id asset_id parent_component_id component_name component_type lifecycle_state "
        "created_at:T updated_at:T",
        ("tenant_id", "component_id"),
        "updated_at",
    ),
    "asset_signal_tags_mapping": (
        "tenant_id mapping_id asset_id component_id tag_id tag_name source_system measurement_point metric_name "
        "signal_type unit expected_unit sampling_rate_seconds:d normal_range_min:d normal_range_max:d "
        "calibration_status mapping_status valid_from:T valid_to:t created_at:T updated_at:T",
        ("tenant_id", "mapping_id"),
        "updated_at",
    ),
    "workorder": (
        "tenant_id work_order_id asset_id component_id source_system external_work_order_id work_order_type "
        "work_order_status priority title description problem_code cause_code remedy_code requested_at:t "
        "planned_start_at:t planned_end_at:t actual_start_at:t completed_at:t downtime_minutes:d technician_notes "
        "failure_mode_id:l related_anomaly_id related_tag_id created_at:T updated_at:T",
        ("tenant_id", "work_order_id"),
        "updated_at",
    ),
    "maintenance": (
        "tenant_id maintenance_id asset_id component_id work_order_id maintenance_type maintenance_status "
        "maintenance_reason maintenance_result failure_mode_id:l suspected_failure_mode confirmed_fault_description "
        "performed_by performed_at:T completed_at:t parts_used labor_hours:d downtime_minutes:d related_tag_id "
        "related_anomaly_id sensor_anomaly_related:b evidence_notes created_at:T updated_at:T",
        ("tenant_id", "maintenance_id"),
        "updated_at",
    ),
    "failuredomain": (
        "tenant_id id:l yaml_id code label description active:b created_by_id:l modified_by_id:l created_date:T "
        "modified_date:T",
        ("tenant_id", "id"),
        "modified_date",
    ),
    "failureclass": (
        "tenant_id id:l domain_id:l yaml_id code label description active:b created_by_id:l modified_by_id:l "
        "created_date:T modified_date:T",
        ("tenant_id", "id"),
        "modified_date",
    ),
    "failuremode": (
        "tenant_id id:l failure_class_id:l yaml_id code label description asset_type component_type typical_effect "
        "related_metrics active:b created_by_id:l modified_by_id:l created_date:T modified_date:T",
        ("tenant_id", "id"),
        "modified_date",
    ),
    "failureevent": (
        "tenant_id failure_event_id asset_id component_id failure_mode_id:l event_status severity occurred_at:t "
        "detected_at:T resolved_at:t source_system source_event_type source_event_id work_order_id maintenance_id "
        "related_anomaly_id related_tag_ids evidence_summary label_confidence:d created_at:T updated_at:T",
        ("tenant_id", "failure_event_id"),
        "updated_at",
    ),
    "anomaly_rule": (
        "tenant_id rule_id rule_name method asset_type component_type metric_name unit severity parameters "
        "failure_mode_id:l approval_status status owner version effective_from:T effective_to:t created_at:T "
        "updated_at:T created_by updated_by",
        ("tenant_id", "rule_id"),
        "updated_at",
    ),
    "threshold_profiles": (
        "tenant_id profile_id rule_id profile_name asset_type component_type metric_name unit normal_range_min:d "
        "normal_range_max:d warning_min:d warning_max:d critical_min:d critical_max:d parameters status version "
        "effective_from:T effective_to:t created_at:T updated_at:T",
        ("tenant_id", "profile_id"),
        "updated_at",
    ),
}

DIMENSIONS = tuple(_FEEDS)


def _fields(name: str) -> list[tuple[str, str]]:
    return [(f.split(":")[0], f.split(":")[1] if ":" in f else "s") for f in _FEEDS[name][0].split()]


def feed_schema(name: str) -> T.StructType:
    """Wire schema of a change feed: text fields plus the delete mark."""
    names = [n for n, _ in _fields(name)] + ["__deleted"]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def feed_kinds(name: str) -> dict[str, str]:
    """Columns of a feed with their kinds: "s" text, the others as in the list of feeds."""
    return dict(_fields(name))


def dimension_key(name: str) -> list[str]:
    return list(_FEEDS[name][1])


def dimension_version(name: str) -> str:
    return _FEEDS[name][2]


def _typed(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind == "d":
        return c.try_cast("double")
    if kind == "i":
        return c.try_cast("int")
    if kind == "l":
        return c.try_cast("bigint")
    if kind == "b":
        return text_bool(c)
    if kind == "t":
        return parse_iso(c)
    if kind == "T":
        return F.coalesce(parse_iso(c), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return c


def land_changes(changes: DataFrame, name: str) -> DataFrame:
    """Typed landing of one change feed; delete records are skipped, unreadable values become NULL
    (or the epoch where a time is mandatory).  Narrow, so batch and stream share it."""
    kept = changes.filter(F.coalesce(F.col("__deleted"), F.lit("false")) != "true")
    have = set(changes.columns)
    return kept.select(
        *[
            (_typed(n, k) if n in have else F.lit(None).cast("string")).alias(n)
            for n, k in _fields(name)
        ]
    )


def with_change_marks(changes: DataFrame) -> DataFrame:
    """Older feeds carry ``__op`` and ``__ts_ms``: expose them as ``cdc_op`` / ``cdc_updated_at``."""
    stamp = F.timestamp_seconds(F.floor(F.col("__ts_ms") / 1000)).cast("timestamp_ntz")
    return changes.withColumns({"cdc_op": F.col("__op"), "cdc_updated_at": stamp}).drop("__op", "__ts_ms")


def read_dimension(spark: SparkSession, name: str, path: str, streaming: bool = False) -> DataFrame:
    """Typed rows of one dimension from JSON change files, as batch or stream."""
    reader = spark.readStream if streaming else spark.read
    return land_changes(reader.schema(feed_schema(name)).json(path), name)


def current_dimension(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Current state of one dimension: the newest landed version per key."""
    return latest_by_key(read_dimension(spark, name, path), dimension_key(name), dimension_version(name))


def failure_taxonomy(domains: DataFrame, classes: DataFrame, modes: DataFrame) -> DataFrame:
    """Failure mode with its class and domain (two equi-joins on tenant and id)."""
    d = domains.select("tenant_id", F.col("id").alias("domain_id"), F.col("code").alias("domain_code"))
    c = classes.select(
        "tenant_id", F.col("id").alias("failure_class_id"), "domain_id", F.col("code").alias("class_code")
    )
    m = modes.select(
        "tenant_id", "failure_class_id", F.col("id").alias("failure_mode_id"), F.col("code").alias("mode_code"), "label"
    )
    return m.join(c.join(d, ["tenant_id", "domain_id"]), ["tenant_id", "failure_class_id"])
