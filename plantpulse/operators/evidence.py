"""Triage evidence: one bounded, tenant-safe record per anomaly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.ids import caveat_event_id, evidence_id, key_text, sha1_id
from plantpulse.functions.once import computed_once
from plantpulse.functions.text import lookup, sorted_set, spaced_json
from plantpulse.functions.times import iso_z
from plantpulse.operators.quality import check_of_flag
from plantpulse.operators.series import as_of_joins

EVIDENCE_VERSION = "triage_evidence.v1"
MAX_SOURCE_IDS = 10

# Fields evidence must never carry, run-books by asset type, caveats by flag.
FORBIDDEN_FIELDS = ("finding", "recommendation", "recommended_action", "root_cause")
DEFAULT_RUNBOOK = "generic_asset_triage"
RUNBOOKS = {
    "pump": "manufacturing_rotating_equipment",
    "compressor": "manufacturing_rotating_equipment",
    "motor": "manufacturing_rotating_equipment",
    "fan": "manufacturing_rotating_equipment",
    "reactor": "process_safety_sensor_checks",
    "boiler": "power_generation_vibration",
    "turbine": "power_generation_vibration",
    "furnace": "high_heat_line_checks",
    "conveyor": "industrial_asset_management_generic",
    "water_pump": "water_flow_and_pump_checks",
    "chiller": "campus_bms_checks",
    "cooling_tower": "campus_bms_checks",
    "air_handler": "campus_bms_checks",
    "transformer": "power_generation_vibration",
    "heat_exchanger": "high_heat_line_checks",
    "valve": "process_safety_sensor_checks",
    "centrifuge": "manufacturing_rotating_equipment",
    "mixer": "process_safety_sensor_checks",
}
FLAG_CAVEATS = {
    "late_arrival": "Data contains late-arriving events during the anomaly window.",
    "missing_heartbeat": "Sensor heartbeat missing during the anomaly window.",
    "flatline": "Flatline (frozen sensor) detected during the anomaly window.",
    "invalid_contract": "One or more events had an invalid schema contract.",
    "gap_detected": "Data gap detected in the anomaly window.",
    "sensor_fault_suspected": "Sensor fault suspected during the anomaly window.",
}
EMPTY_WINDOW_CAVEAT = "Signal window evidence is missing or empty."

def assert_no_forbidden(df: DataFrame) -> DataFrame:
    bad = sorted(set(FORBIDDEN_FIELDS) & set(df.columns))
    if bad:
        raise ValueError(f"evidence must not carry {bad}")
    return df


def runbook_refs(asset_type: Column | None, metric: Column) -> Column:
    """The one run-book reference of an anomaly, as an array of (runbook_id, section)."""
    book = F.lit(DEFAULT_RUNBOOK)
    if asset_type is not None:
        book = lookup(F.lower(F.coalesce(asset_type, F.lit(""))), RUNBOOKS, F.lit(DEFAULT_RUNBOOK))
    section = F.coalesce(F.nullif(metric, F.lit("")), F.lit("general" if asset_type is not None else "asset"))
    return F.array(F.struct(book.alias("runbook_id"), section.alias("section")))


def evidence_caveats(flags: Column, window_is_empty: Column) -> Column:
    """Caveat sentences of the known flags in flag order, then the empty-window caveat."""
    known = F.filter(
        F.transform(sorted_set(flags), lambda f: lookup(f, FLAG_CAVEATS)), lambda c: c.isNotNull()
    )
    extra = F.when(window_is_empty, F.array(F.lit(EMPTY_WINDOW_CAVEAT))).otherwise(F.array().cast("array<string>"))
    return F.concat(known, extra)


def quality_events_in_row(late_records: bool = True) -> Column:
    """Quality events of one anomaly row: one per flag, one per late record of its tag.

    Both lists are bounded inside the row, so the events are built in place, without
    exploding and regrouping.  Sorted by id, without repeats.  A late record brings its ``id_text``
    (:func:`quality.late_id_text`): a tag's late records are the same for all of its anomalies.
    """

    def event(check: Column, *rest: Column) -> Column:
        parts = key_text("tenant_id", check, "asset_id", "tag_id", *rest)
        return F.struct(
            sha1_id("qevt_", parts).alias("quality_event_id"),
            F.col("tenant_id").alias("tenant_id"),
            check.alias("check_name"),
            F.lit("fail").alias("check_status"),
            F.lit("warning").alias("severity"),
        )

    flags = F.transform(
        F.coalesce(F.col("quality_flags"), F.array().cast("array<string>")),
        lambda f: event(
            check_of_flag(f),
            iso_z("window_start"),
            iso_z("window_end"),
            spaced_json(quality_flag=f, source=F.lit("quality_flags")),
        ),
    )
    if not late_records:
        return F.array_sort(F.array_distinct(flags))
    lates = F.transform(F.col("late_records"), lambda r: event(F.lit("late_event"), r["id_text"]))
    return F.array_sort(F.array_distinct(F.concat(flags, lates)))


def caveat_event(caveats: Column) -> Column:
    """The single synthetic quality event of an anomaly with caveats (else no event)."""
    one = F.array(
        F.struct(
            caveat_event_id().alias("quality_event_id"),
            F.col("tenant_id").alias("tenant_id"),
            F.lit("agent_quality_flags").alias("check_name"),
            F.lit("fail").alias("check_status"),
            F.lit("warning").alias("severity"),
        )
    )
    return F.when(F.size(caveats) > 0, one).otherwise(F.filter(one, lambda _: F.lit(False)))


EVIDENCE_COLUMNS = (
    "evidence_id evidence_version tenant_id anomaly_id asset_id component_id tag_id metric_name window_start window_end "
    "observed_value baseline_value expected_value quality_flags quality_events stream_health sensor_window "
    "source_event_ids quality_event_ids failure_mode_context work_order_context runbook_refs"
).split()


def with_asset_history(
    anomalies: DataFrame,
    work_orders: DataFrame | None = None,
    maintenance: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> DataFrame:
    """Anomalies with ``work_order``, ``maintenance`` and ``failure_mode``: the newest of their asset when the anomaly began.

    ``work_orders`` needs ``work_order_id, created_at``, ``maintenance`` ``maintenance_id, performed_at`` and
    ``failures`` ``failure_mode_id, occurred_at``, each with ``tenant_id, asset_id``; what more they have comes along.
    """
    given = [
        (work_orders, "created_at", ["work_order_id"], "work_order"),
        (maintenance, "performed_at", ["maintenance_id"], "maintenance"),
        (failures, "occurred_at", ["failure_mode_id"], "failure_mode"),
    ]
    given = [x for x in given if x[0] is not None]
    return as_of_joins(anomalies, given, ["tenant_id", "asset_id"], "window_start") if given else anomalies


def triage_evidence(
    context: DataFrame,
    *,
    use_flags: bool = True,
    asset_type: str | None = None,
    failure_mode: str | None = None,
    work_order: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Evidence rows (22 columns) from anomalies with context (:func:`context.latest_context`).

    ``use_flags`` takes quality events from flags and late records; otherwise a single
    caveat event is made, and the caveats come along as ``quality_caveats``.  ``asset_type``
    names the column that selects the run-book; ``failure_mode`` / ``work_order`` name
    context columns (see :func:`with_asset_history`), ``keep`` those that stay behind the evidence.  Context joins carry the tenant, so rows of another tenant cannot
    enter.
    """
    assert_no_forbidden(context)
    caveats = evidence_caveats(F.col("quality_flags"), F.size("sensor_window") == 0)
    df = context
    if use_flags:
        df = computed_once(df, quality_events=quality_events_in_row())
    else:
        df = computed_once(df, quality_caveats=caveats)
        df = df.withColumn("quality_events", caveat_event(F.col("quality_caveats")))
    none = F.lit(None).cast("string")
    ids = F.array_sort(F.array_distinct(F.transform("quality_events", lambda q: q["quality_event_id"])))
    df = df.withColumns(
        {
            "evidence_id": evidence_id(EVIDENCE_VERSION),
            "evidence_version": F.lit(EVIDENCE_VERSION),
            "quality_flags": sorted_set(F.col("quality_flags")),
            "source_event_ids": F.slice(sorted_set(F.col("source_event_ids")), 1, MAX_SOURCE_IDS),
            "quality_event_ids": ids,
            "failure_mode_context": F.col(failure_mode) if failure_mode else none,
            "work_order_context": F.col(work_order) if work_order else none,
            "runbook_refs": runbook_refs(F.col(asset_type) if asset_type else None, F.col("metric_name")),
        }
    )
    extra = [] if use_flags else ["quality_caveats"]
    return df.select(*EVIDENCE_COLUMNS, *extra, *keep)


def evidence_json(evidence: DataFrame) -> DataFrame:
    """Evidence with its canonical JSON text: keys in alphabetical order, nulls kept, times as ISO text."""

    def shown(name: str) -> Column:
        return iso_z(name).alias(name) if name in ("window_start", "window_end") else F.col(name)

    fields = [shown(c) for c in sorted(evidence.columns)]
    return evidence.withColumn("evidence_json", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))
