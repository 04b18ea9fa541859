"""Data-quality events and table checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.ids import key_text, sha1_id
from plantpulse.functions.text import spaced_json
from plantpulse.functions.times import AsOf, as_of_column, iso_z, whole_seconds, with_bucket

# The known checks, and the check a quality flag belongs to.
QUALITY_CHECKS = ("freshness", "completeness", "duplicate", "range", "schema_drift", "late_event", "tenant_leakage")
FLAG_CHECKS = {
    "late_event": ("late_arrival", "late_event"),
    "schema_drift": ("invalid_contract", "schema_drift"),
    "range": ("threshold_spike", "range"),
    "completeness": ("missing_heartbeat", "completeness"),
    "duplicate": ("duplicate",),
}

EVENT_COLUMNS = (
    "quality_event_id tenant_id plant_id asset_id component_id tag_id metric_name check_name quality_type check_status "
    "severity resolution_status source_event_ids observed_value expected_value expected_text window_start window_end "
    "evidence_json"
).split()


def check_of_flag(flag: Column) -> Column:
    out = None
    for check, flags in FLAG_CHECKS.items():
        cond = flag.isin(*flags)
        out = F.when(cond, F.lit(check)) if out is None else out.when(cond, F.lit(check))
    return out.otherwise(F.lit("freshness"))


def quality_rows(
    df: DataFrame,
    check_name: Column | str,
    *,
    status: Column | str,
    severity: Column | str,
    start: Column,
    end: Column,
    evidence: dict[str, Column],
    observed: Column | None = None,
    expected: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Shape rows into quality events.  The id hashes tenant, check, asset, tag, window text and evidence.

    ``expected`` may be text: its number goes to ``expected_value`` (NULL when it is none)
    and the text itself to ``expected_text``.  ``keep`` passes further columns through.
    """
    if isinstance(check_name, str) and check_name not in QUALITY_CHECKS:
        raise ValueError(f"Unknown quality check: {check_name}")

    def lit(c: Column | str) -> Column:
        return c if isinstance(c, Column) else F.lit(c)

    def own(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    text = spaced_json(**evidence)
    none = F.lit(None).cast("string")
    expected_text = none if expected is None else expected.cast("string")
    id_text = key_text(own("tenant_id"), lit(check_name), own("asset_id"), own("tag_id"), iso_z(start), iso_z(end), text)
    return df.select(
        *keep,
        sha1_id("qevt_", id_text).alias("quality_event_id"),
        "tenant_id",
        *[own(c).alias(c) for c in ("plant_id", "asset_id", "component_id", "tag_id", "metric_name")],
        lit(check_name).alias("check_name"),
        lit(check_name).alias("quality_type"),
        lit(status).alias("check_status"),
        lit(severity).alias("severity"),
        F.lit("open").alias("resolution_status"),
        F.array().cast("array<string>").alias("source_event_ids"),
        (F.lit(None) if observed is None else observed).cast("double").alias("observed_value"),
        expected_text.try_cast("double").alias("expected_value"),
        expected_text.alias("expected_text"),
        start.alias("window_start"),
        end.alias("window_end"),
        text.alias("evidence_json"),
    )


def has_tenant() -> Column:
    return F.coalesce("tenant_id", F.lit("")) != ""


def without_tenant(records: DataFrame) -> DataFrame:
    """The records no quality event can be made of, whole, with an ``error_code``: those without a tenant."""
    return records.filter(~has_tenant()).withColumn("error_code", F.lit("missing_tenant_id"))


def quality_from_flags(records: DataFrame) -> DataFrame:
    """One failed check per quality flag of an anomaly (window bounds) or reading (event time).

    Records without a tenant are in :func:`without_tenant`, for this and :func:`quality_from_late`.
    """
    start = F.col("window_start") if "window_start" in records.columns else F.col("event_time")
    end = F.col("window_end") if "window_end" in records.columns else F.col("event_time")
    r = records.filter(has_tenant()).withColumn("_flag", F.explode(F.array_sort("quality_flags")))
    r = r.drop("component_id") if "component_id" in r.columns else r
    return quality_rows(
        r,
        check_of_flag(F.col("_flag")),
        status="fail",
        severity="warning",
        start=start,
        end=end,
        evidence={"quality_flag": F.col("_flag"), "source": F.lit("quality_flags")},
    )


def with_times(events: DataFrame, as_of: AsOf, detected: str | None = None) -> DataFrame:
    """Quality events with ``created_at`` (``as_of``) and ``detected_at``: the column ``detected``, else ``as_of`` too."""
    now = as_of_column(as_of)
    return events.withColumns({"detected_at": F.coalesce(detected, now) if detected else now, "created_at": now})


def quality_from_late(late: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One failed late_event check per late reading with a tenant; ``keep`` passes further columns through."""
    late = late.filter(has_tenant())
    r = late.drop("component_id") if "component_id" in late.columns else late
    return quality_rows(
        r,
        "late_event",
        status="fail",
        severity="warning",
        start=F.col("event_time"),
        end=F.coalesce("watermark_time", "event_time"),
        evidence={"reason": F.col("reason"), "event_id": F.col("event_id")},
        observed=F.col("lateness_minutes"),
        expected=F.lit("<= allowed_lateness_minutes"),
        keep=keep,
    )


def late_id_text() -> Column:
    """What a late reading itself gives to the id of its late_event check: its times and the evidence text."""
    return key_text(
        iso_z("event_time"),
        iso_z(F.coalesce("watermark_time", "event_time")),
        spaced_json(reason=F.col("reason"), event_id=F.col("event_id")),
    )


def tenant_leak_check(observed: DataFrame, expected_tenant: str = "expected_tenant_id") -> DataFrame:
    """Pass/info where the row's tenant is the expected one, else fail/critical.

    A row without a tenant fails too.
    """
    same = F.coalesce(F.col("tenant_id") == F.col(expected_tenant), F.lit(False))
    r = observed.withColumns({"_seen": F.col("tenant_id"), "tenant_id": F.col(expected_tenant), "_same": same})
    start = F.col("window_start") if "window_start" in observed.columns else F.col("event_time")
    end = F.col("window_end") if "window_end" in observed.columns else F.col("event_time")
    r = r.drop("component_id") if "component_id" in r.columns else r
    return quality_rows(
        r,
        "tenant_leakage",
        status=F.when(F.col("_same"), F.lit("pass")).otherwise(F.lit("fail")),
        severity=F.when(F.col("_same"), F.lit("info")).otherwise(F.lit("critical")),
        start=start,
        end=end,
        evidence={"tenant_id": F.col("_seen"), "expected_tenant_id": F.col(expected_tenant)},
    )


def quality_table_checks(
    readings: DataFrame, tags: DataFrame, as_of: AsOf, expected_points: int = 15, max_age_seconds: int = 900
) -> DataFrame:
    """Failures per tenant for the named table checks: completeness (15-minute windows below the
    expected count), duplicate (event ids seen again), range (values outside the tag's normal
    range) and freshness (tags without a reading in the last ``max_age_seconds``)."""
    windows = (
        with_bucket(readings, "event_time", "15 minutes", "_w")
        .groupBy("tenant_id", "tag_id", "_w")
        .agg(F.count("value").alias("n"))
        .groupBy("tenant_id")
        .agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("n") < expected_points).alias("failed"))
    )
    copies = (
        readings.groupBy("tenant_id", "event_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tenant_id")
        .agg(F.sum("n").alias("checked"), F.sum(F.col("n") - 1).alias("failed"))
    )
    limits = tags.select("tenant_id", "tag_id", "normal_range_min", "normal_range_max")
    outside = (F.col("value") < F.col("normal_range_min")) | (F.col("value") > F.col("normal_range_max"))
    ranges = (
        readings.join(limits, ["tenant_id", "tag_id"])
        .groupBy("tenant_id")
        .agg(F.count("value").alias("checked"), F.count_if(outside).alias("failed"))
    )
    fresh = (
        readings.groupBy("tenant_id", "tag_id")
        .agg(F.max("event_time").alias("newest"))
        .groupBy("tenant_id")
        .agg(
            F.count(F.lit(1)).alias("checked"),
            F.count_if(whole_seconds(F.col("newest"), as_of_column(as_of)) > max_age_seconds).alias("failed"),
        )
    )
    parts = {"completeness": windows, "duplicate": copies, "range": ranges, "freshness": fresh}
    out = None
    for name, df in parts.items():
        row = df.select("tenant_id", F.lit(name).alias("check_name"), "checked", "failed")
        out = row if out is None else out.unionByName(row)
    status = F.when(F.col("failed") > 0, F.lit("fail")).otherwise(F.lit("pass"))
    return out.withColumn("check_status", status)
