"""Inspection and report queries over landed tables and marts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.functions.times import AsOf, as_of_column
from plantpulse.operators.latest import insert_new_only, representative


def tenant_slice(df: DataFrame, tenant: str) -> DataFrame:
    """Rows of one tenant (a bare equality, so scans and partitions can be pruned)."""
    return df.filter(F.col("tenant_id") == tenant)


def recent_rows(df: DataFrame, time_col: str, ties: Sequence[str], n: int = 10) -> DataFrame:
    """Newest ``n`` rows: a top-k, never a full sort."""
    return df.orderBy(F.col(time_col).desc_nulls_last(), *[F.col(t).asc() for t in ties]).limit(n)


def top_by(df: DataFrame, measure: Column, ties: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(measure.desc(), *[F.col(t).asc() for t in ties]).limit(n)


def triage_queue(anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """Newest anomalies to triage."""
    return recent_rows(anomalies, "window_start", ["anomaly_id"], limit)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return _stacked(tables, lambda df: df.agg(F.count(F.lit(1)).alias("row_count")))


def time_ranges(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last time per table."""
    out = None
    for name, (df, col) in tables.items():
        row = df.agg(F.min(col).alias("min_time"), F.max(col).alias("max_time"))
        row = row.select(F.lit(name).alias("table_name"), "min_time", "max_time")
        out = row if out is None else out.unionByName(row)
    return out


def cdc_op_distribution(feeds: dict[str, DataFrame]) -> DataFrame:
    return _stacked(feeds, lambda df: df.groupBy("cdc_op").agg(F.count(F.lit(1)).alias("cnt")), "dim_table")


def _stacked(tables: dict[str, DataFrame], shape, label: str = "table_name") -> DataFrame:  # noqa: ANN001
    out = None
    for name, df in tables.items():
        rows = shape(df)
        rows = rows.select(F.lit(name).alias(label), *rows.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def condition_distribution(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy("tenant_id", "condition_status").agg(F.count(F.lit(1)).alias("asset_count"))


def evidence_totals(failure_evidence: DataFrame) -> DataFrame:
    sums = {
        "total_suspected": "suspected_failure_count",
        "total_confirmed": "confirmed_failure_count",
        "total_open_wo": "open_workorder_count",
        "total_completed_wo": "completed_workorder_count",
        "total_maintenance": "maintenance_count",
    }
    return failure_evidence.groupBy("tenant_id").agg(*[F.sum(c).alias(n) for n, c in sums.items()])


def ingest_profile(readings: DataFrame) -> DataFrame:
    """Event counts by scenario, tenant and metric in long form, with each group's time range.

    One pass: partial counts per combination first, then one row per dimension value.
    """
    combos = readings.groupBy("scenario", "tenant_id", "metric_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi")
    )
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.coalesce(F.col(c), F.lit("unknown")).alias("item"))
            for name, c in (("scenario", "scenario"), ("tenant", "tenant_id"), ("metric", "metric_name"))
        ],
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("item")),
    )
    return (
        combos.select(F.explode(pairs).alias("p"), "n", "lo", "hi")
        .groupBy("p.dimension", "p.item")
        .agg(
            F.sum("n").alias("event_count"), F.min("lo").alias("first_event_time"), F.max("hi").alias("last_event_time")
        )
    )


def anomaly_trend(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("tenant_id", "rule_id").agg(F.count(F.lit(1)).alias("anomaly_count"))


def late_rate(readings: DataFrame, late: DataFrame) -> DataFrame:
    """Late readings against all readings per tenant."""
    total = readings.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("event_count"))
    lates = late.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("late_event_count"))
    df = total.join(lates, "tenant_id", "left").withColumn("late_event_count", F.coalesce("late_event_count", F.lit(0)))
    return df.withColumn("late_rate", F.col("late_event_count") / F.col("event_count"))


def quality_failures(quality_events: DataFrame) -> DataFrame:
    failed = quality_events.filter(F.col("check_status") == "fail")
    return failed.groupBy("tenant_id", "check_name").agg(F.count(F.lit(1)).alias("failure_count"))


def asset_health(anomalies: DataFrame) -> DataFrame:
    """Critical anomalies per asset (assets without any are listed with 0)."""
    return anomalies.groupBy("tenant_id", "asset_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical_anomaly_count")
    )


def replay_diff(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows that differ between two runs, as multisets: empty means the replay agrees.

    Both sides are stacked with opposite signs and counted per row, which is one shuffle
    of partial counts instead of two exceptAll passes.
    """
    cols = sorted(actual.columns)
    left = actual.select(*cols).withColumn("_sign", F.lit(1))
    right = expected.select(*cols).withColumn("_sign", F.lit(-1))
    counts = left.unionByName(right).groupBy(*cols).agg(F.sum("_sign").alias("surplus"))
    return counts.filter(F.col("surplus") != 0)


# --- demonstration anomalies ----------------------------------------------------------------

# Component kinds recognised in asset names, in order of preference, and the
# anomaly templates per metric (minutes ago, duration, severity, rule, observed, expected,
# confidence, flags, failure mode, label, related work order, related maintenance).
NAME_KINDS = (
    "aerator", "clarifier", "chiller", "boiler", "fan", "pump", "compressor", "conveyor", "caster", "air handler",
)
TEMPLATES = {
    "flow_rate": [
        (300, 10, "warning", "rule_flow_drift", 82.4, 65.0, 0.78, "late_arrival=0;flatline=0",
         "fm_flow_restriction", "Flow restriction", False, False),
    ],
    "pressure": [
        (240, 10, "critical", "rule_pressure_spike", 4.8, 2.1, 0.93, "late_arrival=0;flatline=0",
         "fm_pressure_overload", "Pressure overload", True, False),
        (25, 10, "warning", "rule_pressure_spike", 3.9, 2.0, 0.81, "late_arrival=0;flatline=0",
         "fm_pressure_overload", "Pressure overload", False, False),
    ],
    "vibration": [
        (180, 10, "critical", "rule_vibration_high", 11.2, 5.5, 0.91, "late_arrival=0;flatline=1",
         "fm_bearing_wear", "Bearing wear", True, True),
        (70, 10, "warning", "rule_vibration_high", 7.1, 4.2, 0.74, "late_arrival=0;flatline=0",
         "fm_shaft_misalignment", "Shaft misalignment", False, True),
    ],
    "power_draw": [
        (130, 10, "info", "rule_power_spike", 19.8, 16.2, 0.62, "late_arrival=0;flatline=0",
         "fm_load_shift", "Load shift", False, False),
        (50, 10, "warning", "rule_power_spike", 21.4, 17.5, 0.77, "late_arrival=0;flatline=0",
         "fm_motor_drag", "Motor drag", False, False),
    ],
}
_TEMPLATE_FIELDS = (
    "minutes_ago duration_minutes severity rule_id observed_value expected_value detection_confidence quality_flags "
    "failure_mode_id failure_mode_label has_related_workorder has_related_maintenance"
).split()


def kind_of_name(name: Column) -> Column:
    out = F.lit("asset")
    for kind in reversed(NAME_KINDS):
        out = F.when(F.lower(name).contains(kind), F.lit(kind.replace(" ", "_"))).otherwise(out)
    return out


def representative_tags(trend: DataFrame) -> DataFrame:
    """One tag per tenant and templated metric: the first by asset name, asset and tag."""
    c = trend.filter(F.col("metric_name").isin(*TEMPLATES)).select(
        "tenant_id", "asset_id", "asset_name", "tag_id", "metric_name"
    )
    first = representative(c.distinct(), ["tenant_id", "metric_name"], ["asset_name", "asset_id", "tag_id"])
    return first.withColumn("component_type", kind_of_name(F.coalesce("asset_name", F.lit(""))))


def seed_anomalies(trend: DataFrame, existing: DataFrame, as_of: AsOf) -> DataFrame:
    """Demonstration anomalies on representative tags, shifted back from ``as_of``; known ids are skipped."""

    def template(row: tuple) -> Column:
        return F.struct(*[F.lit(v).alias(n) for v, n in zip(row, _TEMPLATE_FIELDS, strict=True)])

    per_metric = None
    for metric, rows in TEMPLATES.items():
        cond, arr = F.col("metric_name") == metric, F.array(*[template(r) for r in rows])
        per_metric = F.when(cond, arr) if per_metric is None else per_metric.when(cond, arr)
    base = representative_tags(trend)
    df = base.select("*", F.inline(per_metric)).withColumn("as_of", as_of_column(as_of))
    start = F.col("as_of") - F.make_dt_interval(mins=F.col("minutes_ago"))
    df = df.withColumn("window_start", start).withColumn(
        "window_end", F.col("window_start") + F.make_dt_interval(mins=F.col("duration_minutes"))
    )
    df = df.withColumn(
        "anomaly_id",
        F.concat_ws(
            "_", F.lit("seed"), "tenant_id", "metric_name", F.col("minutes_ago").cast("string"),
            F.regexp_replace("rule_id", "rule_", ""),
        ),
    )
    out = df.select(
        "anomaly_id", "tenant_id", "window_start", "window_end", "asset_id", "asset_name", "component_type", "tag_id",
        "metric_name", "rule_id", "severity", "observed_value", "expected_value", "detection_confidence",
        "quality_flags", "failure_mode_id", "failure_mode_label", "has_related_workorder", "has_related_maintenance",
    )
    return insert_new_only(out, existing, "anomaly_id")
