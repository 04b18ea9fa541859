"""Every query of the library over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Whole tables are read; look-backs reach over the tables' full time range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.functions.ids import anomaly_id
from plantpulse.functions.text import json_list
from plantpulse.functions.times import iso_z
from plantpulse.operators import context as ctx
from plantpulse.operators import contracts, dead_letter, detectors, enrich, health, incidents, late, latest
from plantpulse.operators import evidence as ev
from plantpulse.operators import quality, recommend, rules, scope, threshold, validate, windows
from plantpulse.plans import marts, reports
from plantpulse.sources import catalog, dimensions, logs
from plantpulse.sources import testtables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ALL_EVENTS = "31 DAYS"
ALL_ORDERS = "4000 DAYS"
NOW = "2024-02-01 00:00:00"


def query(fn: Query) -> Query:
    """Register a query under its function name; results are flattened to plain columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return flat(fn(spark, sf_dir))

    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def flat(df: DataFrame) -> DataFrame:
    """Lists of text become ``|``-joined text."""
    return df.select(*[F.array_join(c, "|").alias(c) if k == "array<string>" else F.col(c) for c, k in df.dtypes])


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round computed doubles, so that the order of summation does not show."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def as_text(df: DataFrame) -> DataFrame:
    """Records as the log carries them: every field is text."""

    def text(c: str, kind: str) -> Column:
        if kind.startswith("timestamp"):
            return iso_z(c).alias(c)
        return (json_list(F.col(c)) if kind == "array<string>" else F.col(c).cast("string")).alias(c)

    return df.select(*[text(c, k) for c, k in df.dtypes])


def number_of(col: str = "anomaly_id") -> Column:
    """The event number inside ``anom_evt_<n>``."""
    return F.substring(col, 10, 20).cast("bigint")


def enriched(s: SparkSession, d: str) -> DataFrame:
    return enrich.enrich_readings(t.readings(s, d), t.tags(s, d), t.assets(s, d), t.components(s, d))


def late_rows(s: SparkSession, d: str) -> DataFrame:
    return late.late_by_ingest_lag(t.readings(s, d).withColumnRenamed("plant_id", "site_id"))


def health_rows(s: SparkSession, d: str) -> DataFrame:
    r = t.readings(s, d)
    dead = r.filter(F.col("value").isNull())
    return health.health_snapshot(r, dead, detectors.detect_heartbeat_gap(t.measured(s, d), all_gaps=True))


def latest_context(s: SparkSession, d: str) -> DataFrame:
    return ctx.latest_context(t.anomalies(s, d), t.readings(s, d), late_rows(s, d), health_rows(s, d))


def evidence_rows(s: SparkSession, d: str) -> DataFrame:
    return ev.triage_evidence(latest_context(s, d))


def recommendation_rows(s: SparkSession, d: str) -> DataFrame:
    return recommend.recommendations(evidence_rows(s, d), F.lit("2024-02-01T00:00:00Z"))


def referring_rows(s: SparkSession, d: str) -> DataFrame:
    """Recommendations that name their evidence, so that it is built once per query."""
    return recommend.recommendations(evidence_rows(s, d), F.lit("2024-02-01T00:00:00Z"), with_reference=True)


# --- sources, landing, dimensions ---------------------------------------------------------


@query
def json_tolerant_scan(s: SparkSession, d: str) -> DataFrame:
    parsed = logs.parse_json(t.raw_json(s, d))
    return parsed.select("offset", "event_id", "tenant_id", "tag_id", "event_time", "value", "unit", "quality_flags")


@query
def upsert_latest(s: SparkSession, d: str) -> DataFrame:
    feed = t.tags_feed(s, d).select("tenant_id", "tag_id", "tag_name", "sampling_rate_seconds", "updated_at")
    cut = F.lit("2023-03-01 00:00:00").cast("timestamp_ntz")
    changes = feed.filter((F.col("updated_at") >= cut) & (F.substring("tag_id", 5, 20).cast("bigint") % 3 == 0))
    return latest.upsert_latest(feed.filter(F.col("updated_at") < cut), changes, ["tenant_id", "tag_id"], "updated_at")


@query
def land_readings(s: SparkSession, d: str) -> DataFrame:
    no = F.col("event_no").cast("bigint")
    text = as_text(t.readings(s, d)).withColumns(
        {
            "value": F.when(no % 37 == 0, F.lit("n/a")).otherwise(F.col("value")),
            "event_time": F.when(no % 89 == 0, F.lit("bad")).otherwise(F.col("event_time")),
        }
    )
    return logs.land("readings", text)


@query
def land_anomalies(s: SparkSession, d: str) -> DataFrame:
    return logs.land("anomalies", as_text(t.anomalies(s, d)))


@query
def land_late(s: SparkSession, d: str) -> DataFrame:
    return logs.land("late", as_text(late_rows(s, d)))


@query
def land_health(s: SparkSession, d: str) -> DataFrame:
    return logs.land("health", as_text(health_rows(s, d)))


@query
def land_diagnosis(s: SparkSession, d: str) -> DataFrame:
    renamed = t.diagnoses(s, d).withColumnsRenamed({"anomaly_id": "anomaly_event_id", "created_at": "generated_at"})
    return logs.land("diagnosis", as_text(renamed))


def dead_letter_log(s: SparkSession, d: str) -> DataFrame:
    """Dead letters in their landed shape."""
    r = t.raw_readings(s, d)
    path = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"$.{c}")) for c in dead_letter.REQUIRED])
    return r.withColumn("error_message", path).filter(F.col("error_message").isNotNull()).select(
        F.concat(F.lit("dlq_"), F.col("event_no").cast("string")).alias("dlq_event_id"),
        "tenant_id",
        "event_time",
        F.col("event_id").alias("raw_payload"),
        logs.topic_for("raw_sensor_events", F.col("tenant_id")).alias("original_topic"),
        F.lit("MISSING_REQUIRED_FIELD").alias("error_type"),
        "error_message",
    )


@query
def land_dlq(s: SparkSession, d: str) -> DataFrame:
    return logs.land("dlq", dead_letter_log(s, d))


@query
def cdc_land(s: SparkSession, d: str) -> DataFrame:
    return dimensions.land_changes(t.assets_cdc(s, d), "assets")


def change_feed(s: SparkSession, d: str, table: str, key: str) -> DataFrame:
    """Text rows of a change feed over a table: some deleted, some with numbers or times that cannot be read."""
    rows = t.table(s, d, table)
    k = F.col(key)
    day = F.date_format("o_orderdate" if table == "orders" else "l_shipdate", "yyyy-MM-dd'T'00:00:00'Z'")
    money = F.col("o_totalprice" if table == "orders" else "l_quantity").cast("int").cast("string")
    return rows.select(
        "*",
        t.tenant_of(k).alias("tenant_id"),
        day.alias("_day"),
        F.when(k % 19 == 0, "n/a").otherwise(money).alias("downtime_minutes"),
        F.when(k % 7 != 0, day).alias("created_at"),
        F.when(k % 5 == 0, "unknown").otherwise(k.cast("string")).alias("failure_mode_id"),
        F.when(k % 17 == 0, "true").when(k % 2 == 0, "false").alias("__deleted"),
    )


@query
def cdc_land_workorder(s: SparkSession, d: str) -> DataFrame:
    feed = change_feed(s, d, "orders", "o_orderkey").select(
        "*", t.named("wo_", "o_orderkey").alias("work_order_id"), F.col("o_orderstatus").alias("work_order_status"),
        F.col("_day").alias("requested_at"),
    )
    out = dimensions.land_changes(feed, "workorder")
    return out.select("tenant_id", "work_order_id", "work_order_status", "requested_at", "downtime_minutes", "failure_mode_id", "created_at")


@query
def cdc_land_maintenance(s: SparkSession, d: str) -> DataFrame:
    feed = change_feed(s, d, "lineitem", "l_orderkey").select(
        "*", F.concat(F.lit("mnt_"), "l_orderkey", F.lit("_"), "l_linenumber").alias("maintenance_id"),
        F.col("_day").alias("performed_at"),
        t.pick(("true", "F", "yes", "0", "maybe"), F.col("l_linenumber")).alias("sensor_anomaly_related"),
    )
    out = dimensions.land_changes(feed, "maintenance")
    return out.select(
        "tenant_id", "maintenance_id", "performed_at", "downtime_minutes", "failure_mode_id", "sensor_anomaly_related", "created_at"
    )


#: The feeds that no other query lands, each over a table of the same growth.
FEED_TABLES = {
    "tenants": ("customer", "c_custkey"),
    "asset_components": ("part", "p_partkey"),
    "asset_signal_tags_mapping": ("part", "p_partkey"),
    "failuredomain": ("supplier", "s_suppkey"),
    "failureclass": ("supplier", "s_suppkey"),
    "failuremode": ("part", "p_partkey"),
    "failureevent": ("orders", "o_orderkey"),
    "anomaly_rule": ("supplier", "s_suppkey"),
    "threshold_profiles": ("customer", "c_custkey"),
}


def two_versions(s: SparkSession, d: str, name: str) -> DataFrame:
    """Text rows of one feed: a first version of every key, a second of every third one, some of these deletes."""
    table, key = FEED_TABLES[name]
    keys = t.table(s, d, table).select(F.col(key).alias("k"))
    both = keys.withColumn("v", F.lit(0)).unionByName(keys.filter("k % 3 = 0").withColumn("v", F.lit(1)))
    k, v, own = F.col("k"), F.col("v"), dimensions.dimension_key(name)

    def text(field: str, kind: str) -> Column:
        if field == "tenant_id" and len(own) > 1:
            return t.tenant_of(k)
        if field == dimensions.dimension_version(name):
            return F.when(v == 0, "2024-01-01T00:00:00Z").otherwise("2024-06-01T00:00:00Z")
        if field in own:
            return k.cast("string") if kind == "l" else F.concat(F.lit(f"{field}_"), k)
        if kind == "s":
            return F.concat(F.lit(f"{field}_"), k, F.lit("_"), v)
        if kind == "d":
            return F.when(k % 19 == 0, "n/a").otherwise(F.concat(k % 100, F.lit(".5")))
        if kind in "il":
            return F.when(k % 5 == 0, "unknown").otherwise(k.cast("string"))
        if kind == "b":
            return t.pick(("true", "F", "yes", "0", "maybe"), k)
        return F.when(k % 7 != 0, F.concat(F.lit("2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"), F.lit("T06:00:00Z")))

    fields = [text(f, kind).alias(f) for f, kind in dimensions.feed_kinds(name).items()]
    return both.select(*fields, F.when((v == 1) & (k % 17 == 0), "true").otherwise("false").alias("__deleted"))


def _current(name: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        landed = dimensions.land_changes(two_versions(s, d, name), name)
        return latest.latest_by_key(landed, dimensions.dimension_key(name), dimensions.dimension_version(name))

    run.__name__ = f"cdc_current_{name}"
    query(run)


for _name in FEED_TABLES:
    _current(_name)


@query
def cdc_op_ts(s: SparkSession, d: str) -> DataFrame:
    marked = dimensions.with_change_marks(t.assets_cdc(s, d))
    return marked.select("tenant_id", "asset_id", "asset_name", "cdc_op", "cdc_updated_at")


@query
def latest_by_key(s: SparkSession, d: str) -> DataFrame:
    return t.tags(s, d).drop("valid_to")


@query
def insert_new_only(s: SparkSession, d: str) -> DataFrame:
    a = t.anomalies(s, d).select("anomaly_id", "tenant_id", "severity", "window_start")
    return latest.insert_new_only(a, a.filter(F.col("severity") == "warning"), "anomaly_id")


@query
def dedup_events(s: SparkSession, d: str) -> DataFrame:
    r = t.readings(s, d).select("event_id", "tenant_id", "tag_id", "event_time", "value")
    return latest.dedup_events(r.unionByName(r.filter(F.col("value") > 20)))


@query
def route_records(s: SparkSession, d: str) -> DataFrame:
    checked = contracts.contract_errors(t.raw_json(s, d))
    named = checked.withColumns(
        {c: F.get_json_object("value", f"$.{c}") for c in ("tenant_id", "tag_id")}
    )
    tenants = t.tags(s, d).select("tenant_id").distinct().filter(F.col("tenant_id") != "tenant_c")
    sent = logs.with_payload(logs.route_records(named, tenants), now=F.lit("2024-02-01").cast("timestamp_ntz"))
    in_dead = lambda path: F.when(~F.col("valid"), F.get_json_object("payload", path))
    return sent.select(
        "offset",
        "valid",
        "topic",
        "key",
        in_dead("$.field_path").alias("dead_path"),
        in_dead("$.validation_time").alias("dead_time"),
        F.when(F.col("valid"), F.get_json_object("payload", "$.event_id")).otherwise(F.get_json_object("payload", "$.original_record.event_id")).alias("sent_event"),
    )


@query
def restamp_times(s: SparkSession, d: str) -> DataFrame:
    r = t.raw_readings(s, d).select("event_id", "event_time", "ingest_time")
    stamp = F.lit("2024-02-01T00:00:00Z")
    both = logs.restamp_times(r, "backfill_replay", stamp).unionByName(logs.restamp_times(r, "realtime_live", stamp))
    mode = F.col("synthetic_metadata")["producer_mode"].alias("producer_mode")
    return both.select("event_id", "event_time", "ingest_time", mode)


def plants(s: SparkSession, d: str) -> DataFrame:
    even = F.col("s_suppkey") % 2 == 0
    return t.table(s, d, "supplier").select(
        t.tenant_of(F.col("s_suppkey")).alias("tenant_id"),
        t.named("plant_p", "s_suppkey").alias("plant_id"),
        F.when(even, t.strings("pump", "boiler")).otherwise(t.strings("chiller", "pump", "conveyor")).alias("asset_types"),
        F.when(even, t.strings("temperature", "vibration", "pressure"))
        .otherwise(t.strings("pressure", "flow_rate"))
        .alias("expected_metrics"),
        F.when(even, t.strings("celsius", "mm_s", "bar")).otherwise(t.strings("bar", "m3_h")).alias("units"),
        (F.col("s_nationkey") % 4 + 1).cast("int").alias("assets"),
        F.lit("thr_generic").alias("threshold_profile_id"),
    )


def points(s: SparkSession, d: str) -> DataFrame:
    type_no = F.array_position(F.array(*[F.lit(p) for p in t.PART_TYPES]), F.col("p_type")).cast("bigint") - 1
    metric, unit = t.pick(t.METRICS, type_no), t.pick(t.UNITS, type_no)
    return t.table(s, d, "part").select(
        t.pick(t.ASSET_TYPES, F.col("p_size")).alias("asset_type"),
        F.lower("p_type").alias("component_type"),
        F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("measurement_point"),
        metric.alias("metric_name"),
        F.concat_ws("_", metric, unit).alias("tag_suffix"),
        unit.alias("unit"),
    ).distinct()


@query
def measurement_point_ids(s: SparkSession, d: str) -> DataFrame:
    return catalog.measurement_point_ids(points(s, d))


@query
def tag_catalog(s: SparkSession, d: str) -> DataFrame:
    return catalog.tag_catalog(plants(s, d), points(s, d))


@query
def dims_from_tags(s: SparkSession, d: str) -> DataFrame:
    a, c, p = catalog.dims_from_tags(catalog.tag_catalog(plants(s, d), points(s, d)))
    rows = [
        a.select(F.lit("asset").alias("kind"), F.col("asset_id").alias("id"), F.col("asset_name").alias("label"), "criticality"),
        c.select(F.lit("component").alias("kind"), F.col("component_id").alias("id"), F.col("component_type").alias("label"),
                 "criticality"),
        p.select(F.lit("point").alias("kind"), F.col("measurement_point_id").alias("id"),
                 F.col("measurement_point").alias("label"), F.lit(None).cast("string").alias("criticality")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def rules_per_tenant(s: SparkSession, d: str) -> DataFrame:
    tenants = t.readings(s, d).select("tenant_id").distinct()
    return rules.rules_per_tenant(rules.shipped_rules(s), tenants)


@query
def failure_taxonomy(s: SparkSession, d: str) -> DataFrame:
    return dimensions.failure_taxonomy(*t.taxonomy(s, d))


# --- filters, predicates, validation ------------------------------------------------------


@query
def tenant_slice(s: SparkSession, d: str) -> DataFrame:
    return reports.tenant_slice(t.readings(s, d), "tenant_a").select("event_id", "tenant_id", "tag_id", "event_time", "value")


@query
def threshold_flag(s: SparkSession, d: str) -> DataFrame:
    return threshold.flag_breaches(t.readings(s, d))


@query
def dead_letter_missing(s: SparkSession, d: str) -> DataFrame:
    out = dead_letter.missing_required(t.raw_readings(s, d))
    return out.select(
        F.get_json_object("original_record", "$.event_id").alias("event_id"),
        "error_code", "field_path", "message", "schema_name", "schema_version",
    )


def _error_codes() -> Column:
    codes = F.transform("errors", lambda e: F.concat(e["field_path"], F.lit(":"), e["error_code"]))
    return F.array_join(codes, ",")


def _checked(lines: DataFrame, contract: dict) -> DataFrame:
    return contracts.contract_errors(lines, contract).select(
        "offset", "error_code", "field_path", F.size("errors").alias("error_count"), _error_codes().alias("all_errors")
    )


@query
def contract_errors(s: SparkSession, d: str) -> DataFrame:
    return _checked(t.raw_json(s, d), contracts.RAW_READING)


@query
def contract_errors_dlq(s: SparkSession, d: str) -> DataFrame:
    """Dead-letter records: objects as array items, with the element in the path."""
    return _checked(t.dead_letter_json(s, d), contracts.DEAD_LETTER)


@query
def contract_errors_work_order(s: SparkSession, d: str) -> DataFrame:
    """Work orders: array items, a nested object and one of any fields with numbers."""
    return _checked(t.work_order_json(s, d), contracts.WORK_ORDER)


@query
def contract_split(s: SparkSession, d: str) -> DataFrame:
    accepted, rejected = contracts.contract_split(t.raw_json(s, d))
    fine = accepted.select("offset", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("error_code"))
    return fine.unionByName(rejected.select("offset", F.lit(False).alias("accepted"), "error_code"))


@query
def contract_summary(s: SparkSession, d: str) -> DataFrame:
    return contracts.contract_summary(t.raw_json(s, d))


@query
def enrich_rejects(s: SparkSession, d: str) -> DataFrame:
    r = t.readings(s, d)
    moved = F.when(F.col("event_no") % 83 == 0, F.lit("tenant_x")).otherwise(F.col("tenant_id"))
    _, bad = enrich.enrich_checked(r.withColumn("tenant_id", moved), t.tags(s, d), t.assets(s, d), t.components(s, d))
    return bad.drop("original_record")


@query
def anomaly_quarantine(s: SparkSession, d: str) -> DataFrame:
    no = number_of()
    a = t.anomalies(s, d).withColumns(
        {
            "component_id": F.when(no % 13 != 0, F.col("component_id")),
            "severity": F.when(no % 17 != 0, F.col("severity")),
        }
    )
    checked = validate.quarantine_anomalies(a, tenant="tenant_a")
    return checked.select("anomaly_id", "tenant_id", "missing_fields", "quarantine_reason")


@query
def tenant_leak_check(s: SparkSession, d: str) -> DataFrame:
    a = t.anomalies(s, d).withColumn("expected_tenant_id", F.col("tenant_id"))
    a = a.withColumn("tenant_id", F.when(number_of() % 19 == 0, F.lit("tenant_x")).otherwise(F.col("tenant_id")))
    return quality.tenant_leak_check(a).select(
        "quality_event_id", "tenant_id", "check_name", "check_status", "severity", "evidence_json"
    )


@query
def resolve_severity(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    profile = F.when(k % 4 == 0, F.lit("critical")).when(k % 4 == 1, F.lit("*")).when(k % 4 == 2, F.lit(""))
    rule = F.when(k % 3 == 0, F.lit("info")).when(k % 3 == 1, F.lit("*"))
    params = F.when(k % 5 == 0, F.create_map(F.lit("severity"), F.lit("critical")))
    return t.table(s, d, "part").select("p_partkey", detectors.resolve_severity(profile, rule, params).alias("severity"))


@query
def resolve_fault_type(s: SparkSession, d: str) -> DataFrame:
    no = F.col("event_no")
    flags = F.when(no % 6 == 0, t.strings("Sensor_Stuck")).otherwise(F.col("quality_flags"))
    param = (
        F.when(no % 4 == 1, F.lit("sensor_fault"))
        .when(no % 4 == 2, F.lit("operating_context_change"))
        .when(no % 4 == 3, F.lit("other"))
    )
    return t.readings(s, d).select("event_id", detectors.resolve_fault_type(flags, param).alias("fault_type"))


@query
def feedback_validate(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.table(s, d, "orders").select(
        t.named("fb_", "o_orderkey").alias("feedback_id"),
        F.lit("tenant_a").alias("tenant_id"),
        F.when(k % 23 != 0, t.named("inc_", "o_custkey")).alias("incident_id"),
        t.named("anom_", "o_orderkey").alias("anomaly_id"),
        F.when(k % 29 != 0, F.lit("operator")).alias("operator_id"),
        (k % 2 == 0).alias("is_true_positive"),
        t.pick(("none", "info", "warning", "critical", "fatal"), k).alias("severity_correction"),
        (k % 7).cast("int").alias("explanation_usefulness"),
        F.col("o_orderpriority").alias("resolution_note"),
        F.col("o_orderdate").alias("created_at"),
    )
    return validate.validate_feedback(rows).select("feedback_id", "severity_correction", "reject_reason")


def tampered(s: SparkSession, d: str) -> DataFrame:
    """Recommendations with faults spread by event number, keyed by the evidence they answer."""
    r = referring_rows(s, d).withColumns({"evidence_key": F.col("anomaly_id"), "evidence_tenant": F.col("tenant_id")})
    no = number_of("evidence_key")
    return r.withColumns(
        {
            "tenant_id": F.when(no % 11 == 0, F.lit("tenant_x")).otherwise(F.col("tenant_id")),
            "anomaly_id": F.when(no % 13 == 0, F.lit("anom_other")).otherwise(F.col("anomaly_id")),
            "evidence_version": F.when(no % 17 == 0, F.lit("v0")).otherwise(F.col("evidence_version")),
            "findings": F.when(no % 19 == 0, F.array().cast("array<string>")).otherwise(F.col("findings")),
            "runbook_references": F.when(no % 23 == 0, t.strings("other#book")).otherwise(F.col("runbook_references")),
            "summary": F.when(no % 7 == 0, F.lit("Automatic Remediation done.")).otherwise(F.col("summary")),
        }
    )


@query
def recommendation_validate(s: SparkSession, d: str) -> DataFrame:
    out = validate.validate_recommendations(tampered(s, d))
    return out.select("evidence_key", "validation_status", "quarantine_reason")


@query
def diagnosis_validate(s: SparkSession, d: str) -> DataFrame:
    out = validate.validate_diagnoses(tampered(s, d))
    return out.select("evidence_key", "validation_status", "failure_reasons", "quarantine_id")


@query
def diagnosis_project(s: SparkSession, d: str) -> DataFrame:
    return validate.diagnosis_events(recommendation_rows(s, d), now()).drop("evidence")


# --- enrichment, late, dead letters, health -----------------------------------------------


@query
def enrich_readings(s: SparkSession, d: str) -> DataFrame:
    return enriched(s, d)


@query
def late_by_ingest_lag(s: SparkSession, d: str) -> DataFrame:
    return late.late_by_ingest_lag(enriched(s, d))


@query
def late_by_watermark(s: SparkSession, d: str) -> DataFrame:
    return late.late_by_watermark(t.readings(s, d))


@query
def health_snapshot(s: SparkSession, d: str) -> DataFrame:
    return health_rows(s, d)


# --- features and detectors ---------------------------------------------------------------

SUMMARY = "anomaly_id observed_value baseline_value expected_value detection_confidence".split()


def shown(df: DataFrame) -> DataFrame:
    return rounded(df.drop("quality_event_ids"), *SUMMARY[1:4])


@query
def anomaly_ids(s: SparkSession, d: str) -> DataFrame:
    at = iso_z("event_time")
    return t.readings(s, d).select("event_id", anomaly_id("threshold_spike", at, at).alias("anomaly_id"))


@query
def detector_features(s: SparkSession, d: str) -> DataFrame:
    f = detectors.detector_features(t.measured(s, d))
    return rounded(
        f.drop(*detectors._PASSENGERS), "rolling_baseline_mean", "rolling_baseline_stddev", "window_stddev", "gap_minutes"
    )


@query
def detect_spike(s: SparkSession, d: str) -> DataFrame:
    return shown(detectors.detect_spike(t.measured(s, d)))


@query
def detect_zscore(s: SparkSession, d: str) -> DataFrame:
    return shown(detectors.detect_zscore(t.measured(s, d), 1.5))


@query
def detect_drift(s: SparkSession, d: str) -> DataFrame:
    return shown(detectors.detect_drift(t.measured(s, d), 0.2))


@query
def detect_heartbeat_gap(s: SparkSession, d: str) -> DataFrame:
    return shown(detectors.detect_heartbeat_gap(t.measured(s, d)))


@query
def detect_flatline(s: SparkSession, d: str) -> DataFrame:
    coarse = F.floor(F.col("value") / 100) * 100.0
    return shown(detectors.detect_flatline(t.measured(s, d).withColumn("value", coarse.cast("double"))))


@query
def detect_all(s: SparkSession, d: str) -> DataFrame:
    return shown(detectors.detect_all(t.measured(s, d)))


def window_hits(s: SparkSession, d: str, verdict: detectors.Verdict) -> DataFrame:
    return shown(detectors.window_anomalies(detectors.detector_features(t.measured(s, d)), verdict))


@query
def detect_spike_window(s: SparkSession, d: str) -> DataFrame:
    return window_hits(s, d, detectors.spike_verdict(upper=F.lit(80.0), lower=F.lit(1.0)))


@query
def detect_zscore_window(s: SparkSession, d: str) -> DataFrame:
    return window_hits(s, d, detectors.zscore_verdict())


@query
def detect_drift_window(s: SparkSession, d: str) -> DataFrame:
    return window_hits(s, d, detectors.drift_verdict())


@query
def detect_heartbeat_window(s: SparkSession, d: str) -> DataFrame:
    return window_hits(s, d, detectors.heartbeat_verdict())


@query
def detect_flatline_window(s: SparkSession, d: str) -> DataFrame:
    coarse = F.floor(F.col("value") / 100) * 100.0
    f = detectors.detector_features(t.measured(s, d).withColumn("value", coarse.cast("double")))
    return shown(detectors.window_anomalies(f, detectors.flatline_verdict()))


METHODS = {
    "temperature": "static_threshold",
    "vibration": "rolling_baseline_zscore",
    "pressure": "slope_over_window",
    "flow_rate": "heartbeat_gap",
    "power_draw": "repeated_value_window",
}


def with_method(features: DataFrame) -> DataFrame:
    method = None
    for metric, name in METHODS.items():
        cond = F.col("metric_name") == metric
        method = F.when(cond, F.lit(name)) if method is None else method.when(cond, F.lit(name))
    return features.withColumn("method", method)


@query
def rules_apply(s: SparkSession, d: str) -> DataFrame:
    features = with_method(detectors.detector_features(t.measured(s, d)))
    return shown(rules.apply_rules(features, rules.shipped_rules(s)))


def profiles(s: SparkSession, d: str) -> DataFrame:
    """Threshold profiles: one open one per region's metric, one per part type and brand."""
    r = F.col("r_regionkey")
    none = F.lit(None).cast("string")
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    open_ones = t.table(s, d, "region").select(
        t.named("thr_open_", "r_regionkey").alias("profile_id"), F.lit("*").alias("tenant_id"),
        none.alias("asset_type"), none.alias("component_type"), t.pick(t.METRICS, r).alias("metric_name"),
        none.alias("unit"), F.lit(1.0).alias("critical_min"), (r * 10 + 60.0).alias("critical_max"),
    )
    brand = F.substring("p_brand", 7, 5).cast("bigint")
    own = t.table(s, d, "part").select("p_type", brand.alias("b")).distinct().select(
        F.concat_ws("_", F.lit("thr"), F.lower("p_type"), F.col("b").cast("string")).alias("profile_id"),
        t.tenant_of(F.col("b")).alias("tenant_id"), t.pick(t.ASSET_TYPES, F.col("b")).alias("asset_type"),
        F.lower("p_type").alias("component_type"), t.pick(t.METRICS, F.col("b")).alias("metric_name"),
        F.lit("*").alias("unit"), F.lit(2.0).alias("critical_min"), (F.col("b") + 40.0).alias("critical_max"),
    )
    return open_ones.unionByName(own).select(
        "*", F.lit("active").alias("status"), start.alias("effective_from"),
        F.lit(None).cast("timestamp_ntz").alias("effective_to"),
    )


@query
def threshold_profile_match(s: SparkSession, d: str) -> DataFrame:
    wide = enrich.tag_context(t.tags(s, d), t.assets(s, d), t.components(s, d)).withColumnRenamed("mapped_unit", "unit")
    found = scope.match_profiles(wide, scope.in_force(profiles(s, d), now()))
    return found.select("tenant_id", "tag_id", "metric_name", "profile_id", "critical_min", "critical_max", "named_scopes")


# --- windows ------------------------------------------------------------------------------


@query
def window_stats_15m(s: SparkSession, d: str) -> DataFrame:
    return windows.window_stats(t.measured(s, d))


@query
def window_stats_1d(s: SparkSession, d: str) -> DataFrame:
    return windows.window_stats(t.measured(s, d), "1 day")


@query
def completeness(s: SparkSession, d: str) -> DataFrame:
    return rounded(windows.completeness(t.measured(s, d)), "completeness_ratio")


# --- marts --------------------------------------------------------------------------------


def snapshot(s: SparkSession, d: str) -> DataFrame:
    return marts.condition_snapshot(
        t.anomalies(s, d), t.diagnoses(s, d), t.readings(s, d), health_rows(s, d), t.tags(s, d), t.assets(s, d),
        t.max_event_time(s, d), ALL_EVENTS,
    )


@query
def base_assets(s: SparkSession, d: str) -> DataFrame:
    return marts.base_assets(
        t.anomalies(s, d), t.diagnoses(s, d), t.readings(s, d), t.max_event_time(s, d), ALL_EVENTS
    )


@query
def stale_tags(s: SparkSession, d: str) -> DataFrame:
    return marts.stale_tags(t.tags(s, d), t.readings(s, d), t.max_event_time(s, d), "1 HOUR")


@query
def base_components(s: SparkSession, d: str) -> DataFrame:
    return marts.base_components(
        t.failure_events(s, d), t.work_orders(s, d), t.maintenance(s, d), t.components(s, d), t.max_order_time(s, d),
        ALL_ORDERS,
    )


@query
def mart_condition_snapshot(s: SparkSession, d: str) -> DataFrame:
    return snapshot(s, d)


@query
def mart_signal_1m(s: SparkSession, d: str) -> DataFrame:
    return rounded(marts.signal_series(t.readings(s, d), t.tags(s, d), t.max_event_time(s, d), ALL_EVENTS), "avg_value")


@query
def mart_signal_day(s: SparkSession, d: str) -> DataFrame:
    """The series with a look-back that leaves most readings out."""
    return rounded(marts.signal_series(t.readings(s, d), t.tags(s, d), t.max_event_time(s, d), "24 HOURS"), "avg_value")


@query
def mart_signal_6h(s: SparkSession, d: str) -> DataFrame:
    out = marts.signal_series(t.readings(s, d), t.tags(s, d), t.max_event_time(s, d), ALL_EVENTS, "6 hours")
    return rounded(out, "avg_value")


def mode_names(s: SparkSession, d: str) -> DataFrame:
    _, _, modes = t.taxonomy(s, d)
    return modes.select(F.col("code").alias("failure_mode_id"), "label")


@query
def mart_anomaly_enriched(s: SparkSession, d: str) -> DataFrame:
    mode = F.concat(F.lit("fm_economy_"), (number_of() % 30).cast("string"))
    a = t.anomalies(s, d).withColumn("fault_type", F.when(number_of() % 3 == 0, mode).otherwise(F.col("fault_type")))
    return marts.anomaly_enriched(
        a, t.assets(s, d), t.components(s, d), mode_names(s, d), t.work_orders(s, d), t.maintenance(s, d),
        t.max_event_time(s, d), ALL_EVENTS,
    )


@query
def mart_diagnosis_kpi(s: SparkSession, d: str) -> DataFrame:
    return rounded(marts.diagnosis_kpi(t.diagnoses(s, d), t.max_event_time(s, d), ALL_EVENTS), "avg_confidence_24h")


@query
def mart_diagnosis_kpi_24h(s: SparkSession, d: str) -> DataFrame:
    return rounded(marts.diagnosis_kpi(t.diagnoses(s, d), t.max_event_time(s, d), "24 HOURS"), "avg_confidence_24h")


def health_mart(s: SparkSession, d: str, lookback: str = ALL_EVENTS) -> DataFrame:
    dead = t.readings(s, d).filter(F.col("value").isNull())
    return marts.stream_health(health_rows(s, d), late_rows(s, d), dead, t.max_event_time(s, d), lookback)


@query
def mart_stream_health(s: SparkSession, d: str) -> DataFrame:
    return rounded(health_mart(s, d), "ingest_lag_seconds")


@query
def mart_stream_health_5m(s: SparkSession, d: str) -> DataFrame:
    return rounded(health_mart(s, d, "5 MINUTES"), "ingest_lag_seconds")


def failure_mart(s: SparkSession, d: str) -> DataFrame:
    return marts.failure_evidence(
        t.failure_events(s, d), t.work_orders(s, d), t.maintenance(s, d), t.components(s, d), t.max_order_time(s, d),
        ALL_ORDERS,
    )


@query
def mart_failure_evidence(s: SparkSession, d: str) -> DataFrame:
    return failure_mart(s, d)


@query
def mart_condition_1m(s: SparkSession, d: str) -> DataFrame:
    return marts.condition_series(
        t.readings(s, d), t.anomalies(s, d), t.tags(s, d), t.max_event_time(s, d), ALL_EVENTS
    )


def trend(s: SparkSession, d: str) -> DataFrame:
    series = marts.signal_series(t.readings(s, d), t.tags(s, d), t.max_event_time(s, d), ALL_EVENTS)
    return marts.signal_trend(series, t.assets_feed(s, d), t.tags_feed(s, d), "display_unit")


@query
def signal_trend(s: SparkSession, d: str) -> DataFrame:
    return rounded(trend(s, d), "signal_value")


@query
def representative_tag(s: SparkSession, d: str) -> DataFrame:
    return reports.representative_tags(trend(s, d))


@query
def seed_anomalies(s: SparkSession, d: str) -> DataFrame:
    known = t.readings(s, d).select(F.concat(F.lit("seed_"), "tenant_id", F.lit("_pressure_25_pressure_spike")).alias("anomaly_id"))
    known = known.filter(F.col("anomaly_id").startswith("seed_tenant_b"))
    return reports.seed_anomalies(trend(s, d), known, t.max_event_time(s, d))


# --- quality ------------------------------------------------------------------------------

QUALITY_SHOWN = (
    "quality_event_id tenant_id asset_id tag_id metric_name check_name check_status severity observed_value "
    "expected_text window_start window_end evidence_json"
).split()


@query
def quality_from_flags(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_from_flags(t.readings(s, d)).select(*QUALITY_SHOWN)


@query
def quality_from_late(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_from_late(late_rows(s, d)).select(*QUALITY_SHOWN)


def all_quality_events(s: SparkSession, d: str) -> DataFrame:
    leak = t.anomalies(s, d).withColumn("expected_tenant_id", F.col("tenant_id"))
    return (
        quality.quality_from_flags(t.anomalies(s, d))
        .unionByName(quality.quality_from_late(late_rows(s, d)))
        .unionByName(quality.tenant_leak_check(leak))
    )


@query
def quality_event_rows(s: SparkSession, d: str) -> DataFrame:
    """Late events are detected when they arrive; the others, and all rows' creation, at the given instant."""
    late_events = quality.with_times(quality.quality_from_late(late_rows(s, d), keep=["ingest_time"]), t.max_event_time(s, d), "ingest_time")
    flags = quality.with_times(quality.quality_from_flags(t.anomalies(s, d)), t.max_event_time(s, d))
    shown = [*QUALITY_SHOWN, "quality_type", "resolution_status", "detected_at", "created_at"]
    return late_events.select(*shown).unionByName(flags.select(*shown))


@query
def quality_events(s: SparkSession, d: str) -> DataFrame:
    return all_quality_events(s, d).select(*QUALITY_SHOWN)


@query
def quality_table_checks(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_table_checks(t.readings(s, d), t.tags(s, d), t.max_event_time(s, d))


# --- context, evidence, recommendations ---------------------------------------------------


@query
def anomaly_signal_window(s: SparkSession, d: str) -> DataFrame:
    return ctx.anomaly_signal_window(t.anomalies(s, d), t.readings(s, d), "6 HOURS", "6 HOURS")


@query
def latest_n_context(s: SparkSession, d: str) -> DataFrame:
    c = latest_context(s, d)
    ids = lambda name, f: F.transform(name, lambda r: r[f])
    return c.select(
        "anomaly_id",
        ids("sensor_window", "event_id").alias("sensor_events"),
        ids("late_records", "event_id").alias("late_events"),
        F.try_element_at("stream_health", F.lit(1))["observed_at"].alias("health_observed_at"),
    )


@query
def anomaly_context(s: SparkSession, d: str) -> DataFrame:
    return ctx.anomaly_context(t.anomalies(s, d), t.assets(s, d), t.components(s, d), t.tags(s, d))


@query
def evidence_by_entity(s: SparkSession, d: str) -> DataFrame:
    def rec(df: DataFrame, entity: str, key: str) -> DataFrame:
        return df.select(F.lit(entity).alias("entity"), "tenant_id", "asset_id", F.col(key).alias("record_id"))

    records = (
        rec(t.work_orders(s, d), "workorder", "work_order_id")
        .unionByName(rec(t.maintenance(s, d), "maintenance", "maintenance_id"))
        .unionByName(rec(t.failure_events(s, d), "apm_failureevent", "failure_event_id"))
        .unionByName(rec(t.components(s, d), "component", "component_id"))
    )
    return ctx.evidence_by_entity(records)


@query
def triage_evidence(s: SparkSession, d: str) -> DataFrame:
    e = ev.evidence_json(evidence_rows(s, d))
    return e.select(
        "evidence_id", "evidence_version", "tenant_id", "anomaly_id", "asset_id", "component_id", "tag_id",
        "metric_name", "window_start", "window_end", "observed_value", "baseline_value", "expected_value",
        "quality_flags", "source_event_ids", "quality_event_ids",
        F.transform("sensor_window", lambda r: r["event_id"]).alias("sensor_events"),
        F.transform("runbook_refs", lambda r: F.concat(r["runbook_id"], F.lit("#"), r["section"])).alias("runbooks"),
        F.get_json_object("evidence_json", "$.window_start").alias("json_window_start"),
    )


@query
def evidence_assembled(s: SparkSession, d: str) -> DataFrame:
    """Evidence with the run-book of the asset type and one caveat event, from live context."""
    types = t.assets(s, d).select("tenant_id", "asset_id", "asset_type")
    c = latest_context(s, d).join(types, ["tenant_id", "asset_id"], "left")
    e = ev.triage_evidence(c, use_flags=False, asset_type="asset_type")
    return e.select(
        "evidence_id", "anomaly_id", "quality_event_ids", "quality_caveats",
        F.transform("runbook_refs", lambda r: F.concat(r["runbook_id"], F.lit("#"), r["section"])).alias("runbooks"),
    )


def shifted(df: DataFrame, column: str) -> DataFrame:
    """Order dates moved to the years of the events, so that some lie before and some after an anomaly."""
    return df.withColumn(column, F.col(column) + F.expr("INTERVAL 26 YEARS"))


def evidence_in_context(s: SparkSession, d: str) -> DataFrame:
    """Evidence with the newest work order and failure of the asset when the anomaly began, and the newest maintenance beside it."""
    orders = shifted(t.work_orders(s, d), "created_at").select("tenant_id", "asset_id", "work_order_id", "work_order_status", "created_at")
    # with the reason, maintenance reads the same columns of the line items as the failures, so both share one shuffle of them
    kept = shifted(t.maintenance(s, d), "performed_at").select(
        "tenant_id", "asset_id", "maintenance_id", "maintenance_type", "maintenance_reason", "performed_at"
    )
    failed = shifted(t.failure_events(s, d), "occurred_at").select(
        "tenant_id", "asset_id", F.col("failure_event_id").alias("failure_mode_id"), "event_status", "occurred_at"
    )
    a = ev.with_asset_history(t.anomalies(s, d), orders, kept, failed)
    r = t.readings(s, d)
    # of the health rows the context takes no count of missing heartbeats, for which all readings would be shuffled twice
    c = ctx.latest_context(a, r, late_rows(s, d), health.health_snapshot(r, r.filter(F.col("value").isNull())))
    return ev.triage_evidence(c, failure_mode="failure_mode", work_order="work_order", keep=("maintenance",))


@query
def evidence_context(s: SparkSession, d: str) -> DataFrame:
    e = ev.evidence_json(evidence_in_context(s, d))
    in_text = lambda path: F.get_json_object("evidence_json", path)
    return e.select(
        "anomaly_id",
        F.col("work_order_context.work_order_id").alias("work_order_id"),
        F.col("work_order_context.work_order_status").alias("work_order_status"),
        F.col("work_order_context.created_at").alias("work_order_at"),
        F.col("maintenance.maintenance_id").alias("maintenance_id"),
        F.col("failure_mode_context.failure_mode_id").alias("failure_mode_id"),
        F.col("failure_mode_context.occurred_at").alias("failed_at"),
        in_text("$.work_order_context.work_order_id").alias("json_work_order"),
        in_text("$.failure_mode_context.failure_mode_id").alias("json_failure_mode"),
    )


@query
def recommendations_in_context(s: SparkSession, d: str) -> DataFrame:
    r = recommend.recommendations(evidence_in_context(s, d), F.lit("2024-02-01T00:00:00Z"))
    return r.select("recommendation_id", "anomaly_id", "related_signals", "related_failure_modes", "confidence_label")


@query
def evidence_runbook(s: SparkSession, d: str) -> DataFrame:
    a = ctx.anomaly_context(t.anomalies(s, d), t.assets(s, d), t.components(s, d), t.tags(s, d))
    m = t.anomalies(s, d).select("anomaly_id", "metric_name")
    ref = ev.runbook_refs(F.col("asset_type"), F.col("metric_name"))[0]
    return a.join(m, "anomaly_id").select("anomaly_id", ref["runbook_id"].alias("runbook_id"), ref["section"].alias("section"))


@query
def evidence_caveats(s: SparkSession, d: str) -> DataFrame:
    no = F.col("event_no")
    flags = F.when(no % 9 == 0, t.strings("gap_detected", "flatline", "flatline")).otherwise(F.col("quality_flags"))
    caveats = ev.evidence_caveats(flags, no % 5 == 0)
    return t.readings(s, d).select("event_id", caveats.alias("caveats"))


@query
def recommendations(s: SparkSession, d: str) -> DataFrame:
    return recommendation_rows(s, d)


@query
def recommendation_store(s: SparkSession, d: str) -> DataFrame:
    stored = recommend.recommendation_rows(validate.validate_recommendations(referring_rows(s, d)))
    return stored.select(
        "recommendation_id", "anomaly_id", "findings", "possible_causes", "runbook_references", "quality_caveats",
        "status", "validation_status", "quarantine_reason",
    )


def responses(s: SparkSession, d: str) -> DataFrame:
    """Recorded model output: conversation texts as fenced JSON, bare JSON, JSON list or prose."""
    c = t.table(s, d, "conversations")
    body = F.to_json(F.struct(F.col("text").alias("summary")))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    content = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("  "), body, F.lit("\n")))
        .when(kind == 2, F.concat(F.lit("["), body, F.lit("]")))
        .otherwise(F.concat(F.lit("Answer: "), "text"))
    )
    return c.select("conv_id", "turn", "text", content.alias("content"))


@query
def response_parse(s: SparkSession, d: str) -> DataFrame:
    p = recommend.parse_responses(responses(s, d))
    text = F.when(F.col("parsed_status") == "parsed_json", F.get_json_object("cleaned", "$.summary"))
    return p.select("conv_id", "turn", "parsed_status", F.md5(text).alias("summary_md5"))


def recorded(s: SparkSession, d: str) -> DataFrame:
    """Recorded responses of some anomalies with their validation result."""
    no = number_of()
    a = t.anomalies(s, d).filter(no % 2 == 0)
    return a.select(
        "tenant_id",
        "anomaly_id",
        F.when(no % 6 == 0, F.lit("non_json")).otherwise(F.lit("parsed_json")).alias("parsed_status"),
        F.when(no % 10 == 0, F.lit("quarantined")).otherwise(F.lit("valid")).alias("validation_status"),
        F.when(no % 10 == 0, F.lit("evidence_free")).alias("validation_reason"),
        F.concat(F.lit("Model summary "), no.cast("string")).alias("summary"),
        F.lit("model-x").alias("model_name"),
        (no % 100 * 0.001).alias("token_cost"),
        (no % 1000).cast("int").alias("latency_ms"),
    )


@query
def recommendation_choose(s: SparkSession, d: str) -> DataFrame:
    chosen = recommend.choose_recommendation(recommendation_rows(s, d), recorded(s, d))
    return rounded(
        chosen.select("anomaly_id", "summary", "model_name", "token_cost", "latency_ms", "status", "chosen_status",
                      "chosen_reason"),
        "token_cost",
    )


@query
def invocation_audit(s: SparkSession, d: str) -> DataFrame:
    no = number_of()
    calls = evidence_rows(s, d).select(
        "tenant_id",
        F.lit("pending").alias("incident_id"),
        "anomaly_id",
        "evidence_id",
        F.lit("openai").alias("provider"),
        F.lit("model-x").alias("model_name"),
        F.concat(F.lit("raw "), no.cast("string")).alias("raw_response"),
        F.lit("parsed_json").alias("parsed_status"),
        F.lit("valid").alias("validation_status"),
        F.lit("").alias("quarantine_reason"),
        (no % 500).alias("prompt_tokens"),
        (no % 300).alias("completion_tokens"),
        F.lit(12).alias("latency_ms"),
        now().alias("created_at"),
    )
    return rounded(recommend.invocation_audit(calls), "token_cost", digits=9)


# --- incidents and alerts -----------------------------------------------------------------


@query
def incident_rows(s: SparkSession, d: str) -> DataFrame:
    return incidents.incidents(t.anomalies(s, d))


QUERIES["incidents"] = QUERIES.pop("incident_rows")


@query
def incidents_12h(s: SparkSession, d: str) -> DataFrame:
    return incidents.incidents(t.anomalies(s, d), "12 HOURS")


@query
def incident_members(s: SparkSession, d: str) -> DataFrame:
    return incidents.incident_members(t.anomalies(s, d), "12 HOURS")


@query
def incident_id_pages(s: SparkSession, d: str) -> DataFrame:
    return incidents.incident_id_pages(incidents.incident_members(t.anomalies(s, d), "12 HOURS"), 2)


def incident_view(s: SparkSession, d: str) -> DataFrame:
    return incidents.incident_context(incidents.incidents(t.anomalies(s, d), "12 HOURS"), referring_rows(s, d))


@query
def incident_context(s: SparkSession, d: str) -> DataFrame:
    return incident_view(s, d).select(
        "incident_id", "tenant_id", "primary_anomaly_id", "evidence_id", "recommendation_id", "summary"
    )


@query
def route_alerts(s: SparkSession, d: str) -> DataFrame:
    return incidents.route_alerts(incidents.incidents(t.anomalies(s, d)), now(), webhook_configured=True)


@query
def alert_text(s: SparkSession, d: str) -> DataFrame:
    return incidents.alert_text(incident_view(s, d)).select("incident_id", "alert_summary", "alert_color", "alert_text")


# --- inspection and reports ---------------------------------------------------------------


def landed(s: SparkSession, d: str) -> dict[str, tuple[DataFrame, str]]:
    return {
        "readings": (t.readings(s, d), "event_time"),
        "anomalies": (t.anomalies(s, d), "window_start"),
        "late": (late_rows(s, d), "event_time"),
        "health": (health_rows(s, d), "observed_at"),
        "diagnoses": (t.diagnoses(s, d), "created_at"),
        "work_orders": (t.work_orders(s, d), "created_at"),
        "maintenance": (t.maintenance(s, d), "performed_at"),
        "failure_events": (t.failure_events(s, d), "occurred_at"),
    }


@query
def row_counts(s: SparkSession, d: str) -> DataFrame:
    extra = {"assets": t.assets(s, d), "components": t.components(s, d), "tags": t.tags(s, d)}
    return reports.row_counts({n: df for n, (df, _) in landed(s, d).items()} | extra)


@query
def time_ranges(s: SparkSession, d: str) -> DataFrame:
    return reports.time_ranges(landed(s, d))


@query
def cdc_op_distribution(s: SparkSession, d: str) -> DataFrame:
    feed = dimensions.with_change_marks(t.assets_cdc(s, d))
    return reports.cdc_op_distribution({"assets": feed})


@query
def condition_distribution(s: SparkSession, d: str) -> DataFrame:
    return reports.condition_distribution(snapshot(s, d))


@query
def evidence_totals(s: SparkSession, d: str) -> DataFrame:
    return reports.evidence_totals(failure_mart(s, d))


@query
def ingest_profile(s: SparkSession, d: str) -> DataFrame:
    return reports.ingest_profile(t.readings(s, d))


@query
def recent_rows(s: SparkSession, d: str) -> DataFrame:
    r = reports.recent_rows(t.readings(s, d), "event_time", ["event_id"], 10)
    return r.select("tenant_id", "event_id", "tag_id", "metric_name", "event_time", "value", "unit")


@query
def top_failures(s: SparkSession, d: str) -> DataFrame:
    total = F.col("suspected_failure_count") + F.col("confirmed_failure_count")
    return reports.top_by(failure_mart(s, d), total, ["tenant_id", "asset_id", "component_id"], 10).select(
        "tenant_id", "asset_id", "component_id", "suspected_failure_count", "confirmed_failure_count",
        "open_workorder_count", "completed_workorder_count", "maintenance_count",
    )


@query
def triage_queue(s: SparkSession, d: str) -> DataFrame:
    q = reports.triage_queue(t.anomalies(s, d), 10)
    return q.select("tenant_id", "anomaly_id", "asset_id", "tag_id", "metric_name", "window_start", "severity")


@query
def replay_diff(s: SparkSession, d: str) -> DataFrame:
    a = t.anomalies(s, d).select("anomaly_id", "tenant_id", "tag_id", "severity", "window_start")
    changed = a.withColumn("severity", F.when(number_of() % 50 == 0, F.lit("info")).otherwise(F.col("severity")))
    return reports.replay_diff(a, changed)


@query
def report_anomaly_trend(s: SparkSession, d: str) -> DataFrame:
    return reports.anomaly_trend(detectors.detect_all(t.measured(s, d)))


@query
def report_late_rate(s: SparkSession, d: str) -> DataFrame:
    return rounded(reports.late_rate(t.readings(s, d), late_rows(s, d)), "late_rate")


@query
def report_quality_failures(s: SparkSession, d: str) -> DataFrame:
    return reports.quality_failures(all_quality_events(s, d))


@query
def report_asset_health(s: SparkSession, d: str) -> DataFrame:
    return reports.asset_health(t.anomalies(s, d))
