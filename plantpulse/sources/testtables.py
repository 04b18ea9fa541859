"""Sensor-shaped views over the synthetic test tables.

The driver's tables are star-schema-like, so the library's queries run on
deterministic views of them.  Every view reads the whole table, is built anew
for each query and stays lazy.
Entities line up at every scale factor: ``user_id div 5``, ``o_custkey div 50``,
``l_suppkey * 3 div 10`` and ``p_partkey div 5`` all number assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantpulse.operators.latest import latest_by_key
from plantpulse.operators.threshold import flag_breaches
from plantpulse.sources.dimensions import land_changes

METRICS = ("temperature", "vibration", "pressure", "flow_rate", "power_draw")
UNITS = ("celsius", "mm_s", "bar", "m3_h", "kw")
SOURCES = ("opc_ua", "scada", "historian", "bms")
ASSET_TYPES = ("pump", "boiler", "chiller", "conveyor")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], number: Column) -> Column:
    """``values[number mod len(values)]``"""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def tenant_of(asset_no: Column) -> Column:
    return pick(("tenant_a", "tenant_b", "tenant_c"), asset_no)


def named(prefix: str, number: Column | str) -> Column:
    return F.concat(F.lit(prefix), number.cast("string") if isinstance(number, Column) else F.col(number).cast("string"))


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with their series attributes; ``event_no`` is kept as a plain number."""
    e = table(spark, sf_dir, "events")
    asset_no = F.expr("user_id div 5")
    flags = (
        F.when(F.col("event_type") == "error", strings("threshold_spike"))
        .when(F.col("event_type") == "signup", strings("late_arrival"))
        .when(F.col("event_type") == "purchase", strings("degraded_signal", "threshold_breach"))
        .otherwise(strings())
    )
    return e.select(
        F.col("event_id").alias("event_no"),
        named("evt_", "event_id").alias("event_id"),
        tenant_of(asset_no).alias("tenant_id"),
        named("plant_", asset_no % 4).alias("plant_id"),
        named("asset_", asset_no).alias("asset_id"),
        named("Asset ", asset_no).alias("asset_name"),
        named("comp_", "user_id").alias("component_id"),
        named("tag_", "user_id").alias("tag_id"),
        named("sensor_", "user_id").alias("tag_name"),
        pick(METRICS, F.col("user_id")).alias("metric_name"),
        pick(UNITS, F.col("user_id")).alias("unit"),
        F.col("ts").alias("event_time"),
        (F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") % 20).cast("int"))).alias("ingest_time"),
        F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"),
        pick(SOURCES, F.col("user_id")).alias("source_system"),
        flags.alias("quality_flags"),
        F.col("event_type").alias("scenario"),
    )


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that carry a value (detectors and window statistics need one)."""
    return readings(spark, sf_dir).filter(F.col("value").isNotNull())


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve wire columns, with some required ones missing."""
    from plantpulse.functions.times import iso_z

    no = F.col("event_no")
    return readings(spark, sf_dir).select(
        "event_no",
        "event_id",
        F.when(no % 173 != 0, F.col("tenant_id")).alias("tenant_id"),
        F.when(no % 211 != 0, F.col("tag_id")).alias("tag_id"),
        "tag_name",
        iso_z("event_time").alias("event_time"),
        iso_z("ingest_time").alias("ingest_time"),
        "value",
        F.when(no % 131 != 0, F.col("unit")).alias("unit"),
        F.when(no % 151 != 0, F.col("source_system")).alias("source_system"),
        "quality_flags",
        F.lit("raw_sensor_event.v1").alias("schema_version"),
        F.lit("normal").alias("scenario"),
    )


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``offset, value`` log lines; contract breakages are chosen by the event number."""
    from plantpulse.functions.times import iso_z

    no = F.col("event_no")
    r = readings(spark, sf_dir)
    fields = [
        F.when(no % 73 == 0, F.lit("")).otherwise(F.col("event_id")).alias("event_id"),
        F.when(no % 43 == 0, F.lit("raw_sensor_event.v99")).otherwise(F.lit("raw_sensor_event.v1")).alias("schema_version"),
        F.when(no % 61 == 0, F.lit("Tenant-X")).otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.col("tag_id"),
        F.when(no % 79 != 0, F.col("tag_name")).alias("tag_name"),
        F.when(no % 67 == 0, F.lit("yesterday")).otherwise(iso_z("event_time")).alias("event_time"),
        iso_z("ingest_time").alias("ingest_time"),
        F.when(no % 47 != 0, F.col("value")).alias("value"),
        F.when(no % 41 == 0, F.lit("bananas")).otherwise(F.col("unit")).alias("unit"),
        F.col("source_system"),
        F.when(no % 71 == 0, strings("dup", "dup")).otherwise(F.col("quality_flags")).alias("quality_flags"),
        F.when(no % 59 == 0, F.lit(1)).alias("bogus"),
    ]
    text = F.to_json(F.struct(*fields))
    # a number written as text, then a line that is not JSON at all
    text = F.when(no % 47 == 0, F.concat(F.expr("left(_t, length(_t) - 1)"), F.lit(',"value":"12.5"}'))).otherwise(F.col("_t"))
    return (
        r.withColumn("_t", F.to_json(F.struct(*fields)))
        .withColumn("_t", text)
        .select(
            no.alias("offset"),
            F.when(no % 53 == 0, F.lit('{"event_id": "evt_')).otherwise(F.col("_t")).alias("value"),
        )
    )


def tags_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag mapping changes: two versions per tag, no mapping for every 29th tag."""
    users = table(spark, sf_dir, "events").select("user_id").distinct().filter(F.col("user_id") % 29 != 0)
    asset_no = F.expr("user_id div 5")
    metric = pick(METRICS, F.col("user_id"))
    unit = F.when(F.col("user_id") % 31 == 0, F.lit("rpm")).otherwise(pick(UNITS, F.col("user_id")))
    ver = F.col("version")
    return users.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        tenant_of(asset_no).alias("tenant_id"),
        named("map_", "user_id").alias("mapping_id"),
        named("asset_", asset_no).alias("asset_id"),
        named("comp_", "user_id").alias("component_id"),
        named("tag_", "user_id").alias("tag_id"),
        F.concat(named("sensor_", "user_id"), F.when(ver == 1, F.lit("_old")).otherwise(F.lit(""))).alias("tag_name"),
        pick(SOURCES, F.col("user_id")).alias("source_system"),
        F.concat(F.lit("mp_"), metric).alias("measurement_point"),
        metric.alias("metric_name"),
        F.when(F.col("user_id") % 7 != 0, unit).otherwise(F.lit("")).alias("display_unit"),
        unit.alias("unit"),
        unit.alias("expected_unit"),
        F.when(ver == 1, F.lit(60.0)).otherwise(F.lit(30.0)).alias("sampling_rate_seconds"),
        F.lit(5.0).alias("normal_range_min"),
        (F.lit(60.0) + F.col("user_id") % 40).alias("normal_range_max"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.when(ver == 1, F.lit("2023-01-01 00:00:00")).otherwise(F.lit("2023-06-01 00:00:00"))
        .cast("timestamp_ntz")
        .alias("updated_at"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_key(tags_feed(spark, sf_dir), ["tenant_id", "tag_id"], "updated_at")


def assets_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset changes as the change feed writes them: everything is text."""
    s = table(spark, sf_dir, "supplier").withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    no, ver = F.col("s_suppkey"), F.col("version")
    stamp = F.when(ver == 1, F.lit("2023-01-01T00:00:00Z")).otherwise(F.lit("2023-06-01T00:00:00Z"))
    return s.select(
        tenant_of(no).alias("tenant_id"),
        named("asset_", no).alias("asset_id"),
        F.concat(named("Asset ", no), F.when(ver == 2, F.lit(" rev2")).otherwise(F.lit(""))).alias("asset_name"),
        pick(ASSET_TYPES, F.col("s_nationkey")).alias("asset_type"),
        F.lit("rotating").alias("asset_class"),
        F.lit(None).cast("string").alias("parent_asset_id"),
        named("site_", F.col("s_nationkey")).alias("site_id"),
        named("area_", F.col("s_nationkey") % 3).alias("area_id"),
        named("line_", no % 7).alias("line_id"),
        named("FL-", no).alias("functional_location"),
        F.lit("high").alias("criticality"),
        F.lit("active").alias("lifecycle_state"),
        F.when(no % 5 != 0, F.lit("2022-01-01T00:00:00Z")).otherwise(F.lit("n/a")).alias("created_at"),
        stamp.alias("updated_at"),
        F.when((no % 17 == 0) & (ver == 2), F.lit("true")).when(no % 2 == 0, F.lit("false")).alias("__deleted"),
        F.when(ver == 1, F.lit("c")).otherwise(F.lit("u")).alias("__op"),
        (F.lit(1672531200000) + ver * 60000).alias("__ts_ms"),
    )


def assets_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return land_changes(assets_cdc(spark, sf_dir), "assets")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_key(assets_feed(spark, sf_dir), ["tenant_id", "asset_id"], "updated_at")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset_no = F.expr("p_partkey div 5")
    return table(spark, sf_dir, "part").select(
        tenant_of(asset_no).alias("tenant_id"),
        named("comp_", "p_partkey").alias("component_id"),
        named("asset_", asset_no).alias("asset_id"),
        F.col("p_name").alias("component_name"),
        F.lower("p_type").alias("component_type"),
        F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
    )


def taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Failure domains, classes and modes derived from part types and brands."""
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    type_no = F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")).cast("bigint")
    brand_no = F.substring("p_brand", 7, 5).cast("bigint")
    p = p.select(type_no.alias("type_no"), brand_no.alias("brand_no"), F.lower("p_type").alias("type_code"))
    p = p.withColumn("tenant_id", F.explode(strings("tenant_a", "tenant_b", "tenant_c")))
    domain_no = F.expr("(type_no - 1) % 2 + 1")
    domains = p.select(
        "tenant_id", domain_no.alias("id"), F.concat(F.lit("domain_"), domain_no.cast("string")).alias("code")
    ).distinct()
    classes = p.select(
        "tenant_id", F.col("type_no").alias("id"), domain_no.alias("domain_id"), F.col("type_code").alias("code")
    ).distinct()
    modes = p.select(
        "tenant_id",
        (F.col("type_no") * 100 + F.col("brand_no")).alias("id"),
        F.col("type_no").alias("failure_class_id"),
        F.concat(F.lit("fm_"), F.col("type_code"), F.lit("_"), F.col("brand_no").cast("string")).alias("code"),
        F.initcap(F.concat(F.col("type_code"), F.lit(" wear "), F.col("brand_no").cast("string"))).alias("label"),
    )
    return domains, classes, modes


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset_no = F.expr("o_custkey div 50")
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("completed"))
        .when(F.col("o_orderstatus") == "O", F.lit("open"))
        .otherwise(F.lit("in_progress"))
    )
    return table(spark, sf_dir, "orders").select(
        tenant_of(asset_no).alias("tenant_id"),
        named("wo_", "o_orderkey").alias("work_order_id"),
        named("asset_", asset_no).alias("asset_id"),
        named("comp_", asset_no * 5 + F.col("o_orderkey") % 5).alias("component_id"),
        status.alias("work_order_status"),
        F.col("o_orderpriority").alias("title"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("completed_at"),
        F.col("o_orderdate").alias("updated_at"),
    )


def _unless(no: Column, number: int, text: str, other: str = "") -> Column:
    """``text`` as part of a JSON line, ``other`` in every ``number``-th one."""
    return F.when(no % number == 0, F.lit(other)).otherwise(F.lit(text))


def dead_letter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``offset, value`` lines of dead-letter records, with breakages chosen by the order number."""
    no = F.col("o_orderkey")
    first = F.concat(
        F.lit('{"error_code":"invalid_type","field_path":"/value"'), _unless(no, 11, "", ',"hint":1'), F.lit(',"message":"no number"}')
    )
    second = F.concat(
        F.lit('{"error_code":"invalid_value","field_path":'), _unless(no, 13, '"/unit"', "5"), _unless(no, 7, ',"message":"no unit"'), F.lit("}")
    )
    found = F.concat(F.lit(',"all_errors":['), F.when(no % 19 == 0, F.lit('"boom"')).otherwise(first), F.lit(","), second, F.lit("]"))
    value = F.concat(
        F.lit('{"original_record":'), F.when(no % 17 == 0, F.lit('"text"')).when(no % 2 == 0, F.lit("null")).otherwise(F.lit('{"id":1}')),
        F.lit(',"error_code":"invalid_type","field_path":"/value"'), _unless(no, 23, ',"message":"no number"'),
        F.lit(',"schema_name":"raw_sensor_event","schema_version":"raw_sensor_event.v1","validation_time":"2024-01-01T00:00:00'),
        _unless(no, 29, 'Z"', '"'), F.when(no % 3 == 0, F.lit("")).otherwise(found), F.lit("}"),
    )
    return table(spark, sf_dir, "orders").select(no.alias("offset"), value.alias("value"))


def work_order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``offset, value`` lines of work orders, with breakages chosen by the order number."""
    no = F.col("o_orderkey")
    parts = F.concat(
        F.lit(',"parts_used":[{"part_number":"p1","quantity":'), _unless(no, 5, "2", '"two"'), F.lit('},{"part_number":'),
        _unless(no, 7, '"p2"', "7"), F.lit("}"), _unless(no, 23, "", ",3"), F.lit("]"),
    )
    measured = F.when(no % 29 == 0, F.lit("[]")).otherwise(F.concat(F.lit('{"a":1.5,"b":'), _unless(no, 13, "2", '"high"'), F.lit("}")))
    inspected = F.concat(F.lit(',"inspection_results":{"inspection_type":'), _unless(no, 11, '"visual"', '"smell"'), F.lit(',"measurements":'), measured, F.lit("}"))
    value = F.concat(
        F.lit('{"schema_version":"work_order.v1","work_order_id":"w","tenant_id":"t","asset_id":"a","work_type":"corrective","priority":'),
        _unless(no, 19, '"low"', '"urgent"'), F.lit(',"created_at":"2024-01-01T00:00:00Z","downtime_minutes":'), _unless(no, 17, "0", "-1"),
        F.when(no % 3 == 0, F.lit("")).otherwise(F.concat(parts, inspected)), _unless(no, 31, ',"status":"open"'), _unless(no, 37, "", ',"color":1'), F.lit("}"),
    )
    return table(spark, sf_dir, "orders").select(no.alias("offset"), value.alias("value"))


def current_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a change feed: the last shipped row per (order, line) is the current one."""
    return latest_by_key(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus",
            "l_shipdate",
        ),
        ["l_orderkey", "l_linenumber"],
        "l_shipdate",
        ["l_partkey", "l_suppkey", "l_extendedprice"],
    )


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset_no = F.expr("l_suppkey * 3 div 10")
    return current_lines(spark, sf_dir).select(
        tenant_of(asset_no).alias("tenant_id"),
        F.concat_ws("_", F.lit("mnt"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(
            "maintenance_id"
        ),
        named("asset_", asset_no).alias("asset_id"),
        named("comp_", asset_no * 5 + F.col("l_linenumber") % 5).alias("component_id"),
        F.when(F.col("l_returnflag") == "A", F.lit("sensor_calibration"))
        .when(F.col("l_returnflag") == "N", F.lit("inspection"))
        .otherwise(F.lit("repair"))
        .alias("maintenance_type"),
        F.when(F.col("l_linestatus") == "O", F.lit("sensor drift")).otherwise(F.lit("scheduled")).alias("maintenance_reason"),
        F.col("l_shipdate").alias("performed_at"),
    )


def failure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset_no = F.expr("l_suppkey * 3 div 10")
    return (
        current_lines(spark, sf_dir)
        .filter(F.col("l_returnflag") == "R")
        .select(
            tenant_of(asset_no).alias("tenant_id"),
            F.concat_ws("_", F.lit("fe"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias(
                "failure_event_id"
            ),
            named("asset_", asset_no).alias("asset_id"),
            named("comp_", asset_no * 5 + F.col("l_linenumber") % 5).alias("component_id"),
            F.when(F.col("l_linestatus") == "O", F.lit("suspected")).otherwise(F.lit("confirmed")).alias("event_status"),
            F.col("l_shipdate").alias("occurred_at"),
            (F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("detected_at"),
        )
    )


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold breaches with severities spread by event number, so ladders have every case."""
    flagged = flag_breaches(readings(spark, sf_dir))
    no = F.substring("anomaly_id", 10, 20).cast("bigint")
    severity = F.when(no % 7 == 0, F.lit("critical")).when(no % 11 == 0, F.lit("info")).otherwise(F.lit("warning"))
    return flagged.withColumn("severity", severity)


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.substring("anomaly_id", 10, 20).cast("bigint")
    return anomalies(spark, sf_dir).select(
        F.concat(F.lit("diag_"), no.cast("string")).alias("diagnosis_id"),
        "tenant_id",
        F.when(no % 9 != 0, F.col("anomaly_id")).alias("anomaly_id"),
        "asset_id",
        "component_id",
        pick(("low", "medium", "high", "critical"), no).alias("risk_level"),
        (no % 5 == 0).alias("escalation_required"),
        ((no % 100) / 100.0).alias("confidence"),
        F.array_join("quality_flags", "|").alias("quality_caveats"),
        (F.col("window_end") + F.expr("INTERVAL 2 MINUTES")).alias("created_at"),
    )


def max_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the newest event time, used as ``as_of``."""
    return table(spark, sf_dir, "events").agg(F.max("ts").alias("as_of"))


def max_order_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("as_of"))
