"""DuckDB twins of the registered queries: the same results from plain SQL over the same tables.

``VIEWS`` are common table expressions; :func:`sql` prepends those a statement mentions.
The twins are written from the definitions, not from the Spark plans: they use ordinary
window functions, joins and correlated conditions where the library aggregates in steps.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from plantpulse.sources import dimensions

VIEWS: dict[str, str] = {}
TWINS: dict[str, str] = {}


def view(name: str, text: str) -> None:
    VIEWS[name] = text.strip()


def sql(body: str) -> str:
    """``body`` with a WITH clause of every view it needs, in definition order."""
    needed: set[str] = set()

    def collect(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                collect(VIEWS[name])

    collect(body)
    if not needed:
        return body.strip()
    parts = ",\n".join(f"{n} AS (\n{VIEWS[n]}\n)" for n in VIEWS if n in needed)
    return f"WITH {parts}\n{body.strip()}"


def twin(name: str, body: str) -> None:
    TWINS[name] = sql(body)


def iso(c: str) -> str:
    return f"regexp_replace(strftime({c}, '%Y-%m-%dT%H:%M:%S.%fZ'), '\\.000000Z$', 'Z')"


def flags(c: str = "quality_flags") -> str:
    return f"array_to_string({c}, '|')"


def sha1_id(prefix: str, text: str, n: int = 16) -> str:
    return f"'{prefix}' || substr(sha1({text}), 1, {n})"


METRICS = "['temperature','vibration','pressure','flow_rate','power_draw']"
UNITS = "['celsius','mm_s','bar','m3_h','kw']"
SOURCES = "['opc_ua','scada','historian','bms']"
ASSET_TYPES = "['pump','boiler','chiller','conveyor']"
PART_TYPES = "['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD']"


def tenant(no: str) -> str:
    return f"['tenant_a','tenant_b','tenant_c'][({no}) % 3 + 1]"


# --- views ----------------------------------------------------------------------------------

view("v_readings", f"""
SELECT event_id AS event_no, 'evt_' || event_id AS event_id, {tenant('user_id // 5')} AS tenant_id,
  'plant_' || ((user_id // 5) % 4) AS plant_id, 'asset_' || (user_id // 5) AS asset_id,
  'Asset ' || (user_id // 5) AS asset_name, 'comp_' || user_id AS component_id, 'tag_' || user_id AS tag_id,
  'sensor_' || user_id AS tag_name, {METRICS}[user_id % 5 + 1] AS metric_name, {UNITS}[user_id % 5 + 1] AS unit,
  ts AS event_time, ts + to_minutes(CAST(event_id % 20 AS BIGINT)) AS ingest_time,
  CASE WHEN event_id % 97 <> 0 THEN value END AS value, {SOURCES}[user_id % 4 + 1] AS source_system,
  CASE event_type WHEN 'error' THEN ['threshold_spike'] WHEN 'signup' THEN ['late_arrival']
    WHEN 'purchase' THEN ['degraded_signal','threshold_breach'] ELSE CAST([] AS VARCHAR[]) END AS quality_flags,
  event_type AS scenario
FROM events""")

view("v_measured", "SELECT * FROM v_readings WHERE value IS NOT NULL")

view("v_raw", f"""
SELECT event_no, event_id, CASE WHEN event_no % 173 <> 0 THEN tenant_id END AS tenant_id,
  CASE WHEN event_no % 211 <> 0 THEN tag_id END AS tag_id, tag_name, {iso('event_time')} AS event_time,
  {iso('ingest_time')} AS ingest_time, value, CASE WHEN event_no % 131 <> 0 THEN unit END AS unit,
  CASE WHEN event_no % 151 <> 0 THEN source_system END AS source_system, quality_flags,
  event_time AS event_at
FROM v_readings""")

view("v_tags_feed", f"""
SELECT {tenant('user_id // 5')} AS tenant_id, 'map_' || user_id AS mapping_id, 'asset_' || (user_id // 5) AS asset_id,
  'comp_' || user_id AS component_id, 'tag_' || user_id AS tag_id,
  'sensor_' || user_id || CASE WHEN ver = 1 THEN '_old' ELSE '' END AS tag_name,
  {SOURCES}[user_id % 4 + 1] AS source_system, 'mp_' || {METRICS}[user_id % 5 + 1] AS measurement_point,
  {METRICS}[user_id % 5 + 1] AS metric_name,
  CASE WHEN user_id % 7 <> 0 THEN CASE WHEN user_id % 31 = 0 THEN 'rpm' ELSE {UNITS}[user_id % 5 + 1] END ELSE '' END
    AS display_unit,
  CASE WHEN user_id % 31 = 0 THEN 'rpm' ELSE {UNITS}[user_id % 5 + 1] END AS unit,
  CASE WHEN user_id % 31 = 0 THEN 'rpm' ELSE {UNITS}[user_id % 5 + 1] END AS expected_unit,
  CASE WHEN ver = 1 THEN 60.0::DOUBLE ELSE 30.0::DOUBLE END AS sampling_rate_seconds, 5.0::DOUBLE AS normal_range_min,
  (60.0 + user_id % 40)::DOUBLE AS normal_range_max,
  CASE WHEN ver = 1 THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2023-06-01' END AS updated_at, user_id, ver
FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 29 <> 0), (VALUES (1), (2)) v(ver)""")

view("v_tags", "SELECT * FROM v_tags_feed WHERE ver = 2")

view("v_assets_cdc", f"""
SELECT {tenant('s_suppkey')} AS tenant_id, 'asset_' || s_suppkey AS asset_id,
  'Asset ' || s_suppkey || CASE WHEN ver = 2 THEN ' rev2' ELSE '' END AS asset_name,
  {ASSET_TYPES}[s_nationkey % 4 + 1] AS asset_type, 'rotating' AS asset_class, CAST(NULL AS VARCHAR) AS parent_asset_id,
  'site_' || s_nationkey AS site_id, 'area_' || (s_nationkey % 3) AS area_id, 'line_' || (s_suppkey % 7) AS line_id,
  'FL-' || s_suppkey AS functional_location, 'high' AS criticality, 'active' AS lifecycle_state,
  CASE WHEN s_suppkey % 5 <> 0 THEN TIMESTAMP '2022-01-01' ELSE TIMESTAMP '1970-01-01' END AS created_at,
  CASE WHEN ver = 1 THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2023-06-01' END AS updated_at,
  (s_suppkey % 17 = 0 AND ver = 2) AS deleted, CASE WHEN ver = 1 THEN 'c' ELSE 'u' END AS cdc_op, ver
FROM supplier, (VALUES (1), (2)) v(ver)""")

view("v_assets_feed", "SELECT * FROM v_assets_cdc WHERE NOT deleted")

view("v_assets", """
SELECT * FROM v_assets_feed f
WHERE updated_at = (SELECT max(updated_at) FROM v_assets_feed g WHERE g.tenant_id = f.tenant_id AND g.asset_id = f.asset_id)""")

view("v_components", f"""
SELECT {tenant('p_partkey // 5')} AS tenant_id, 'comp_' || p_partkey AS component_id, 'asset_' || (p_partkey // 5) AS asset_id,
  p_name AS component_name, lower(p_type) AS component_type FROM part""")

view("v_work_orders", f"""
SELECT {tenant('o_custkey // 50')} AS tenant_id, 'wo_' || o_orderkey AS work_order_id, 'asset_' || (o_custkey // 50) AS asset_id,
  'comp_' || ((o_custkey // 50) * 5 + o_orderkey % 5) AS component_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS work_order_status,
  o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS completed_at
FROM orders""")

view("v_lines", """
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1""")

view("v_maintenance", f"""
SELECT {tenant('l_suppkey * 3 // 10')} AS tenant_id, 'mnt_' || l_orderkey || '_' || l_linenumber AS maintenance_id,
  'asset_' || (l_suppkey * 3 // 10) AS asset_id,
  'comp_' || ((l_suppkey * 3 // 10) * 5 + l_linenumber % 5) AS component_id,
  CASE l_returnflag WHEN 'A' THEN 'sensor_calibration' WHEN 'N' THEN 'inspection' ELSE 'repair' END AS maintenance_type,
  CASE l_linestatus WHEN 'O' THEN 'sensor drift' ELSE 'scheduled' END AS maintenance_reason, l_shipdate AS performed_at
FROM v_lines""")

view("v_failure_events", f"""
SELECT {tenant('l_suppkey * 3 // 10')} AS tenant_id, 'fe_' || l_orderkey || '_' || l_linenumber AS failure_event_id,
  'asset_' || (l_suppkey * 3 // 10) AS asset_id,
  'comp_' || ((l_suppkey * 3 // 10) * 5 + l_linenumber % 5) AS component_id,
  CASE l_linestatus WHEN 'O' THEN 'suspected' ELSE 'confirmed' END AS event_status, l_shipdate AS occurred_at,
  l_shipdate + INTERVAL 1 DAY AS detected_at
FROM v_lines WHERE l_returnflag = 'R'""")

view("v_flagged", """
SELECT * FROM v_readings WHERE (metric_name = 'temperature' AND value > 150) OR (metric_name = 'vibration' AND value > 10)
  OR (metric_name = 'pressure' AND value > 25) OR (metric_name = 'flow_rate' AND value > 300)
  OR (metric_name = 'power_draw' AND value > 600)""")

view("v_anomalies", """
SELECT *, 'anom_' || event_id AS anomaly_id, 'threshold_spike_e2e' AS rule_id, value AS observed_value,
  event_time AS window_start, event_time AS window_end,
  CASE WHEN event_no % 7 = 0 THEN 'critical' WHEN event_no % 11 = 0 THEN 'info' ELSE 'warning' END AS severity
FROM v_flagged""")

view("v_diagnoses", """
SELECT 'diag_' || event_no AS diagnosis_id, tenant_id, CASE WHEN event_no % 9 <> 0 THEN anomaly_id END AS anomaly_id,
  asset_id, component_id, ['low','medium','high','critical'][event_no % 4 + 1] AS risk_level,
  event_no % 5 = 0 AS escalation_required, (event_no % 100) / 100.0::DOUBLE AS confidence,
  array_to_string(quality_flags, '|') AS quality_caveats, window_end + INTERVAL 2 MINUTE AS created_at
FROM v_anomalies""")

view("v_late", """
SELECT event_id, event_no, tenant_id, plant_id, asset_id, component_id, tag_id, tag_name, metric_name, event_time, ingest_time,
  event_time - INTERVAL 5 MINUTE AS watermark_time,
  (event_no % 20) * 60 / 60.0::DOUBLE AS lateness_minutes, 'ingestion_lag_exceeded' AS reason, quality_flags
FROM v_readings WHERE (event_no % 20) * 60 > 600""")

view("v_gaps", """
SELECT * FROM (SELECT *, lag(event_time) OVER w AS prev_time, lag(event_id) OVER w AS prev_id, lag(value) OVER w AS prev_value,
    lag(quality_flags) OVER w AS prev_flags
  FROM v_measured WINDOW w AS (PARTITION BY tenant_id, asset_id, tag_id, metric_name ORDER BY event_time, event_id))
WHERE event_time - prev_time >= INTERVAL 10 MINUTE""")

view("v_health", """
SELECT r.tenant_id || '-stream_health' AS job_name, r.tenant_id, watermark_lag_seconds, late_event_count, dlq_count,
  CAST(coalesce(g.n, 0) AS BIGINT) AS missing_heartbeat_count, r.observed_at
FROM (SELECT tenant_id, time_bucket(INTERVAL 5 MINUTE, event_time) AS observed_at,
    max((event_no % 20) * 60.0::DOUBLE) AS watermark_lag_seconds,
    CAST(count(*) FILTER ((event_no % 20) * 60 > 600) AS BIGINT) AS late_event_count,
    CAST(count(*) FILTER (value IS NULL) AS BIGINT) AS dlq_count FROM v_readings GROUP BY ALL) r
LEFT JOIN (SELECT tenant_id, time_bucket(INTERVAL 5 MINUTE, event_time) AS observed_at, count(*) AS n FROM v_gaps GROUP BY ALL) g
  ON r.tenant_id = g.tenant_id AND r.observed_at = g.observed_at""")

view("v_as_of", "SELECT max(ts) AS as_of FROM events")
view("v_order_as_of", "SELECT max(o_orderdate) AS as_of FROM orders")

# --- sources, landing, dimensions -------------------------------------------------------------

twin("json_tolerant_scan", f"""
SELECT event_no AS "offset", CASE WHEN event_no % 73 = 0 THEN '' ELSE event_id END AS event_id,
  CASE WHEN event_no % 61 = 0 THEN 'Tenant-X' ELSE tenant_id END AS tenant_id, tag_id,
  CASE WHEN event_no % 67 = 0 THEN 'yesterday' ELSE {iso('event_time')} END AS event_time,
  CASE WHEN event_no % 47 = 0 THEN 12.5::DOUBLE ELSE value END AS value,
  CASE WHEN event_no % 41 = 0 THEN 'bananas' ELSE unit END AS unit,
  CASE WHEN event_no % 71 = 0 THEN 'dup|dup' ELSE {flags()} END AS quality_flags
FROM v_readings WHERE event_no % 53 <> 0""")

twin("upsert_latest", """
SELECT tenant_id, tag_id, tag_name, sampling_rate_seconds, updated_at FROM v_tags_feed
WHERE ver = CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END""")

twin("land_readings", """
SELECT event_id, '1.0' AS schema_version, tenant_id, plant_id, asset_id, asset_name, component_id, tag_id, tag_name,
  metric_name, CAST(NULL AS VARCHAR) AS threshold_profile_id, CASE WHEN event_no % 89 <> 0 THEN event_time END AS event_time,
  ingest_time, CASE WHEN event_no % 37 <> 0 THEN value END AS value, unit, source_system,
  CASE WHEN len(quality_flags) = 0 THEN '[]' ELSE '["' || array_to_string(quality_flags, '", "') || '"]' END AS quality_flags,
  scenario, tenant_id || '.staging_apm__sensor_readings.v1' AS source_topic
FROM v_readings""")

twin("land_anomalies", """
SELECT anomaly_id, 'anomaly_event.v1' AS schema_version, rule_id, tenant_id, plant_id, asset_id, asset_name, tag_id, tag_name,
  metric_name, observed_value, 0.0::DOUBLE AS baseline_value, 0.0::DOUBLE AS expected_value, 1 AS event_count,
  1 AS breach_count, window_start, window_end, severity,
  CASE WHEN len(quality_flags) = 0 THEN '[]' ELSE '["' || array_to_string(quality_flags, '", "') || '"]' END AS quality_flags,
  0.85::DOUBLE AS detection_confidence, '["' || event_id || '"]' AS source_event_ids,
  tenant_id || '.mart_apm__fct_anomaly_events.v1' AS source_topic
FROM v_anomalies""")

twin("land_late", """
SELECT event_id, 'late_event.v1' AS schema_version, tenant_id, plant_id, asset_id, tag_id, metric_name, event_time,
  ingest_time, watermark_time, lateness_minutes, reason,
  CASE WHEN len(quality_flags) = 0 THEN '[]' ELSE '["' || array_to_string(quality_flags, '", "') || '"]' END AS quality_flags,
  tenant_id || '.mart_apm__fct_late_sensor_readings.v1' AS source_topic
FROM v_late""")

twin("land_health", """
SELECT 'stream_health.v1' AS schema_version, job_name, tenant_id, watermark_lag_seconds, late_event_count,
  'streaming_active' AS checkpoint_status, observed_at,
  tenant_id || '.mart_apm__fct_stream_health_snapshots.v1' AS source_topic
FROM v_health""")

twin("land_diagnosis", """
SELECT diagnosis_id, tenant_id, anomaly_id, asset_id, component_id, risk_level, escalation_required, confidence,
  quality_caveats, created_at, tenant_id || '.mart_apm__fct_realtime_diagnosis_events.v1' AS source_topic
FROM v_diagnoses""")

view("v_missing", """
SELECT *, CASE WHEN tenant_id IS NULL THEN '$.tenant_id' WHEN tag_id IS NULL THEN '$.tag_id'
  WHEN value IS NULL THEN '$.value' WHEN unit IS NULL THEN '$.unit' WHEN source_system IS NULL THEN '$.source_system' END
  AS field_path FROM v_raw""")

twin("land_dlq", """
SELECT 'dlq_' || event_no AS dlq_event_id, tenant_id, event_at AS event_time, event_id AS raw_payload,
  tenant_id || '.raw_apm__sensor_readings.v1' AS original_topic, 'MISSING_REQUIRED_FIELD' AS error_type,
  field_path AS error_message, tenant_id || '.raw_apm__dlq_events.v1' AS source_topic
FROM v_missing WHERE field_path IS NOT NULL""")

twin("cdc_land", "SELECT * EXCLUDE (deleted, cdc_op, ver) FROM v_assets_feed")


def landed(table: str, key: str, day: str, money: str, columns: str) -> str:
    return f"""
SELECT ['tenant_a', 'tenant_b', 'tenant_c'][{key} % 3 + 1] AS tenant_id, {columns},
  CASE WHEN {key} % 19 <> 0 THEN CAST(trunc({money}) AS DOUBLE) END AS downtime_minutes,
  CASE WHEN {key} % 5 <> 0 THEN CAST({key} AS BIGINT) END AS failure_mode_id,
  CASE WHEN {key} % 7 <> 0 THEN CAST(CAST({day} AS DATE) AS TIMESTAMP) ELSE TIMESTAMP '1970-01-01' END AS created_at
FROM {table} WHERE {key} % 17 <> 0"""


twin("cdc_land_workorder", landed(
    "orders", "o_orderkey", "o_orderdate", "o_totalprice",
    "'wo_' || o_orderkey AS work_order_id, o_orderstatus AS work_order_status, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS requested_at",
))
twin("cdc_land_maintenance", landed(
    "lineitem", "l_orderkey", "l_shipdate", "l_quantity",
    "'mnt_' || l_orderkey || '_' || l_linenumber AS maintenance_id, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS performed_at, "
    "[true, false, true, false, NULL][l_linenumber % 5 + 1] AS sensor_anomaly_related",
))



def current_sql(name: str, table: str, key: str) -> str:
    """Newest version per key of a feed of two versions of some keys, a deleted second one left out."""
    own, version = dimensions.dimension_key(name)[-1], dimensions.dimension_version(name)

    def value(field: str, kind: str) -> str:
        if field == own:
            return "CAST(k AS BIGINT)" if kind == "l" else f"'{field}_' || k"
        if field == "tenant_id":
            return "['tenant_a', 'tenant_b', 'tenant_c'][k % 3 + 1]"
        if field == version:
            return "CASE WHEN v = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-06-01' END"
        day = "TIMESTAMP '2024-02-01 06:00:00' + to_days(CAST(k % 28 AS INTEGER))"
        return {
            "s": f"'{field}_' || k || '_' || v",
            "d": "CASE WHEN k % 19 <> 0 THEN k % 100 + CAST(0.5 AS DOUBLE) END",
            "l": "CASE WHEN k % 5 <> 0 THEN CAST(k AS BIGINT) END",
            "b": "[true, false, true, false, NULL][k % 5 + 1]",
            "t": f"CASE WHEN k % 7 <> 0 THEN {day} END",
            "T": f"CASE WHEN k % 7 <> 0 THEN {day} ELSE TIMESTAMP '1970-01-01' END",
        }[kind]

    columns = ", ".join(f"{value(f, kind)} AS {f}" for f, kind in dimensions.feed_kinds(name).items())
    return f"SELECT {columns} FROM (SELECT {key} AS k, CASE WHEN {key} % 3 = 0 AND {key} % 17 <> 0 THEN 1 ELSE 0 END AS v FROM {table})"


for _name, _table, _key in (
    ("tenants", "customer", "c_custkey"),
    ("asset_components", "part", "p_partkey"),
    ("asset_signal_tags_mapping", "part", "p_partkey"),
    ("failuredomain", "supplier", "s_suppkey"),
    ("failureclass", "supplier", "s_suppkey"),
    ("failuremode", "part", "p_partkey"),
    ("failureevent", "orders", "o_orderkey"),
    ("anomaly_rule", "supplier", "s_suppkey"),
    ("threshold_profiles", "customer", "c_custkey"),
):
    twin(f"cdc_current_{_name}", current_sql(_name, _table, _key))

twin("cdc_op_ts", """
SELECT tenant_id, asset_id, asset_name, cdc_op, TIMESTAMP '2023-01-01' + to_minutes(ver::BIGINT) AS cdc_updated_at
FROM v_assets_cdc""")

twin("latest_by_key", "SELECT * EXCLUDE (user_id, ver) FROM v_tags")

twin("insert_new_only", """
SELECT anomaly_id, tenant_id, severity, window_start FROM v_anomalies
WHERE anomaly_id NOT IN (SELECT anomaly_id FROM v_anomalies WHERE severity = 'warning')""")

twin("dedup_events", "SELECT event_id, tenant_id, tag_id, event_time, value FROM v_readings")

view("v_contract", """
SELECT event_no AS off, *, CASE WHEN event_no % 53 = 0 THEN [{'p': '/', 'c': 'invalid_json'}] ELSE
  list_sort(list_filter([
    CASE WHEN event_no % 73 = 0 THEN {'p': '/event_id', 'c': 'schema_validation_error'} END,
    CASE WHEN event_no % 43 = 0 THEN {'p': '/schema_version', 'c': 'invalid_value'} END,
    CASE WHEN event_no % 61 = 0 THEN {'p': '/tenant_id', 'c': 'invalid_format'} END,
    CASE WHEN event_no % 67 = 0 THEN {'p': '/event_time', 'c': 'invalid_format'} END,
    CASE WHEN event_no % 41 = 0 THEN {'p': '/unit', 'c': 'invalid_value'} END,
    CASE WHEN event_no % 71 = 0 THEN {'p': '/quality_flags', 'c': 'schema_validation_error'} END,
    CASE WHEN event_no % 59 = 0 THEN {'p': '/', 'c': 'unexpected_field'} END,
    CASE WHEN event_no % 47 = 0 THEN {'p': '/value', 'c': 'invalid_type'} END,
    CASE WHEN event_no % 79 = 0 THEN {'p': '/tag_name', 'c': 'missing_required_field'} END,
    CASE WHEN value IS NULL AND event_no % 47 <> 0 THEN
      {'p': CASE WHEN event_no % 79 = 0 THEN '/tag_name' ELSE '/value' END, 'c': 'missing_required_field'} END
  ], lambda e: e IS NOT NULL)) END AS errors
FROM v_readings""")

twin("route_records", """
SELECT off AS "offset", len(errors) = 0 AS valid,
  CASE WHEN len(errors) = 0 THEN tenant_id || '.raw_apm__sensor_readings.v1'
    WHEN event_no % 53 <> 0 AND event_no % 61 <> 0 AND tenant_id <> 'tenant_c' THEN tenant_id || '.raw_apm__dlq_events.v1'
    END AS topic,
  CASE WHEN len(errors) = 0 THEN tenant_id || '|' || tag_id
    WHEN event_no % 53 <> 0 AND event_no % 61 <> 0 AND tenant_id <> 'tenant_c' THEN tenant_id || '|dlq' END AS key,
  CASE WHEN len(errors) > 0 THEN errors[1].p END AS dead_path,
  CASE WHEN len(errors) > 0 THEN '2024-02-01T00:00:00Z' END AS dead_time,
  CASE WHEN event_no % 53 <> 0 THEN CASE WHEN event_no % 73 = 0 THEN '' ELSE event_id END END AS sent_event
FROM v_contract""")

twin("restamp_times", """
SELECT event_id, event_time, '2024-02-01T00:00:00Z' AS ingest_time, 'backfill_replay' AS producer_mode FROM v_raw
UNION ALL
SELECT event_id, '2024-02-01T00:00:00Z', '2024-02-01T00:00:00Z', 'realtime_live' FROM v_raw""")

view("v_points", f"""
SELECT DISTINCT {ASSET_TYPES}[p_size % 4 + 1] AS asset_type, lower(p_type) AS component_type,
  lower(replace(p_brand, '#', '_')) AS measurement_point,
  {METRICS}[(list_position({PART_TYPES}, p_type) - 1) % 5 + 1] AS metric_name,
  {METRICS}[(list_position({PART_TYPES}, p_type) - 1) % 5 + 1] || '_' ||
    {UNITS}[(list_position({PART_TYPES}, p_type) - 1) % 5 + 1] AS tag_suffix,
  {UNITS}[(list_position({PART_TYPES}, p_type) - 1) % 5 + 1] AS unit
FROM part""")

view("v_points_id", """
SELECT *, 'mp_' || asset_type || '_' || substr(sha1(asset_type || '|' || component_type || '|' || measurement_point), 1, 10)
  AS measurement_point_id FROM v_points""")

twin("measurement_point_ids", "SELECT * FROM v_points_id")

view("v_plant_assets", f"""
SELECT {tenant('s_suppkey')} AS tenant_id, 'plant_p' || s_suppkey AS plant_id, 'p' || s_suppkey AS slug, s_suppkey,
  lpad(CAST(i AS VARCHAR), 4, '0') AS num,
  CASE WHEN s_suppkey % 2 = 0 THEN ['pump','boiler'][(i - 1) % 2 + 1] ELSE ['chiller','pump','conveyor'][(i - 1) % 3 + 1] END
    AS asset_type,
  CASE WHEN s_suppkey % 2 = 0 THEN ['temperature','vibration','pressure'] ELSE ['pressure','flow_rate'] END AS metrics
FROM supplier, generate_series(1, 4) g(i) WHERE i <= s_nationkey % 4 + 1""")

view("v_catalog", """
SELECT tenant_id, plant_id, 'asset_' || slug || '_' || num AS asset_id,
  upper(substr(a.asset_type, 1, 1)) || substr(a.asset_type, 2) || ' ' || num AS asset_name, a.asset_type,
  'comp_' || substr(sha1(tenant_id || '|asset_' || slug || '_' || num || '|' || component_type || '|1'), 1, 16) AS component_id,
  component_type, measurement_point_id, measurement_point,
  'tag_' || slug || '_' || num || '_' || measurement_point_id || '_' || tag_suffix AS tag_id,
  a.asset_type || '_' || measurement_point || '_' || tag_suffix || '_' || num AS tag_name, metric_name, unit,
  'thr_generic' AS threshold_profile_id
FROM v_plant_assets a JOIN v_points_id p ON a.asset_type = p.asset_type AND list_contains(a.metrics, p.metric_name)""")

twin("tag_catalog", "SELECT * FROM v_catalog")

twin("dims_from_tags", """
SELECT DISTINCT 'asset' AS kind, asset_id AS id, asset_name AS label, 'high' AS criticality FROM v_catalog
UNION ALL SELECT DISTINCT 'component', component_id, component_type, 'high' FROM v_catalog
UNION ALL SELECT DISTINCT 'point', measurement_point_id, measurement_point, CAST(NULL AS VARCHAR) FROM v_catalog""")


def _rule_values() -> str:
    from plantpulse.operators.rules import RULES

    def row(r: tuple) -> str:
        pid, asset, comp, metric, unit, _rule, name, method, sev, params, owner = r
        return "(" + ", ".join(f"'{v}'" for v in (pid, name, method, asset, comp, metric, unit, sev, params, owner)) + ")"

    return ", ".join(row(r) for r in RULES)


view("v_rules", f"""
SELECT * FROM (VALUES {_rule_values()})
  r(rule_id, rule_name, method, asset_type, component_type, metric_name, unit, severity, parameters, owner)""")

twin("rules_per_tenant", """
SELECT t.tenant_id, r.*, 'approved' AS approval_status, 'active' AS status, '1.0.0' AS version
FROM (SELECT DISTINCT tenant_id FROM v_readings) t, v_rules r""")

view("v_modes", f"""
SELECT DISTINCT t.tenant_id, list_position({PART_TYPES}, p_type)::BIGINT AS type_no,
  CAST(substr(p_brand, 7) AS BIGINT) AS brand_no, lower(p_type) AS type_code
FROM part, (VALUES ('tenant_a'), ('tenant_b'), ('tenant_c')) t(tenant_id)""")

twin("failure_taxonomy", """
SELECT tenant_id, type_no AS failure_class_id, type_no * 100 + brand_no AS failure_mode_id,
  'fm_' || type_code || '_' || brand_no AS mode_code,
  upper(substr(type_code, 1, 1)) || substr(type_code, 2) || ' Wear ' || brand_no AS label,
  (type_no - 1) % 2 + 1 AS domain_id, type_code AS class_code, 'domain_' || ((type_no - 1) % 2 + 1) AS domain_code
FROM v_modes""")

# --- filters, predicates, validation -----------------------------------------------------------

twin("tenant_slice", "SELECT event_id, tenant_id, tag_id, event_time, value FROM v_readings WHERE tenant_id = 'tenant_a'")

twin("threshold_flag", f"""
SELECT 'anom_' || event_id AS anomaly_id, 'anomaly_event.v1' AS schema_version, 'threshold_spike_e2e' AS rule_id, tenant_id,
  plant_id, asset_id, asset_name, component_id, tag_id, tag_name, metric_name, value AS observed_value,
  0.0::DOUBLE AS baseline_value, 0.0::DOUBLE AS expected_value, 1 AS event_count, 1 AS breach_count,
  event_time AS window_start, event_time AS window_end, 'warning' AS severity, {flags()} AS quality_flags,
  CAST(NULL AS VARCHAR) AS quality_event_ids, 'sensor_fault' AS fault_type, CAST(NULL AS VARCHAR) AS failure_mode_id,
  0.85::DOUBLE AS detection_confidence, event_id AS source_event_ids
FROM v_flagged""")

twin("dead_letter_missing", """
SELECT event_id, 'MISSING_REQUIRED_FIELD' AS error_code, field_path,
  'Required raw sensor event field is missing or null' AS message, 'raw_sensor_event.v1' AS schema_name,
  'raw_sensor_event.v1' AS schema_version
FROM v_missing WHERE field_path IS NOT NULL""")

twin("contract_errors", """
SELECT off AS "offset", errors[1].c AS error_code, errors[1].p AS field_path, CAST(len(errors) AS INTEGER) AS error_count,
  array_to_string(list_transform(errors, lambda e: e.p || ':' || e.c), ',') AS all_errors
FROM v_contract""")

def error_list(found: str) -> str:
    """The columns of a contract query over orders, from a list of the errors each order number gives."""
    return f"""
SELECT o_orderkey AS "offset", errors[1].c AS error_code, errors[1].p AS field_path, CAST(len(errors) AS INTEGER) AS error_count,
  array_to_string(list_transform(errors, lambda e: e.p || ':' || e.c), ',') AS all_errors
FROM (SELECT o_orderkey, list_sort(list_filter([{found}], lambda e: e IS NOT NULL)) AS errors
      FROM (SELECT o_orderkey, o_orderkey AS n, o_orderkey % 3 <> 0 AS long FROM orders))"""


twin("contract_errors_dlq", error_list("""
  CASE WHEN long AND n % 19 = 0 THEN {'p': '/all_errors/0', 'c': 'invalid_type'} END,
  CASE WHEN long AND n % 19 <> 0 AND n % 11 = 0 THEN {'p': '/all_errors/0', 'c': 'unexpected_field'} END,
  CASE WHEN long AND n % 13 = 0 THEN {'p': '/all_errors/1/field_path', 'c': 'invalid_type'} END,
  CASE WHEN long AND n % 7 = 0 THEN {'p': '/message', 'c': 'missing_required_field'} END,
  CASE WHEN n % 17 = 0 THEN {'p': '/original_record', 'c': 'invalid_type'} END,
  CASE WHEN n % 23 = 0 THEN {'p': '/message', 'c': 'missing_required_field'} END,
  CASE WHEN n % 29 = 0 THEN {'p': '/validation_time', 'c': 'invalid_format'} END"""))

twin("contract_errors_work_order", error_list("""
  CASE WHEN long AND n % 5 = 0 THEN {'p': '/parts_used/0/quantity', 'c': 'invalid_type'} END,
  CASE WHEN long AND n % 7 = 0 THEN {'p': '/parts_used/1/part_number', 'c': 'invalid_type'} END,
  CASE WHEN long AND n % 23 = 0 THEN {'p': '/parts_used/2', 'c': 'invalid_type'} END,
  CASE WHEN long AND n % 11 = 0 THEN {'p': '/inspection_results/inspection_type', 'c': 'invalid_value'} END,
  CASE WHEN long AND n % 29 = 0 THEN {'p': '/inspection_results/measurements', 'c': 'invalid_type'} END,
  CASE WHEN long AND n % 29 <> 0 AND n % 13 = 0 THEN {'p': '/inspection_results/measurements/b', 'c': 'invalid_type'} END,
  CASE WHEN n % 19 = 0 THEN {'p': '/priority', 'c': 'invalid_value'} END,
  CASE WHEN n % 17 = 0 THEN {'p': '/downtime_minutes', 'c': 'invalid_value'} END,
  CASE WHEN n % 31 = 0 THEN {'p': '/status', 'c': 'missing_required_field'} END,
  CASE WHEN n % 37 = 0 THEN {'p': '/', 'c': 'unexpected_field'} END"""))

twin("contract_split", """
SELECT off AS "offset", len(errors) = 0 AS accepted, errors[1].c AS error_code FROM v_contract""")

twin("contract_summary", """
SELECT measure, count(*) AS n, 'raw_sensor_event.schema.json' AS schema_checked FROM (
  SELECT 'total_records' AS measure FROM v_contract
  UNION ALL SELECT CASE WHEN len(errors) = 0 THEN 'accepted_records' ELSE 'rejected_records' END FROM v_contract
  UNION ALL SELECT 'errors:' || e.c FROM (SELECT unnest(errors) AS e FROM v_contract)) GROUP BY measure""")

twin("enrich_rejects", """
SELECT event_id, tenant_id, error_code,
  CASE error_code WHEN 'missing_tag_metadata' THEN '/tag_id' WHEN 'invalid_asset_tag_mapping' THEN '/tenant_id'
    ELSE '/unit' END AS field_path,
  CASE error_code WHEN 'missing_tag_metadata' THEN 'No valid tag metadata mapping'
    WHEN 'invalid_asset_tag_mapping' THEN 'Tag metadata tenant mismatch' ELSE 'Tag metadata unit mismatch' END AS message,
  'enriched_telemetry' AS schema_name, 'enriched_telemetry.v1' AS schema_version
FROM (SELECT r.event_id, CASE WHEN r.event_no % 83 = 0 THEN 'tenant_x' ELSE r.tenant_id END AS tenant_id,
    CASE WHEN g.tag_id IS NULL THEN 'missing_tag_metadata' WHEN r.event_no % 83 = 0 THEN 'invalid_asset_tag_mapping'
      WHEN g.unit <> r.unit THEN 'invalid_tag_mapping' END AS error_code
  FROM v_readings r LEFT JOIN v_tags g ON r.tag_id = g.tag_id) WHERE error_code IS NOT NULL""")

twin("anomaly_quarantine", """
SELECT anomaly_id, tenant_id,
  array_to_string(list_filter([CASE WHEN event_no % 13 = 0 THEN 'component_id' END,
    CASE WHEN event_no % 17 = 0 THEN 'severity' END], lambda x: x IS NOT NULL), '|') AS missing_fields,
  CASE WHEN event_no % 13 = 0 OR event_no % 17 = 0 THEN 'missing_required_fields'
    WHEN tenant_id <> 'tenant_a' THEN 'tenant_mismatch' END AS quarantine_reason
FROM v_anomalies""")


def quality_id(check: str, start: str, end: str, evidence: str, asset: str = "asset_id", tag: str = "tag_id") -> str:
    text = f"tenant_id || '|' || {check} || '|' || {asset} || '|' || {tag} || '|' || {iso(start)} || '|' || {iso(end)} || '|' || {evidence}"
    return sha1_id("qevt_", text)


view("v_leak", """
SELECT *, CASE WHEN event_no % 19 = 0 THEN 'tenant_x' ELSE tenant_id END AS seen FROM v_anomalies""")
_LEAK = "'{\"expected_tenant_id\": \"' || tenant_id || '\", \"tenant_id\": \"' || seen || '\"}'"

twin("tenant_leak_check", f"""
SELECT {quality_id("'tenant_leakage'", 'window_start', 'window_end', _LEAK)} AS quality_event_id, tenant_id,
  'tenant_leakage' AS check_name, CASE WHEN seen = tenant_id THEN 'pass' ELSE 'fail' END AS check_status,
  CASE WHEN seen = tenant_id THEN 'info' ELSE 'critical' END AS severity, {_LEAK} AS evidence_json
FROM v_leak""")

twin("resolve_severity", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'critical' WHEN p_partkey % 3 = 0 THEN 'info'
  WHEN p_partkey % 5 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM part""")

twin("resolve_fault_type", """
SELECT event_id, CASE WHEN event_no % 6 = 0 THEN 'sensor_fault' WHEN event_no % 4 = 1 THEN 'sensor_fault'
  WHEN event_no % 4 = 2 THEN 'operating_context_change' ELSE 'asset_fault' END AS fault_type FROM v_readings""")

twin("feedback_validate", """
SELECT 'fb_' || o_orderkey AS feedback_id, ['none','info','warning','critical','fatal'][o_orderkey % 5 + 1] AS severity_correction,
  CASE WHEN o_orderkey % 23 = 0 THEN 'missing required feedback key: incident_id'
    WHEN o_orderkey % 29 = 0 THEN 'missing required feedback key: operator_id'
    WHEN o_orderkey % 5 = 4 THEN 'invalid severity_correction'
    WHEN o_orderkey % 7 NOT BETWEEN 1 AND 5 THEN 'explanation_usefulness out of range' END AS reject_reason
FROM orders""")

# --- enrichment, late, health -------------------------------------------------------------------

view("v_enriched", """
SELECT r.event_id, r.event_no, r.tenant_id, r.tag_id, r.tag_name, m.asset_id, a.asset_name, m.component_id, c.component_type,
  m.metric_name, m.measurement_point, m.expected_unit, r.value, r.unit, r.event_time, r.ingest_time, r.quality_flags,
  a.asset_type, a.site_id
FROM v_readings r JOIN v_tags m ON r.tenant_id = m.tenant_id AND r.tag_id = m.tag_id
LEFT JOIN v_assets a ON m.tenant_id = a.tenant_id AND m.asset_id = a.asset_id
LEFT JOIN v_components c ON m.tenant_id = c.tenant_id AND m.asset_id = c.asset_id AND m.component_id = c.component_id""")

twin("enrich_readings", f"SELECT * EXCLUDE (event_no) REPLACE ({flags()} AS quality_flags) FROM v_enriched")

twin("late_by_ingest_lag", f"""
SELECT event_id, 'late_event.v1' AS schema_version, tenant_id, site_id AS plant_id, asset_id, component_id, tag_id, tag_name,
  metric_name, event_time, ingest_time, event_time - INTERVAL 5 MINUTE AS watermark_time,
  date_diff('second', event_time, ingest_time) / 60.0::DOUBLE AS lateness_minutes, 'ingestion_lag_exceeded' AS reason,
  {flags()} AS quality_flags
FROM v_enriched WHERE ingest_time > event_time + INTERVAL 600 SECOND""")

twin("late_by_watermark", """
SELECT event_id, 'late_event.v1' AS schema_version, tenant_id, tag_id, event_time, ingest_time, watermark_time,
  round(greatest(0.0, date_diff('microsecond', event_time, watermark_time) / 60000000.0::DOUBLE), 3) AS lateness_minutes,
  'beyond_allowed_lateness' AS reason
FROM (SELECT *, max(event_time) OVER (PARTITION BY tenant_id ORDER BY ingest_time, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 5 MINUTE AS watermark_time FROM v_readings)
WHERE event_time < watermark_time - INTERVAL 10 MINUTE""")

twin("health_snapshot", """
SELECT 'stream_health.v1' AS schema_version, job_name, tenant_id, watermark_lag_seconds, late_event_count, dlq_count,
  missing_heartbeat_count, 0.0::DOUBLE AS processing_time_ms, 'streaming_active' AS checkpoint_status, observed_at
FROM v_health""")

# --- detectors ----------------------------------------------------------------------------------

SERIES = "tenant_id, asset_id, tag_id, metric_name"


def anomaly_hash(rule: str, start: str, end: str) -> str:
    text = (
        f"{rule} || '|' || tenant_id || '|' || asset_id || '|' || tag_id || '|' || metric_name || '|' || {iso(start)}"
        f" || '|' || {iso(end)}"
    )
    return f"'anom_' || substr(sha256({text}), 1, 16)"


twin("anomaly_ids", f"""
SELECT event_id, {anomaly_hash("'threshold_spike'", 'event_time', 'event_time')} AS anomaly_id FROM v_readings""")

# group verdicts: everything about a series except its last reading is the baseline
view("v_numbered", f"""
SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY event_time, event_id) AS rn,
  row_number() OVER (PARTITION BY {SERIES} ORDER BY event_time DESC, event_id DESC) AS back FROM v_measured""")

view("v_group", f"""
SELECT {SERIES}, count(*) AS n, min(event_time) AS window_start, max(event_time) AS window_end,
  max(value) FILTER (back = 1) AS last_value, max(value) FILTER (rn = 1) AS first_value,
  avg(value) FILTER (back > 1) AS base_mean,
  CASE WHEN min(value) FILTER (back > 1) = max(value) FILTER (back > 1) THEN 0.0
    ELSE stddev_pop(value) FILTER (back > 1) END AS base_sd,
  min(plant_id) AS plant_id, min(asset_name) AS asset_name, min(component_id) AS component_id, min(tag_name) AS tag_name,
  list_sort(list_distinct(flatten(list(quality_flags)))) AS quality_flags,
  list(event_id ORDER BY event_time, event_id) FILTER (rn <= 10) AS ids
FROM v_numbered GROUP BY {SERIES}""")


def scaled(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


def half_up(x: str, digits: int = 6) -> str:
    """Rounded half up on the decimal text of the double, as the queries round; numbers too long for it are whole."""
    text = f"TRY_CAST((({x})::DOUBLE)::VARCHAR AS DECIMAL(38, 22))"
    return f"coalesce(round({text}, {digits})::VARCHAR::DOUBLE, ({x})::DOUBLE)"


def anomaly_select(
    source: str, rule: str, where: str, *, severity: str, observed: str, baseline: str, expected: str, count: str,
    breaches: str, confidence: str = "0.9::DOUBLE", fault: str = "'asset_fault'", ids: str = "ids",
    start: str = "window_start", end: str = "window_end", cut: Callable[..., str] = scaled,
) -> str:
    return f"""
SELECT {anomaly_hash(f"'{rule}'", start, end)} AS anomaly_id, 'anomaly_event.v1' AS schema_version, '{rule}' AS rule_id,
  tenant_id, plant_id, asset_id, asset_name, component_id, tag_id, tag_name, metric_name,
  {cut(f"({observed})::DOUBLE")} AS observed_value, {cut(f"({baseline})::DOUBLE")} AS baseline_value,
  {cut(f"({expected})::DOUBLE")} AS expected_value, CAST({count} AS BIGINT) AS event_count,
  CAST({breaches} AS BIGINT) AS breach_count, {start} AS window_start, {end} AS window_end, '{severity}' AS severity,
  {flags()} AS quality_flags, {fault} AS fault_type, CAST(NULL AS VARCHAR) AS failure_mode_id,
  {confidence} AS detection_confidence, array_to_string({ids}, '|') AS source_event_ids
FROM {source} WHERE {where}"""


def zscore_sql(limit: float) -> str:
    z = "abs((last_value - base_mean) / nullif(base_sd, 0))"
    return anomaly_select(
        "v_group", "rolling_zscore", f"n >= 4 AND {z} >= {limit}", severity="warning", observed="last_value",
        baseline="round(base_mean, 6)", expected=f"round(base_mean + {limit} * base_sd, 6)", count="n", breaches="1",
        confidence=f"least(0.99, round({z} / ({limit} * 2), 3))",
    )


def drift_sql(limit: float) -> str:
    slope = "(last_value - first_value) / (n - 1)"
    return anomaly_select(
        "v_group", "drift_rate_of_change", f"n >= 3 AND abs({slope}) >= {limit}", severity="warning",
        observed=f"round({slope}, 6)", baseline="first_value", expected=f"{limit}", count="n", breaches="n - 1",
    )


SPIKE = anomaly_select(
    "v_group", "threshold_spike", "n >= 2 AND last_value >= base_mean * 2.5", severity="critical", observed="last_value",
    baseline="round(base_mean, 6)", expected="round(base_mean * 2.5, 6)", count="n", breaches="1",
)

view("v_first_gap", f"""
SELECT * EXCLUDE (quality_flags), list_sort(list_distinct(list_concat(prev_flags, quality_flags))) AS quality_flags,
  [prev_id, event_id] AS ids, date_diff('microsecond', prev_time, event_time) / 1000000.0::DOUBLE / 60.0 AS gap
FROM v_gaps QUALIFY row_number() OVER (PARTITION BY {SERIES} ORDER BY prev_time) = 1""")

GAP = anomaly_select(
    "v_first_gap", "missing_heartbeat", "true", severity="critical", observed="gap", baseline="round(prev_value, 6)",
    expected="10.0", count="2", breaches="1", confidence="0.95::DOUBLE", start="prev_time", end="event_time",
)


def flat_sql(value: str) -> str:
    source = f"""(SELECT {SERIES}, count(*) AS n, min({value}) AS lo, max({value}) AS hi, min(event_time) AS window_start,
    max(event_time) AS window_end, min(plant_id) AS plant_id, min(asset_name) AS asset_name,
    min(component_id) AS component_id, min(tag_name) AS tag_name,
    list_sort(list_distinct(flatten(list(quality_flags)))) AS quality_flags,
    list(event_id ORDER BY event_time, event_id) AS ids FROM v_numbered WHERE back <= 6 GROUP BY {SERIES})"""
    return anomaly_select(
        source, "flatline", "n = 6 AND lo = hi", severity="warning", observed="hi", baseline="lo", expected="NULL",
        count="6", breaches="6", fault="'sensor_fault'",
    )


twin("detect_spike", SPIKE)
twin("detect_zscore", zscore_sql(1.5))
twin("detect_drift", drift_sql(0.2))
twin("detect_heartbeat_gap", GAP)
twin("detect_flatline", flat_sql("floor(value / 100) * 100"))
ALL_GROUP = " UNION ALL ".join([GAP, flat_sql("value"), SPIKE, zscore_sql(3.0), drift_sql(0.8)])
twin("detect_all", ALL_GROUP)


def features(value: str) -> str:
    return f"""
SELECT {SERIES}, plant_id, asset_name, component_id, tag_name, event_id, event_time, {value} AS observed_value,
  avg({value}) OVER base AS rolling_baseline_mean,
  stddev_pop({value}) OVER base AS rolling_baseline_stddev,
  lag({value}) OVER series AS prev_window_value,
  date_diff('microsecond', lag(event_time) OVER series, event_time) / 1000000.0::DOUBLE / 60.0 AS gap_minutes,
  CASE WHEN min({value}) OVER recent = max({value}) OVER recent THEN 0.0 ELSE stddev_pop({value}) OVER recent END
    AS window_stddev,
  CAST(count(*) OVER recent AS BIGINT) AS event_count, min(event_time) OVER recent AS window_start,
  event_time AS window_end, quality_flags, list(event_id) OVER recent AS ids
FROM v_measured
WINDOW series AS (PARTITION BY {SERIES} ORDER BY event_time, event_id),
  base AS (PARTITION BY {SERIES} ORDER BY event_time, event_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
  recent AS (PARTITION BY {SERIES} ORDER BY event_time, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""


view("v_features", features("value"))
view("v_coarse_features", features("(floor(value / 100) * 100)"))

twin("detector_features", f"""
SELECT {SERIES}, event_id, event_time, observed_value, round(rolling_baseline_mean, 6) AS rolling_baseline_mean,
  round(rolling_baseline_stddev, 6) AS rolling_baseline_stddev, prev_window_value, round(gap_minutes, 6) AS gap_minutes,
  round(window_stddev, 6) AS window_stddev, event_count, window_start, window_end, {flags()} AS quality_flags,
  array_to_string(ids, '|') AS source_event_ids
FROM v_features""")


def window_sql(source: str, rule: str, where: str, **kw: str | Callable[..., str]) -> str:
    kw = {"count": "event_count", "breaches": "NULL", **kw}
    return anomaly_select(source, rule, where, **kw)


_BASE = "coalesce(nullif(rolling_baseline_mean, 0), 0)"
_Z = "abs((observed_value - rolling_baseline_mean) / nullif(rolling_baseline_stddev, 0))"
_RATE = "abs(observed_value - prev_window_value) / 5.0"


def spike_window(multiplier: float, bounds: bool, extra: str = "true", cut: Callable[..., str] = scaled) -> str:
    limits = " WHEN observed_value <= 1.0 THEN 1.0 WHEN observed_value >= 80.0 THEN 80.0" if bounds else ""
    expected = f"CASE WHEN observed_value >= {_BASE} * {multiplier} THEN {_BASE} * {multiplier}{limits} END"
    return window_sql(
        "v_features", "threshold_spike", f"({expected}) IS NOT NULL AND {extra}", severity="critical",
        observed="observed_value", baseline=cut(_BASE), expected=cut(expected), cut=cut,
    )


def zscore_window(extra: str = "true", cut: Callable[..., str] = scaled) -> str:
    return window_sql(
        "v_features", "rolling_zscore", f"{_Z} >= 3.0 AND {extra}", severity="warning", observed="observed_value",
        baseline=cut("rolling_baseline_mean"),
        expected=cut("rolling_baseline_mean + 3.0 * rolling_baseline_stddev"),
        confidence=f"least(0.99, {cut(f'{_Z} / 6.0', 3)})", cut=cut,
    )


def drift_window(extra: str = "true", cut: Callable[..., str] = scaled) -> str:
    return window_sql(
        "v_features", "drift_rate_of_change", f"{_RATE} >= 0.8 AND {extra}", severity="warning",
        observed=cut(_RATE), baseline="prev_window_value", expected="0.8", cut=cut,
    )


def heartbeat_window(extra: str = "true", cut: Callable[..., str] = scaled) -> str:
    return window_sql(
        "v_features", "missing_heartbeat", f"gap_minutes >= 10 AND {extra}", severity="critical", observed="gap_minutes",
        baseline="NULL", expected="10.0", confidence="0.95::DOUBLE", cut=cut,
    )


def flat_window(source: str, points: int, extra: str = "true", cut: Callable[..., str] = scaled) -> str:
    return window_sql(
        source, "flatline", f"window_stddev = 0 AND event_count >= {points} AND {extra}", severity="warning",
        observed="observed_value", baseline="observed_value", expected="NULL", fault="'sensor_fault'", cut=cut,
    )


twin("detect_spike_window", spike_window(2.5, True))
twin("detect_zscore_window", zscore_window())
twin("detect_drift_window", drift_window())
twin("detect_heartbeat_window", heartbeat_window())
twin("detect_flatline_window", flat_window("v_coarse_features", 3))
twin("rules_apply", " UNION ALL ".join([
    spike_window(2.5, False, "metric_name = 'temperature'", half_up), spike_window(2.0, False, "metric_name = 'temperature'", half_up),
    zscore_window("metric_name = 'vibration'", half_up), drift_window("metric_name = 'pressure'", half_up),
    heartbeat_window("metric_name = 'flow_rate'", half_up), flat_window("v_features", 6, "metric_name = 'power_draw'", half_up),
]))

view("v_profiles", f"""
SELECT 'thr_open_' || r_regionkey AS profile_id, '*' AS tenant_id, NULL AS asset_type, NULL AS component_type,
  {METRICS}[r_regionkey % 5 + 1] AS metric_name, NULL AS unit, 1.0::DOUBLE AS critical_min,
  (r_regionkey * 10 + 60.0)::DOUBLE AS critical_max FROM region
UNION ALL SELECT DISTINCT 'thr_' || lower(p_type) || '_' || b, {tenant('b')}, {ASSET_TYPES}[b % 4 + 1], lower(p_type),
  {METRICS}[b % 5 + 1], '*', 2.0::DOUBLE, (b + 40.0)::DOUBLE
FROM (SELECT p_type, CAST(substr(p_brand, 7) AS BIGINT) AS b FROM part)""")

twin("threshold_profile_match", """
SELECT t.tenant_id, t.tag_id, t.metric_name, p.profile_id, p.critical_min, p.critical_max,
  CASE WHEN p.tenant_id = '*' THEN 0 ELSE 3 END AS named_scopes
FROM v_tags t LEFT JOIN v_assets a ON t.tenant_id = a.tenant_id AND t.asset_id = a.asset_id
LEFT JOIN v_components c ON t.tenant_id = c.tenant_id AND t.asset_id = c.asset_id AND t.component_id = c.component_id
JOIN v_profiles p ON p.metric_name = t.metric_name AND (p.tenant_id = '*' OR (p.tenant_id = t.tenant_id
  AND p.asset_type = a.asset_type AND p.component_type = c.component_type))
QUALIFY row_number() OVER (PARTITION BY t.tenant_id, t.tag_id ORDER BY named_scopes DESC, p.profile_id) = 1""")

# --- windows ------------------------------------------------------------------------------------


def stats_sql(width: str) -> str:
    return f"""
SELECT tenant_id, min_by(asset_id, (event_time, event_id)) AS asset_id, min_by(component_id, (event_time, event_id)) AS component_id,
  '' AS measurement_point_id, tag_id, w AS window_start, w + INTERVAL {width} AS window_end, round(CAST(avg(value) AS DECIMAL(28, 9)), 3)::DOUBLE AS avg_value,
  round(min(value), 3) AS min_value, round(max(value), 3) AS max_value, round(sd, 6) AS stddev_value,
  round(quantile_disc(value, 0.95), 3) AS p95_value, round(CAST((last - first) / greatest(count(*) - 1, 1) AS DECIMAL(28, 12)), 6)::DOUBLE AS slope,
  CASE WHEN sd = 0 THEN 0.0 ELSE round((last - avg(value)) / sd, 6) END AS z_score, CAST(count(*) AS BIGINT) AS event_count,
  15 AS expected_count, array_to_string(list_sort(list_distinct(flatten(list(quality_flags)))), '|') AS quality_flags,
  'unknown' AS operating_state, 'none' AS degradation_stage
FROM (SELECT *, CASE WHEN min(value) OVER p = max(value) OVER p THEN 0.0 ELSE stddev_pop(value) OVER p END AS sd,
    first_value(value) OVER o AS first, last_value(value) OVER o AS last
  FROM (SELECT *, time_bucket(INTERVAL {width}, event_time) AS w FROM v_measured)
  WINDOW p AS (PARTITION BY tenant_id, tag_id, w), o AS (PARTITION BY tenant_id, tag_id, w ORDER BY event_time, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
GROUP BY tenant_id, tag_id, w, sd, first, last"""


twin("window_stats_15m", stats_sql("15 MINUTE"))
twin("window_stats_1d", stats_sql("1 DAY"))

twin("completeness", """
SELECT tenant_id, tag_id, time_bucket(INTERVAL 15 MINUTE, event_time) AS window_start, CAST(count(*) AS BIGINT) AS event_count,
  15 AS expected_count, round(count(*) / 15.0::DOUBLE, 6) AS completeness_ratio, count(*) < 15 AS is_incomplete
FROM v_measured GROUP BY tenant_id, tag_id, time_bucket(INTERVAL 15 MINUTE, event_time)""")

# --- marts --------------------------------------------------------------------------------------

EVENTS_SINCE = "(SELECT as_of - INTERVAL 31 DAY FROM v_as_of)"
ORDERS_SINCE = "(SELECT as_of - INTERVAL 4000 DAY FROM v_order_as_of)"
AS_OF = "(SELECT as_of FROM v_as_of)"
ORDER_AS_OF = "(SELECT as_of FROM v_order_as_of)"

view("v_base_assets", f"""
SELECT tenant_id, asset_id FROM v_anomalies WHERE window_end >= {EVENTS_SINCE}
UNION SELECT tenant_id, asset_id FROM v_diagnoses WHERE created_at >= {EVENTS_SINCE}
UNION SELECT tenant_id, asset_id FROM v_readings WHERE event_time >= {EVENTS_SINCE}""")

view("v_expected", "SELECT tenant_id, asset_id, CAST(count(DISTINCT tag_id) AS BIGINT) AS n FROM v_tags GROUP BY ALL")

twin("base_assets", "SELECT * FROM v_base_assets")

twin("stale_tags", f"""
SELECT tenant_id, asset_id, coalesce(e.n, 0) AS total_expected, coalesce(a.n, 0) AS active_count,
  greatest(coalesce(e.n, 0) - coalesce(a.n, 0), 0) AS stale_count
FROM v_expected e FULL JOIN (SELECT tenant_id, asset_id, CAST(count(DISTINCT tag_id) AS BIGINT) AS n FROM v_readings
  WHERE event_time >= {AS_OF} - INTERVAL 1 HOUR GROUP BY ALL) a USING (tenant_id, asset_id)""")

view("v_base_components", f"""
SELECT tenant_id, asset_id, component_id FROM v_failure_events
  WHERE occurred_at >= {ORDERS_SINCE} OR detected_at >= {ORDERS_SINCE}
UNION SELECT tenant_id, asset_id, component_id FROM v_work_orders
  WHERE created_at >= {ORDERS_SINCE} OR completed_at >= {ORDERS_SINCE}
UNION SELECT tenant_id, asset_id, component_id FROM v_maintenance WHERE performed_at >= {ORDERS_SINCE}
UNION SELECT tenant_id, asset_id, component_id FROM v_components""")

twin("base_components", "SELECT * FROM v_base_components")

view("v_snapshot", f"""
SELECT b.tenant_id, b.asset_id, {AS_OF} AS snapshot_time, coalesce(d.asset_name, '') AS asset_name,
  CASE WHEN a.crit > 0 THEN 'critical' WHEN a.warn > 0 THEN 'warning'
    WHEN greatest(coalesce(e.n, 0) - coalesce(s.n, 0), 0) > 0 THEN 'unknown' ELSE 'healthy' END AS condition_status,
  CAST(coalesce(a.crit, 0) AS BIGINT) AS critical_anomaly_count_15m,
  CAST(coalesce(a.warn, 0) AS BIGINT) AS warning_anomaly_count_15m,
  CAST(coalesce(g.high, 0) AS BIGINT) AS high_risk_diagnosis_count_15m,
  CAST(greatest(coalesce(e.n, 0) - coalesce(s.n, 0), 0) AS BIGINT) AS stale_tag_count_15m,
  CAST(coalesce(h.n, 0) AS BIGINT) AS missing_heartbeat_count_15m, s.last AS last_event_time,
  a.last AS last_anomaly_time, g.last AS last_diagnosis_time, {AS_OF} AS load_time
FROM v_base_assets b
LEFT JOIN (SELECT tenant_id, asset_id, count(DISTINCT anomaly_id) FILTER (severity = 'critical') AS crit,
    count(DISTINCT anomaly_id) FILTER (severity = 'warning') AS warn, max(window_end) AS last
  FROM v_anomalies WHERE window_end >= {EVENTS_SINCE} GROUP BY ALL) a USING (tenant_id, asset_id)
LEFT JOIN (SELECT tenant_id, asset_id, count(DISTINCT diagnosis_id) FILTER (risk_level IN ('critical', 'high')) AS high,
    max(created_at) AS last FROM v_diagnoses WHERE created_at >= {EVENTS_SINCE} GROUP BY ALL) g USING (tenant_id, asset_id)
LEFT JOIN (SELECT tenant_id, asset_id, count(DISTINCT tag_id) AS n, max(event_time) AS last FROM v_readings
  WHERE event_time >= {EVENTS_SINCE} GROUP BY ALL) s USING (tenant_id, asset_id)
LEFT JOIN v_expected e USING (tenant_id, asset_id)
LEFT JOIN (SELECT tenant_id, count(DISTINCT job_name) FILTER (late_event_count > 0) AS n FROM v_health
  WHERE observed_at >= {EVENTS_SINCE} GROUP BY ALL) h USING (tenant_id)
LEFT JOIN v_assets d USING (tenant_id, asset_id)""")

twin("mart_condition_snapshot", "SELECT * FROM v_snapshot")


def signal_view(width: str, since: str = EVENTS_SINCE) -> str:
    return f"""
SELECT s.tenant_id, s.asset_id, s.component_id, s.tag_id, s.metric_name, bucket_minute, avg_value, min_value, max_value,
  last_value, event_count, quality_flags, contains(quality_flags, 'late') AS has_late_arrival,
  coalesce(min_value = max_value AND event_count > 1, false) AS has_flatline,
  coalesce(event_count < 1.0 / t.sampling_rate_seconds * epoch(INTERVAL {width}) * 0.5, false) AS has_missing_heartbeat,
  t.normal_range_min, t.normal_range_max, {AS_OF} AS load_time
FROM (SELECT tenant_id, asset_id, component_id, tag_id, metric_name, time_bucket(INTERVAL {width}, event_time) AS bucket_minute,
    avg(value) AS avg_value, min(value) AS min_value, max(value) AS max_value,
    arg_max(value, (event_time, event_id)) FILTER (value IS NOT NULL) AS last_value,
    CAST(count(*) AS BIGINT) AS event_count,
    array_to_string(list_sort(list_distinct(flatten(list(quality_flags)))), '|') AS quality_flags
  FROM v_readings WHERE event_time >= {since} GROUP BY ALL) s
LEFT JOIN v_tags t ON s.tenant_id = t.tenant_id AND s.tag_id = t.tag_id"""


view("v_signal_1m", signal_view("1 MINUTE"))
view("v_signal_6h", signal_view("6 HOUR"))
twin("mart_signal_1m", "SELECT * REPLACE (round(avg_value, 6) AS avg_value) FROM v_signal_1m")
DAY_SINCE = "(SELECT as_of - INTERVAL 24 HOUR FROM v_as_of)"
view("v_signal_day", signal_view("1 MINUTE", DAY_SINCE))
twin("mart_signal_day", "SELECT * REPLACE (round(avg_value, 6) AS avg_value) FROM v_signal_day")
twin("mart_signal_6h", "SELECT * REPLACE (round(avg_value, 6) AS avg_value) FROM v_signal_6h")

twin("mart_anomaly_enriched", f"""
SELECT a.anomaly_id, a.tenant_id, a.window_start, a.window_end, a.asset_id,
  coalesce(d.asset_name, a.asset_name) AS asset_name, c.component_type, a.tag_id, a.metric_name, a.rule_id, a.severity,
  a.observed_value, 0.0::DOUBLE AS expected_value, 0.85::DOUBLE AS detection_confidence,
  array_to_string(a.quality_flags, '|') AS quality_flags, a.mode AS failure_mode_id,
  coalesce(m.label, '') AS failure_mode_label,
  EXISTS (SELECT 1 FROM v_work_orders w WHERE w.tenant_id = a.tenant_id AND w.asset_id = a.asset_id) AS has_related_workorder,
  EXISTS (SELECT 1 FROM v_maintenance w WHERE w.tenant_id = a.tenant_id AND w.asset_id = a.asset_id)
    AS has_related_maintenance, {AS_OF} AS load_time
FROM (SELECT *, CASE WHEN event_no % 3 = 0 THEN 'fm_economy_' || (event_no % 30) ELSE 'sensor_fault' END AS mode
  FROM v_anomalies WHERE window_start >= {EVENTS_SINCE}) a
LEFT JOIN v_assets d ON a.tenant_id = d.tenant_id AND a.asset_id = d.asset_id
LEFT JOIN v_components c ON a.tenant_id = c.tenant_id AND a.component_id = c.component_id
LEFT JOIN (SELECT DISTINCT 'fm_' || type_code || '_' || brand_no AS mode,
    upper(substr(type_code, 1, 1)) || substr(type_code, 2) || ' Wear ' || brand_no AS label FROM v_modes) m ON a.mode = m.mode""")

def kpi_sql(since: str) -> str:
    return f"""
SELECT tenant_id, asset_id, {AS_OF} AS snapshot_time, CAST(count(DISTINCT diagnosis_id) AS BIGINT) AS diagnosis_count_24h,
  CAST(count(DISTINCT diagnosis_id) FILTER (risk_level = 'high') AS BIGINT) AS high_risk_diagnosis_count_24h,
  CAST(count(DISTINCT diagnosis_id) FILTER (risk_level = 'critical') AS BIGINT) AS critical_risk_diagnosis_count_24h,
  CAST(count(DISTINCT diagnosis_id) FILTER (escalation_required) AS BIGINT) AS escalation_required_count_24h,
  round(avg(confidence), 6) AS avg_confidence_24h,
  CAST(count(DISTINCT diagnosis_id) FILTER (quality_caveats <> '') AS BIGINT) AS diagnosis_with_quality_caveats_24h,
  CAST(count(DISTINCT diagnosis_id) FILTER (anomaly_id IS NOT NULL) AS BIGINT) AS diagnosis_linked_to_anomaly_count_24h,
  max(created_at) AS latest_diagnosis_time, {AS_OF} AS load_time
FROM v_diagnoses WHERE created_at >= {since} GROUP BY tenant_id, asset_id"""


twin("mart_diagnosis_kpi", kpi_sql(EVENTS_SINCE))
twin("mart_diagnosis_kpi_24h", kpi_sql(DAY_SINCE))

_HEALTH_MART = f"""
SELECT tenant_id, source_system, job_name AS pipeline_name, {AS_OF} AS snapshot_time, message_count_5m,
  CAST(coalesce(l.n, 0) AS BIGINT) AS late_event_count_5m, missing_heartbeat_count, CAST(coalesce(q.n, 0) AS BIGINT) AS dlq_count_5m,
  event_lag_seconds, round(ingest_lag_seconds, 6) AS ingest_lag_seconds,
  CASE WHEN event_lag_seconds > 300 OR coalesce(q.n, 0) > 0 THEN 'critical' WHEN event_lag_seconds > 60 THEN 'degraded'
    ELSE 'healthy' END AS health_status, {AS_OF} AS load_time
FROM (SELECT tenant_id, job_name, CAST(count(*) AS BIGINT) AS message_count_5m, max(watermark_lag_seconds) AS event_lag_seconds,
    avg(watermark_lag_seconds) AS ingest_lag_seconds,
    CAST(count(*) FILTER (late_event_count > 0) AS BIGINT) AS missing_heartbeat_count
  FROM v_health WHERE observed_at >= {EVENTS_SINCE} GROUP BY ALL) h
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM v_late WHERE event_time >= {EVENTS_SINCE} GROUP BY ALL) l USING (tenant_id)
LEFT JOIN (SELECT tenant_id, count(*) AS n FROM v_readings WHERE value IS NULL AND event_time >= {EVENTS_SINCE} GROUP BY ALL) q
  USING (tenant_id), (VALUES ('kafka'), ('flink'), ('clickhouse')) x(source_system)"""
twin("mart_stream_health", _HEALTH_MART)
twin("mart_stream_health_5m", _HEALTH_MART.replace(EVENTS_SINCE, "(SELECT as_of - INTERVAL 5 MINUTE FROM v_as_of)"))

view("v_failure_mart", f"""
SELECT b.tenant_id, b.asset_id, b.component_id, {ORDER_AS_OF} AS snapshot_time,
  CAST(coalesce(f.s, 0) AS BIGINT) AS suspected_failure_count, CAST(coalesce(f.c, 0) AS BIGINT) AS confirmed_failure_count,
  CAST(coalesce(w.o, 0) AS BIGINT) AS open_workorder_count, CAST(coalesce(w.c, 0) AS BIGINT) AS completed_workorder_count,
  CAST(coalesce(m.n, 0) AS BIGINT) AS maintenance_count,
  CAST(coalesce(m.s, 0) AS BIGINT) AS sensor_related_maintenance_count, f.t AS latest_failure_time,
  w.t AS latest_workorder_time, m.t AS latest_maintenance_time, {ORDER_AS_OF} AS load_time
FROM v_base_components b
LEFT JOIN (SELECT tenant_id, asset_id, component_id, count(DISTINCT failure_event_id) FILTER (event_status = 'suspected') AS s,
    count(DISTINCT failure_event_id) FILTER (event_status = 'confirmed') AS c, max(occurred_at) AS t FROM v_failure_events
  WHERE occurred_at >= {ORDERS_SINCE} OR detected_at >= {ORDERS_SINCE} GROUP BY ALL) f USING (tenant_id, asset_id, component_id)
LEFT JOIN (SELECT tenant_id, asset_id, component_id, count(DISTINCT work_order_id) FILTER (work_order_status <> 'completed') AS o,
    count(DISTINCT work_order_id) FILTER (work_order_status = 'completed') AS c, max(created_at) AS t FROM v_work_orders
  WHERE created_at >= {ORDERS_SINCE} GROUP BY ALL) w USING (tenant_id, asset_id, component_id)
LEFT JOIN (SELECT tenant_id, asset_id, component_id, count(DISTINCT maintenance_id) AS n,
    count(DISTINCT maintenance_id) FILTER (maintenance_reason LIKE '%sensor%' OR maintenance_type LIKE '%sensor%') AS s,
    max(performed_at) AS t FROM v_maintenance
  WHERE performed_at >= {ORDERS_SINCE} GROUP BY ALL) m USING (tenant_id, asset_id, component_id)""")

twin("mart_failure_evidence", "SELECT * FROM v_failure_mart")

twin("mart_condition_1m", f"""
SELECT tenant_id, asset_id, window_start, window_start + INTERVAL 1 MINUTE AS window_end,
  CASE WHEN a.crit > 0 THEN 'critical' WHEN a.warn > 0 THEN 'warning' WHEN coalesce(s.n, 0) = 0 THEN 'unknown'
    WHEN greatest(coalesce(e.n, 0) - coalesce(s.n, 0), 0) > 0 THEN 'unknown' ELSE 'healthy' END AS condition_status,
  CAST(coalesce(a.crit, 0) AS BIGINT) AS critical_count, CAST(coalesce(a.warn, 0) AS BIGINT) AS warning_count,
  CAST(coalesce(a.n, 0) AS BIGINT) AS anomaly_count, CAST(coalesce(s.n, 0) AS BIGINT) AS active_tags,
  CAST(greatest(coalesce(e.n, 0) - coalesce(s.n, 0), 0) AS BIGINT) AS stale_tags, a.flags AS quality_flags,
  {AS_OF} AS load_time
FROM (SELECT tenant_id, asset_id, date_trunc('minute', event_time) AS window_start, count(DISTINCT tag_id) AS n
  FROM v_readings WHERE event_time >= {EVENTS_SINCE} GROUP BY ALL) s
FULL JOIN (SELECT tenant_id, asset_id, date_trunc('minute', window_start) AS window_start, count(*) AS n,
    count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'warning') AS warn,
    array_to_string(list_sort(list_distinct(flatten(list(quality_flags)))), '|') AS flags
  FROM v_anomalies x WHERE x.window_start >= {EVENTS_SINCE} GROUP BY tenant_id, asset_id, date_trunc('minute', x.window_start)) a
  USING (tenant_id, asset_id, window_start)
LEFT JOIN v_expected e USING (tenant_id, asset_id)""")

view("v_trend", """
SELECT s.tenant_id, s.asset_id, a.asset_name, a.site_id, a.line_id, s.component_id, s.tag_id, t.tag_name, s.metric_name,
  coalesce(nullif(t.display_unit, ''), CASE s.metric_name WHEN 'temperature' THEN 'celsius' WHEN 'power_draw' THEN 'kW'
    WHEN 'pressure' THEN 'bar' WHEN 'flow_rate' THEN 'm3/h' WHEN 'vibration' THEN 'mm/s' ELSE '' END) AS unit,
  t.source_system, t.measurement_point, s.bucket_minute AS signal_time, s.avg_value AS signal_value, s.min_value, s.max_value,
  s.last_value, s.event_count, s.normal_range_min, s.normal_range_max, s.quality_flags, s.has_late_arrival, s.has_flatline,
  s.has_missing_heartbeat, s.tag_id || ' / ' || s.metric_name AS series_name, s.load_time
FROM v_signal_1m s LEFT JOIN v_assets a ON s.tenant_id = a.tenant_id AND s.asset_id = a.asset_id
LEFT JOIN v_tags t ON s.tenant_id = t.tenant_id AND s.asset_id = t.asset_id AND s.tag_id = t.tag_id""")

twin("signal_trend", "SELECT * REPLACE (round(signal_value, 6) AS signal_value) FROM v_trend")

view("v_representative", """
SELECT tenant_id, asset_id, asset_name, tag_id, metric_name, 'asset' AS component_type FROM v_trend
WHERE metric_name IN ('flow_rate', 'pressure', 'vibration', 'power_draw')
QUALIFY row_number() OVER (PARTITION BY tenant_id, metric_name ORDER BY asset_name NULLS FIRST, asset_id, tag_id) = 1""")

twin("representative_tag", "SELECT * FROM v_representative")


def _template_values() -> str:
    from plantpulse.plans.reports import TEMPLATES

    def lit(v: object) -> str:
        if isinstance(v, bool):
            return "true" if v else "false"
        return f"'{v}'" if isinstance(v, str) else (f"{v}::DOUBLE" if isinstance(v, float) else str(v))

    return ", ".join(f"('{m}', " + ", ".join(lit(v) for v in r) + ")" for m, rows in TEMPLATES.items() for r in rows)


twin("seed_anomalies", f"""
SELECT 'seed_' || r.tenant_id || '_' || r.metric_name || '_' || x.ago || '_' || replace(x.rule_id, 'rule_', '') AS anomaly_id,
  r.tenant_id, {AS_OF} - to_minutes(x.ago::BIGINT) AS window_start,
  {AS_OF} - to_minutes(x.ago::BIGINT) + to_minutes(x.dur::BIGINT) AS window_end, r.asset_id, r.asset_name, r.component_type,
  r.tag_id, r.metric_name, x.rule_id, x.severity, x.observed_value, x.expected_value, x.detection_confidence,
  x.quality_flags, x.failure_mode_id, x.failure_mode_label, x.has_related_workorder, x.has_related_maintenance
FROM v_representative r JOIN (VALUES {_template_values()}) x(metric_name, ago, dur, severity, rule_id, observed_value,
  expected_value, detection_confidence, quality_flags, failure_mode_id, failure_mode_label, has_related_workorder,
  has_related_maintenance) ON r.metric_name = x.metric_name
WHERE NOT (r.tenant_id = 'tenant_b' AND x.rule_id = 'rule_pressure_spike' AND x.ago = 25)""")

# --- quality ------------------------------------------------------------------------------------


def check_of(flag: str) -> str:
    return (
        f"CASE WHEN {flag} IN ('late_arrival', 'late_event') THEN 'late_event' WHEN {flag} IN ('threshold_spike', 'range') "
        f"THEN 'range' ELSE 'freshness' END"
    )


_FLAG_EVIDENCE = "'{\"quality_flag\": \"' || flag || '\", \"source\": \"quality_flags\"}'"
_LATE_EVIDENCE = "'{\"event_id\": \"' || event_id || '\", \"reason\": \"' || reason || '\"}'"


def quality_flags_sql(source: str, start: str, end: str) -> str:
    return f"""
SELECT {quality_id(check_of('flag'), start, end, _FLAG_EVIDENCE)} AS quality_event_id, tenant_id, asset_id, tag_id, metric_name,
  {check_of('flag')} AS check_name, 'fail' AS check_status, 'warning' AS severity, CAST(NULL AS DOUBLE) AS observed_value,
  CAST(NULL AS VARCHAR) AS expected_text, {start} AS window_start, {end} AS window_end, {_FLAG_EVIDENCE} AS evidence_json
FROM (SELECT *, unnest(quality_flags) AS flag FROM {source})"""


QUALITY_LATE = f"""
SELECT {quality_id("'late_event'", 'event_time', 'watermark_time', _LATE_EVIDENCE)} AS quality_event_id, tenant_id, asset_id,
  tag_id, metric_name, 'late_event' AS check_name, 'fail' AS check_status, 'warning' AS severity,
  lateness_minutes AS observed_value, '<= allowed_lateness_minutes' AS expected_text, event_time AS window_start,
  watermark_time AS window_end, {_LATE_EVIDENCE} AS evidence_json
FROM v_late"""

_OK_LEAK = "'{\"expected_tenant_id\": \"' || tenant_id || '\", \"tenant_id\": \"' || tenant_id || '\"}'"
QUALITY_LEAK = f"""
SELECT {quality_id("'tenant_leakage'", 'window_start', 'window_end', _OK_LEAK)} AS quality_event_id, tenant_id, asset_id, tag_id,
  metric_name, 'tenant_leakage' AS check_name, 'pass' AS check_status, 'info' AS severity,
  CAST(NULL AS DOUBLE) AS observed_value, CAST(NULL AS VARCHAR) AS expected_text, window_start, window_end,
  {_OK_LEAK} AS evidence_json
FROM v_anomalies"""

QUALITY_ALL = f"{quality_flags_sql('v_anomalies', 'window_start', 'window_end')} UNION ALL {QUALITY_LATE} UNION ALL {QUALITY_LEAK}"

twin("quality_from_flags", quality_flags_sql("v_readings", "event_time", "event_time"))
twin("quality_from_late", QUALITY_LATE)
twin("quality_events", QUALITY_ALL)


def timed(events: str, detected: str) -> str:
    return f"""
SELECT *, check_name AS quality_type, 'open' AS resolution_status, {detected} AS detected_at, (SELECT max(ts) FROM events) AS created_at
FROM ({events})"""


_LATE_TIMED = QUALITY_LATE.replace("AS evidence_json", "AS evidence_json, ingest_time")
twin("quality_event_rows", f"""
SELECT * EXCLUDE (ingest_time) FROM ({timed(_LATE_TIMED, "ingest_time")})
UNION ALL {timed(quality_flags_sql("v_anomalies", "window_start", "window_end"), "(SELECT max(ts) FROM events)")}""")

twin("quality_table_checks", f"""
SELECT tenant_id, check_name, checked, failed, CASE WHEN failed > 0 THEN 'fail' ELSE 'pass' END AS check_status FROM (
  SELECT tenant_id, 'completeness' AS check_name, count(*) AS checked, count(*) FILTER (n < 15) AS failed FROM (
    SELECT tenant_id, tag_id, time_bucket(INTERVAL 15 MINUTE, event_time), count(value) AS n FROM v_readings GROUP BY ALL) GROUP BY tenant_id
  UNION ALL SELECT tenant_id, 'duplicate', count(*), CAST(count(*) - count(DISTINCT event_id) AS BIGINT) FROM v_readings GROUP BY tenant_id
  UNION ALL SELECT r.tenant_id, 'range', count(r.value),
    count(*) FILTER (r.value < t.normal_range_min OR r.value > t.normal_range_max)
    FROM v_readings r JOIN v_tags t ON r.tenant_id = t.tenant_id AND r.tag_id = t.tag_id GROUP BY r.tenant_id
  UNION ALL SELECT tenant_id, 'freshness', count(*), count(*) FILTER (newest < {AS_OF} - INTERVAL 900 SECOND - INTERVAL 999999 MICROSECOND)
    FROM (SELECT tenant_id, tag_id, max(event_time) AS newest FROM v_readings GROUP BY ALL) GROUP BY tenant_id)""")

# --- context, evidence, recommendations -----------------------------------------------------------

twin("anomaly_signal_window", """
SELECT a.anomaly_id, a.tenant_id, a.tag_id, a.metric_name, a.window_start - INTERVAL 6 HOUR AS signal_from,
  a.window_end + INTERVAL 6 HOUR AS signal_to, min(r.pos) AS first_position, max(r.pos) AS last_position,
  count(*) AS reading_count
FROM v_anomalies a JOIN (SELECT *, row_number() OVER (PARTITION BY tenant_id, tag_id, metric_name ORDER BY event_time, event_id)
    AS pos FROM v_readings) r
  ON r.tenant_id = a.tenant_id AND r.tag_id = a.tag_id AND r.metric_name = a.metric_name
  AND r.event_time BETWEEN a.window_start - INTERVAL 6 HOUR AND a.window_end + INTERVAL 6 HOUR
GROUP BY ALL""")

view("v_last_readings", """
SELECT tenant_id, tag_id, list(event_id ORDER BY event_time, event_id) AS ids FROM (SELECT * FROM v_readings
  QUALIFY row_number() OVER (PARTITION BY tenant_id, tag_id ORDER BY event_time DESC, event_id DESC) <= 5) GROUP BY ALL""")

view("v_last_late_rows", """
SELECT * FROM v_late QUALIFY row_number() OVER (PARTITION BY tenant_id, tag_id ORDER BY event_time DESC, event_id DESC) <= 5""")

view("v_last_late", f"""
SELECT tenant_id, tag_id, list(event_id ORDER BY event_time, event_id) AS ids,
  list({quality_id("'late_event'", 'event_time', 'watermark_time', _LATE_EVIDENCE)}) AS qids
FROM v_last_late_rows GROUP BY ALL""")

twin("latest_n_context", """
SELECT a.anomaly_id, array_to_string(coalesce(r.ids, []), '|') AS sensor_events,
  array_to_string(coalesce(l.ids, []), '|') AS late_events,
  (SELECT max(observed_at) FROM v_health h WHERE h.tenant_id = a.tenant_id) AS health_observed_at
FROM v_anomalies a LEFT JOIN v_last_readings r USING (tenant_id, tag_id) LEFT JOIN v_last_late l USING (tenant_id, tag_id)""")

view("v_context", """
SELECT a.anomaly_id, a.tenant_id, a.asset_id, a.component_id, a.tag_id, coalesce(d.asset_name, '') AS asset_name,
  coalesce(d.asset_type, '') AS asset_type, coalesce(d.asset_class, '') AS asset_class, coalesce(d.site_id, '') AS site_id,
  coalesce(d.area_id, '') AS area_id, coalesce(d.line_id, '') AS line_id,
  coalesce(d.functional_location, '') AS functional_location, coalesce(c.component_type, '') AS component_type,
  '' AS manufacturer, '' AS model, coalesce(t.source_system, '') AS source_system,
  coalesce(t.measurement_point, '') AS measurement_point, coalesce(t.expected_unit, '') AS expected_unit,
  t.normal_range_min, t.normal_range_max, t.sampling_rate_seconds
FROM v_anomalies a LEFT JOIN v_assets d ON a.tenant_id = d.tenant_id AND a.asset_id = d.asset_id
LEFT JOIN v_components c ON a.tenant_id = c.tenant_id AND a.component_id = c.component_id
LEFT JOIN v_tags t ON a.tenant_id = t.tenant_id AND a.tag_id = t.tag_id""")

twin("anomaly_context", "SELECT * FROM v_context")

twin("evidence_by_entity", """
SELECT 'workorder' AS entity, tenant_id, asset_id, work_order_id AS record_id, 'work_orders' AS evidence_group FROM v_work_orders
UNION ALL SELECT 'maintenance', tenant_id, asset_id, maintenance_id, 'maintenance_records' FROM v_maintenance
UNION ALL SELECT 'apm_failureevent', tenant_id, asset_id, failure_event_id, 'failure_events' FROM v_failure_events""")

view("v_evidence", f"""
SELECT {sha1_id('ev_', "tenant_id || '|' || anomaly_id || '|triage_evidence.v1'")} AS evidence_id,
  a.*, coalesce(r.ids, []) AS sensor_ids,
  list_sort(list_distinct(list_concat(coalesce(l.qids, []), coalesce(f.qids, [])))) AS qids,
  coalesce(len(f.qids), 0) > 0 AND list_contains(quality_flags, 'threshold_spike') AS has_range,
  list_contains(quality_flags, 'late_arrival') OR l.ids IS NOT NULL AS has_late,
  list_contains(quality_flags, 'degraded_signal') AS has_fresh
FROM v_anomalies a LEFT JOIN v_last_readings r USING (tenant_id, tag_id) LEFT JOIN v_last_late l USING (tenant_id, tag_id)
LEFT JOIN (SELECT anomaly_id, list({quality_id(check_of('flag'), 'window_start', 'window_end', _FLAG_EVIDENCE)}) AS qids
  FROM (SELECT *, unnest(quality_flags) AS flag FROM v_anomalies) GROUP BY anomaly_id) f USING (anomaly_id)""")

twin("triage_evidence", f"""
SELECT evidence_id, 'triage_evidence.v1' AS evidence_version, tenant_id, anomaly_id, asset_id, component_id, tag_id, metric_name,
  window_start, window_end, observed_value, 0.0::DOUBLE AS baseline_value, 0.0::DOUBLE AS expected_value,
  {flags('list_sort(list_distinct(quality_flags))')} AS quality_flags, event_id AS source_event_ids,
  array_to_string(qids, '|') AS quality_event_ids, array_to_string(sensor_ids, '|') AS sensor_events,
  'generic_asset_triage#' || metric_name AS runbooks, {iso('window_start')} AS json_window_start
FROM v_evidence""")

def newest(view_name: str, name: str, at: str, more: str) -> str:
    """One row per asset and time, moved to the years of the events: of several the last by id."""
    return f"""(SELECT tenant_id, asset_id, {at} + INTERVAL 26 YEAR AS t, max({name}) AS id, {more} FROM {view_name} GROUP BY ALL)"""


view("v_history", f"""
SELECT a.anomaly_id, a.tenant_id, w.id AS work_order_id, w.status AS work_order_status, w.t AS work_order_at, m.id AS maintenance_id,
  f.id AS failure_mode_id, f.t AS failed_at
FROM v_anomalies a
ASOF LEFT JOIN {newest("v_work_orders", "work_order_id", "created_at", "max_by(work_order_status, work_order_id) AS status")} w
  ON a.tenant_id = w.tenant_id AND a.asset_id = w.asset_id AND a.window_start >= w.t
ASOF LEFT JOIN {newest("v_maintenance", "maintenance_id", "performed_at", "1 AS x")} m
  ON a.tenant_id = m.tenant_id AND a.asset_id = m.asset_id AND a.window_start >= m.t
ASOF LEFT JOIN {newest("v_failure_events", "failure_event_id", "occurred_at", "1 AS x")} f
  ON a.tenant_id = f.tenant_id AND a.asset_id = f.asset_id AND a.window_start >= f.t""")

twin("evidence_context", """
SELECT anomaly_id, work_order_id, work_order_status, work_order_at, maintenance_id, failure_mode_id, failed_at,
  work_order_id AS json_work_order, failure_mode_id AS json_failure_mode FROM v_history""")

twin("evidence_runbook", """
SELECT c.anomaly_id, CASE asset_type WHEN 'pump' THEN 'manufacturing_rotating_equipment' WHEN 'boiler' THEN
    'power_generation_vibration' WHEN 'chiller' THEN 'campus_bms_checks' WHEN 'conveyor' THEN
    'industrial_asset_management_generic' ELSE 'generic_asset_triage' END AS runbook_id, a.metric_name AS section
FROM v_context c JOIN v_anomalies a USING (anomaly_id)""")

twin("evidence_assembled", f"""
SELECT e.evidence_id, e.anomaly_id,
  CASE WHEN list_contains(e.quality_flags, 'late_arrival') THEN
    {sha1_id('qe_', "e.tenant_id || '|' || e.anomaly_id || '|quality_caveats'")} ELSE '' END AS quality_event_ids,
  CASE WHEN list_contains(e.quality_flags, 'late_arrival') THEN
    'Data contains late-arriving events during the anomaly window.' ELSE '' END AS quality_caveats,
  CASE a.asset_type WHEN 'pump' THEN 'manufacturing_rotating_equipment' WHEN 'boiler' THEN
    'power_generation_vibration' WHEN 'chiller' THEN 'campus_bms_checks' WHEN 'conveyor' THEN
    'industrial_asset_management_generic' ELSE 'generic_asset_triage' END || '#' || e.metric_name AS runbooks
FROM v_evidence e LEFT JOIN v_assets a ON e.tenant_id = a.tenant_id AND e.asset_id = a.asset_id""")

twin("evidence_caveats", """
SELECT event_id, array_to_string(list_filter([
  CASE WHEN event_no % 9 = 0 THEN 'Flatline (frozen sensor) detected during the anomaly window.' END,
  CASE WHEN event_no % 9 = 0 THEN 'Data gap detected in the anomaly window.' END,
  CASE WHEN event_no % 9 <> 0 AND list_contains(quality_flags, 'late_arrival') THEN
    'Data contains late-arriving events during the anomaly window.' END,
  CASE WHEN event_no % 5 = 0 THEN 'Signal window evidence is missing or empty.' END], lambda x: x IS NOT NULL), '|') AS caveats
FROM v_readings""")

view("v_recommendations", f"""
SELECT {sha1_id('rec_', "tenant_id || '|' || anomaly_id || '|triage_evidence.v1'")} AS recommendation_id,
  'agent_explanation.v1' AS schema_version, tenant_id, anomaly_id, 'triage_evidence.v1' AS evidence_version, asset_id,
  component_id, asset_id || ' has an evidence-backed ' || metric_name || ' anomaly in the selected window. '
    || 'Review the recommended checks before taking operational action.' AS summary,
  'Observed value ' || observed_value || ' vs expected 0.0.|Detection window ' || {iso('window_start')} || ' to '
    || {iso('window_end')} || '.' AS findings,
  'Hypothesis: sensor or process condition changed during the anomaly window.|' || CASE WHEN len(qids) > 0
    THEN 'Hypothesis: data quality issues may affect confidence.'
    ELSE 'Hypothesis: physical operating condition breached configured expectations.' END AS possible_causes,
  'Check recent sensor readings and source event IDs in Doris.|Review asset runbook references before operator action.|'
    || 'Confirm data quality flags before escalating severity.' AS recommended_checks,
  'generic_asset_triage#' || metric_name AS runbook_references, tag_id AS related_signals, '' AS related_failure_modes,
  'Review ' || metric_name || ' readings on ' || asset_id || '/' || component_id
    || ' in Doris and cross-check with asset runbook references before operator action.' AS suggested_action,
  CASE WHEN len(qids) > 0 THEN 'low' ELSE 'medium' END AS confidence_label,
  array_to_string(list_filter([CASE WHEN has_fresh THEN 'Quality check freshness reported fail/warning.' END,
    CASE WHEN has_late THEN 'Quality check late_event reported fail/warning.' END,
    CASE WHEN has_range THEN 'Quality check range reported fail/warning.' END], lambda x: x IS NOT NULL), '|') AS quality_caveats,
  'fallback-rule-based' AS model_name, 'triage_prompt.v1' AS prompt_version, 0.0::DOUBLE AS token_cost, 0 AS latency_ms,
  '2024-02-01T00:00:00Z' AS created_at, 'fallback' AS status, event_no
FROM v_evidence""")

twin("recommendations", "SELECT * EXCLUDE (event_no) FROM v_recommendations")

twin("recommendations_in_context", """
SELECT r.recommendation_id, r.anomaly_id, r.related_signals, coalesce(h.failure_mode_id, '') AS related_failure_modes, r.confidence_label
FROM v_recommendations r JOIN v_history h USING (tenant_id, anomaly_id)""")



def listed(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN '[]' ELSE '[\"' || replace({c}, '|', '\", \"') || '\"]' END"


twin("recommendation_store", f"""
SELECT recommendation_id, anomaly_id, {listed('findings')} AS findings, {listed('possible_causes')} AS possible_causes,
  {listed('runbook_references')} AS runbook_references, {listed('quality_caveats')} AS quality_caveats, status,
  'valid' AS validation_status, CAST(NULL AS VARCHAR) AS quarantine_reason
FROM v_recommendations""")

twin("diagnosis_project", """
SELECT recommendation_id AS diagnosis_id, tenant_id, asset_id, component_id, anomaly_id AS anomaly_event_id,
  summary AS diagnosis_summary, possible_causes AS probable_causes, related_signals, related_failure_modes,
  recommended_checks, suggested_action, 'medium' AS risk_level, 0.5::DOUBLE AS confidence, false AS escalation_required,
  quality_caveats, TIMESTAMP '2024-02-01' AS generated_at, 'agent.v1' AS agent_version, prompt_version,
  'fallback-rule-based' AS model_version
FROM v_recommendations""")


def reasons(*pairs: tuple[str, str]) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in pairs)
    return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"


_REASONS = reasons(
    ("event_no % 11 = 0", "cross_tenant"), ("event_no % 13 = 0", "unsupported_anomaly"),
    ("event_no % 17 = 0", "unsupported_evidence_version"), ("event_no % 19 = 0", "evidence_free"),
    ("event_no % 23 = 0", "unsupported_runbook_ref:other#book"), ("event_no % 7 = 0", "banned_autonomous_claim"),
)
twin("recommendation_validate", f"""
SELECT anomaly_id AS evidence_key, CASE WHEN len(r) > 0 THEN 'quarantined' ELSE 'valid' END AS validation_status,
  CASE WHEN len(r) > 0 THEN array_to_string(r, ';') END AS quarantine_reason
FROM (SELECT anomaly_id, {_REASONS} AS r FROM v_anomalies)""")

_DIAG = reasons(
    ("event_no % 11 = 0", "cross_tenant"), ("event_no % 13 = 0", "anomaly_mismatch"),
    ("event_no % 17 = 0", "evidence_version_mismatch"), ("event_no % 19 = 0", "empty_findings_or_causes"),
    ("event_no % 7 = 0", "banned_autonomous_claim"),
)
twin("diagnosis_validate", f"""
SELECT anomaly_id AS evidence_key, CASE WHEN len(r) > 0 THEN 'quarantined' ELSE 'valid' END AS validation_status,
  array_to_string(r, '|') AS failure_reasons,
  CASE WHEN len(r) > 0 THEN {sha1_id('qn_', "tenant_id || '|' || anomaly_id || '|quarantine'")} END AS quarantine_id
FROM (SELECT tenant_id, anomaly_id, {_DIAG} AS r FROM v_anomalies)""")

twin("response_parse", """
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 < 2 THEN 'parsed_json' ELSE 'non_json' END AS parsed_status,
  CASE WHEN (conv_id + turn) % 4 < 2 THEN md5(text) END AS summary_md5
FROM conversations""")

twin("recommendation_choose", """
SELECT anomaly_id, CASE WHEN ok THEN 'Model summary ' || event_no ELSE summary END AS summary,
  CASE WHEN ok THEN 'model-x' ELSE model_name END AS model_name,
  round(CASE WHEN ok THEN event_no % 100 * 0.001::DOUBLE ELSE token_cost END, 6) AS token_cost,
  CAST(CASE WHEN ok THEN event_no % 1000 ELSE 0 END AS INTEGER) AS latency_ms,
  CASE WHEN ok THEN 'llm_generated' ELSE status END AS status,
  CASE WHEN ok THEN 'valid' WHEN event_no % 2 = 0 AND event_no % 6 <> 0 THEN 'quarantined' ELSE 'fallback' END AS chosen_status,
  CASE WHEN ok THEN '' WHEN event_no % 6 = 0 THEN 'non_json' WHEN event_no % 10 = 0 THEN 'evidence_free' ELSE '' END
    AS chosen_reason
FROM (SELECT *, event_no % 2 = 0 AND event_no % 6 <> 0 AND event_no % 10 <> 0 AS ok FROM v_recommendations)""")

twin("invocation_audit", f"""
SELECT {sha1_id('inv_', "tenant_id || '|pending|' || anomaly_id || '|' || evidence_id || '|' || request_hash")} AS invocation_id,
  tenant_id, 'pending' AS incident_id, anomaly_id, evidence_id, 'openai' AS provider, 'model-x' AS model_name,
  'triage_prompt.v1' AS prompt_version, request_hash, 'raw ' || event_no AS raw_response, 'parsed_json' AS parsed_status,
  'valid' AS validation_status, '' AS quarantine_reason,
  round((event_no % 500) * 0.001::DOUBLE / 1000 + (event_no % 300) * 0.002::DOUBLE / 1000, 9) AS token_cost, 12 AS latency_ms,
  TIMESTAMP '2024-02-01' AS created_at
FROM (SELECT *, substr(sha1('{{"evidence_id":"' || evidence_id || '"}}'), 1, 32) AS request_hash FROM v_evidence)""")

# --- incidents and alerts ---------------------------------------------------------------------------


def sessions(gap: str) -> str:
    return f"""
SELECT *, sum(opened) OVER (PARTITION BY tenant_id, asset_id, metric_name, rule_id ORDER BY window_start, anomaly_id) AS session
FROM (SELECT *, CASE WHEN window_start <= lag(window_start) OVER w + INTERVAL {gap} THEN 0 ELSE 1 END AS opened
  FROM v_anomalies WINDOW w AS (PARTITION BY tenant_id, asset_id, metric_name, rule_id ORDER BY window_start, anomaly_id))"""


_SEVERITY = "max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)"


def incident_select(source: str) -> str:
    key = (
        "tenant_id || '|' || asset_id || '|' || metric_name || '|' || rule_id || '|' || "
        + iso("time_bucket(INTERVAL 5 MINUTE, first_seen_at)")
    )
    return f"""
SELECT {sha1_id('inc_', key)} AS incident_id, {key} AS correlation_key, tenant_id, asset_id, metric_name, rule_id,
  first_seen_at, last_seen_at, anomaly_count, ['info','warning','critical'][sev] AS max_severity, ids[1] AS primary_anomaly_id,
  'open' AS status, ['dashboard_only','ticket_simulated','teams_card'][sev] AS routing_channel, ids
FROM (SELECT tenant_id, asset_id, metric_name, rule_id, session, min(window_start) AS first_seen_at,
    max(window_start) AS last_seen_at, CAST(count(*) AS BIGINT) AS anomaly_count, {_SEVERITY} AS sev,
    list(anomaly_id ORDER BY window_start, anomaly_id) AS ids
  FROM {source} GROUP BY ALL)"""


view("v_sessions_10m", sessions("10 MINUTE"))
view("v_sessions_12h", sessions("12 HOUR"))
view("v_incidents", incident_select("v_sessions_10m"))
view("v_incidents_12h", incident_select("v_sessions_12h"))

twin("incidents", "SELECT * EXCLUDE (ids) FROM v_incidents")
twin("incidents_12h", "SELECT * EXCLUDE (ids) FROM v_incidents_12h")

view("v_members", """
SELECT i.incident_id, m.anomaly_id, a.window_start AS seen_at, m.position
FROM v_incidents_12h i, LATERAL (SELECT unnest(ids) AS anomaly_id, generate_subscripts(ids, 1)::BIGINT AS position) m
JOIN v_anomalies a ON a.anomaly_id = m.anomaly_id""")

twin("incident_members", "SELECT incident_id, anomaly_id, seen_at, position FROM v_members")

twin("incident_id_pages", """
SELECT incident_id, (position - 1) // 2 AS page, string_agg(anomaly_id, '|' ORDER BY position) AS source_anomaly_ids
FROM v_members GROUP BY incident_id, (position - 1) // 2""")

view("v_incident_context", """
SELECT i.*, e.evidence_id, r.recommendation_id, r.summary, r.recommended_checks
FROM v_incidents_12h i LEFT JOIN v_evidence e ON e.anomaly_id = i.primary_anomaly_id
LEFT JOIN v_recommendations r ON r.anomaly_id = i.primary_anomaly_id""")

twin("incident_context", """
SELECT incident_id, tenant_id, primary_anomaly_id, evidence_id, recommendation_id, summary FROM v_incident_context""")

twin("route_alerts", """
SELECT 'route_' || incident_id AS route_id, incident_id, tenant_id, max_severity AS severity, routing_channel,
  CASE WHEN routing_channel = 'teams_card' THEN 'pending' ELSE 'simulated' END AS routing_status,
  routing_channel AS notification_target, CAST(NULL AS VARCHAR) AS error_message, TIMESTAMP '2024-02-01' AS created_at
FROM v_incidents""")

twin("alert_text", f"""
SELECT incident_id, 'Alert: ' || tenant_id || ' / ' || asset_id || ' / ' || metric_name AS alert_summary,
  CASE WHEN max_severity = 'critical' THEN 'FF0000' ELSE 'FFA500' END AS alert_color,
  array_to_string(['Tenant: ' || tenant_id, 'Asset: ' || asset_id, 'Metric: ' || metric_name, 'Rule: ' || rule_id,
    'Incident ID: ' || incident_id, 'Severity: ' || max_severity, 'Anomaly count: ' || anomaly_count,
    'First seen: ' || {iso('first_seen_at')}, 'Last seen: ' || {iso('last_seen_at')}, 'Cooldown: 10 min',
    'Triage finding: ' || summary, 'Recommended checks: ' || replace(recommended_checks, '|', ', '),
    'Evidence ID: ' || evidence_id, 'Recommendation ID: ' || recommendation_id,
    'This is an LLM-assisted triage summary for operator review. Review the recommended checks before taking operational action.'],
    chr(10) || chr(10)) AS alert_text
FROM v_incident_context""")

# --- inspection and reports ---------------------------------------------------------------------------

_TABLES = {
    "readings": ("v_readings", "event_time"), "anomalies": ("v_anomalies", "window_start"), "late": ("v_late", "event_time"),
    "health": ("v_health", "observed_at"), "diagnoses": ("v_diagnoses", "created_at"),
    "work_orders": ("v_work_orders", "created_at"), "maintenance": ("v_maintenance", "performed_at"),
    "failure_events": ("v_failure_events", "occurred_at"),
}
_COUNTED = {n: v for n, (v, _) in _TABLES.items()} | {"assets": "v_assets", "components": "v_components", "tags": "v_tags"}
twin("row_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {v}" for n, v in _COUNTED.items()))
twin("time_ranges", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, min({c}) AS min_time, max({c}) AS max_time FROM {v}" for n, (v, c) in _TABLES.items()
))
twin("cdc_op_distribution", "SELECT 'assets' AS dim_table, cdc_op, count(*) AS cnt FROM v_assets_cdc GROUP BY cdc_op")
twin("condition_distribution", "SELECT tenant_id, condition_status, count(*) AS asset_count FROM v_snapshot GROUP BY ALL")
twin("evidence_totals", """
SELECT tenant_id, CAST(sum(suspected_failure_count) AS BIGINT) AS total_suspected,
  CAST(sum(confirmed_failure_count) AS BIGINT) AS total_confirmed, CAST(sum(open_workorder_count) AS BIGINT) AS total_open_wo,
  CAST(sum(completed_workorder_count) AS BIGINT) AS total_completed_wo, CAST(sum(maintenance_count) AS BIGINT) AS total_maintenance
FROM v_failure_mart GROUP BY tenant_id""")
twin("ingest_profile", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {c} AS item, count(*) AS event_count, min(event_time) AS first_event_time, "
    f"max(event_time) AS last_event_time FROM v_readings GROUP BY {c}"
    for d, c in (("scenario", "scenario"), ("tenant", "tenant_id"), ("metric", "metric_name"))
) + " UNION ALL SELECT 'total', 'all', count(*), min(event_time), max(event_time) FROM v_readings")
twin("recent_rows", """
SELECT tenant_id, event_id, tag_id, metric_name, event_time, value, unit FROM v_readings
ORDER BY event_time DESC, event_id LIMIT 10""")
twin("top_failures", """
SELECT tenant_id, asset_id, component_id, suspected_failure_count, confirmed_failure_count, open_workorder_count,
  completed_workorder_count, maintenance_count
FROM v_failure_mart ORDER BY suspected_failure_count + confirmed_failure_count DESC, tenant_id, asset_id, component_id LIMIT 10""")
twin("triage_queue", """
SELECT tenant_id, anomaly_id, asset_id, tag_id, metric_name, window_start, severity FROM v_anomalies
ORDER BY window_start DESC, anomaly_id LIMIT 10""")
twin("replay_diff", """
SELECT anomaly_id, tenant_id, tag_id, severity, window_start, s::BIGINT AS surplus FROM (
  SELECT *, 1 AS s FROM v_anomalies UNION ALL
  SELECT * REPLACE ('info' AS severity), -1 AS s FROM v_anomalies)
WHERE event_no % 50 = 0 AND event_no NOT IN (SELECT event_no FROM v_anomalies WHERE severity = 'info')""")
twin("report_anomaly_trend", f"SELECT tenant_id, rule_id, count(*) AS anomaly_count FROM ({ALL_GROUP}) GROUP BY ALL")
twin("report_late_rate", """
SELECT tenant_id, count(*) AS event_count, count(*) FILTER ((event_no % 20) * 60 > 600) AS late_event_count,
  round(count(*) FILTER ((event_no % 20) * 60 > 600) / count(*), 6) AS late_rate
FROM v_readings GROUP BY tenant_id""")
twin("report_quality_failures", f"""
SELECT tenant_id, check_name, count(*) AS failure_count FROM ({QUALITY_ALL}) WHERE check_status = 'fail' GROUP BY ALL""")
twin("report_asset_health", """
SELECT tenant_id, asset_id, count(*) FILTER (severity = 'critical') AS critical_anomaly_count FROM v_anomalies GROUP BY ALL""")
