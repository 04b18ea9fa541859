"""Cases off the test tables: appended files, missing evidence, extreme values, odd text, late withdrawals."""

from __future__ import annotations

import json
import math
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.functions.text import spaced_json
from plantpulse.operators import contracts, detectors, enrich, validate
from plantpulse.sources import logs
from plantpulse.sources import testtables as t
from plantpulse.streaming import jobs

T0 = datetime(2024, 1, 1)
PASSENGERS = detectors._PASSENGERS


def readings(spark, values, minutes=None, tag="tag_1", flags=()):
    minutes = minutes or [5 * i for i in range(len(values))]
    rows = [
        ("tenant_a", "asset_1", tag, "temperature", T0 + timedelta(minutes=m), f"e{m:05d}", float(v), list(flags))
        for v, m in zip(values, minutes, strict=True)
    ]
    schema = "tenant_id string, asset_id string, tag_id string, metric_name string, event_time timestamp_ntz, event_id string, value double, quality_flags array<string>"
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({c: F.lit(c) for c in PASSENGERS if c not in df.columns}).withColumn("ingest_time", F.col("event_time"))


def test_a_view_reads_files_added_between_two_calls(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base.limit(5).write.parquet(str(tmp_path / "events.parquet"))
    assert t.readings(spark, str(tmp_path)).count() == 5
    base.limit(5).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert t.readings(spark, str(tmp_path)).count() == 10


def evidence(spark, rows):
    schema = "tenant_id string, anomaly_id string, evidence_version string, runbook_refs array<struct<runbook_id:string,section:string>>"
    return spark.createDataFrame(rows, schema)


def test_validation_keeps_rows_without_evidence_and_tells_tenants_apart(spark):
    ev = evidence(spark, [("tenant_a", "anom_1", "v1", []), ("tenant_b", "anom_1", "v1", [])])
    rows = [("tenant_a", "anom_1"), ("tenant_b", "anom_1"), ("tenant_a", "anom_2")]
    rec = spark.createDataFrame(rows, "tenant_id string, anomaly_id string").select(
        "*", F.col("tenant_id").alias("evidence_tenant"), F.col("anomaly_id").alias("evidence_key"), F.lit("v1").alias("evidence_version"),
        F.lit("text").alias("summary"), *[F.array(F.lit("x")).alias(c) for c in ("findings", "possible_causes", "recommended_checks")],
        F.array().cast("array<string>").alias("runbook_references"),
    )
    got = {(r.tenant_id, r.anomaly_id): (r.validation_status, r.quarantine_reason) for r in validate.validate_recommendations(rec, ev).collect()}
    assert got == {
        ("tenant_a", "anom_1"): ("valid", None),
        ("tenant_b", "anom_1"): ("valid", None),
        ("tenant_a", "anom_2"): ("quarantined", "missing_evidence"),
    }
    got = validate.validate_diagnoses(rec, ev).collect()
    assert sorted((r.anomaly_id, r.failure_reasons) for r in got) == [("anom_1", []), ("anom_1", []), ("anom_2", ["missing_evidence"])]


@pytest.mark.parametrize("last", [1e5, 1e9, 1e12, 1e15])
def test_zscore_baseline_keeps_its_digits_beside_an_outlier(spark, last):
    base = [20.5, 19.5] * 10
    (a,) = detectors.detect_zscore(readings(spark, [*base, last])).collect()
    assert a.baseline_value == statistics.fmean(base)
    assert math.isclose(a.expected_value, 20 + 3 * 0.5, abs_tol=1e-6)


def test_zscore_is_silent_on_a_constant_baseline(spark):
    assert detectors.detect_zscore(readings(spark, [7.0] * 9 + [8.0])).count() == 0


def test_window_spike_falls_back_to_the_given_baseline(spark):
    f = detectors.detector_features(readings(spark, [100.0])).withColumns(
        {"baseline_value": F.lit(90.0), "breach_count": F.lit(4), "failure_mode_id": F.lit("fm_1")}
    )
    given = F.col("baseline_value")
    assert detectors.window_anomalies(f, detectors.spike_verdict(given=given)).count() == 0
    (a,) = detectors.window_anomalies(f.withColumn("observed_value", F.lit(300.0)), detectors.spike_verdict(given=given)).collect()
    assert (a.baseline_value, a.expected_value, a.breach_count, a.failure_mode_id) == (90.0, 225.0, 4, "fm_1")


def test_a_repeated_mapping_takes_the_newest(spark):
    tags = spark.createDataFrame(
        [("tag_1", "tenant_a", "bar", 1), ("tag_1", "tenant_a", "kw", 2)], "tag_id string, tenant_id string, unit string, updated_at int"
    )
    r = spark.createDataFrame([("tag_1", "tenant_a", "kw")], "tag_id string, tenant_id string, unit string")
    assert enrich.check_mapping(r, tags).first()["error_code"] is None


def test_contract_summary_lists_zeros_and_empty_input(spark):
    none = spark.createDataFrame([], "value string")
    got = {r.measure: r.n for r in contracts.contract_summary(none).collect()}
    assert got == {"total_records": 0, "accepted_records": 0, "rejected_records": 0, "errors:no_input_records": 1}
    one = spark.createDataFrame([("{}",)], "value string")
    got = {r.measure: r.n for r in contracts.contract_summary(one).collect()}
    assert (got["total_records"], got["accepted_records"], got["rejected_records"]) == (1, 0, 1)
    assert "errors:no_input_records" not in got


def test_contracts_with_type_lists_and_item_counts(spark):
    contract = {
        "title": "anomaly",
        "type": "object",
        "properties": {
            "baseline": {"type": ["number", "null"]},
            "ids": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 2},
        },
    }
    lines = ['{"baseline": null, "ids": ["a"]}', '{"baseline": 1.5, "ids": ["a", "b"]}', '{"baseline": "x"}', '{"ids": []}', '{"ids": ["a", "b", "c"]}']
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    got = [[(e.field_path, e.error_code, e.message) for e in r.errors] for r in contracts.contract_errors(df, contract).orderBy("i").collect()]
    assert got == [
        [],
        [],
        [("/baseline", "invalid_type", "'x' is not of type 'number', 'null'")],
        [("/ids", "schema_validation_error", "[] should be non-empty")],
        [("/ids", "schema_validation_error", '["a","b","c"] is too long')],
    ]
    with pytest.raises(ValueError, match="oneOf"):
        contracts.contract_errors(df, {"title": "x", "properties": {"a": {"oneOf": []}}})


def test_json_text_equals_the_standard_library(spark):
    texts = ['plain "quoted" \\ back', "line\nbreak\ttab\r\b\f", "\x01\x0b\x1f\x7f", "é ü ñ", "pump 🔧 ok", ""]
    rows = spark.createDataFrame([(x,) for x in texts], "a string").select("a", spaced_json(a=F.col("a"), b=F.lit("x")).alias("j"))
    for r in rows.collect():
        assert r.j == json.dumps({"a": r.a, "b": "x"}, sort_keys=True)


def test_producer_mode_goes_into_the_metadata(spark):
    r = spark.createDataFrame([("e", "t", "i")], "event_id string, event_time string, ingest_time string")
    (a,) = logs.restamp_times(r, "realtime_live", F.lit("now")).collect()
    assert (a.synthetic_metadata, a.event_time, a.ingest_time) == ({"producer_mode": "realtime_live"}, "now", "now")
    own = r.withColumn("synthetic_metadata", F.struct(F.lit(1).alias("seed"), F.lit("old").alias("producer_mode")))
    (a,) = logs.restamp_times(own, "backfill_replay", F.lit("now")).collect()
    assert a.synthetic_metadata.asDict() == {"seed": 1, "producer_mode": "backfill_replay"}


def test_a_late_reading_clears_the_gap_that_a_stream_has_reported(spark, tmp_path):
    every = readings(spark, [1.0] * 6, [0, 5, 25, 10, 15, 20])
    parts = [every.filter(F.col("event_id").isin("e00000", "e00005", "e00025")), every.filter(F.col("event_id").isin("e00010", "e00015", "e00020"))]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
        w = jobs.detect_batches(s, detectors.heartbeat_verdict, str(tmp_path / "out"), str(tmp_path / "hist"), str(tmp_path / "cp"))
        jobs.run_available(w)
        want = detectors.window_anomalies(detectors.detector_features(spark.read.parquet(str(tmp_path / "in"))), detectors.heartbeat_verdict())
        got = jobs.current_anomalies(spark, str(tmp_path / "out"))
        assert sorted(r.anomaly_id for r in got.collect()) == sorted(r.anomaly_id for r in want.collect())
    assert want.count() == 0
