"""Rows with missing keys are kept, rejected with a reason, or matched to nothing; none vanishes or ends the job."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from plantpulse.operators import contracts, enrich, quality
from plantpulse.sources import logs


def test_records_without_a_tenant_are_rejected_and_the_others_give_events(spark):
    rows = [("t", ["late_arrival"]), ("", ["flatline"]), (None, ["flatline"]), ("t", [])]
    df = spark.createDataFrame(rows, "tenant_id string, quality_flags array<string>").withColumns(
        {"asset_id": F.lit("a"), "tag_id": F.lit("x"), "event_time": F.lit("2024-01-01").cast("timestamp_ntz")}
    )
    assert quality.quality_from_flags(df).count() == 1
    assert [r.error_code for r in quality.without_tenant(df).collect()] == ["missing_tenant_id"] * 2
    late = df.withColumns({"watermark_time": F.col("event_time"), "reason": F.lit("r"), "event_id": F.lit("e"), "lateness_minutes": F.lit(1.0)})
    assert quality.quality_from_late(late).count() == 2


def test_a_mapping_without_a_tenant_belongs_to_nobody(spark):
    tags = spark.createDataFrame([(None, "x", "bar"), ("t", "y", "bar"), (None, "y", "kw")], "tenant_id string, tag_id string, unit string")
    readings = spark.createDataFrame([("t", "x", "bar"), ("", "x", "bar"), (None, "x", "bar"), ("t", "y", "bar"), ("t", "z", "bar")], "tenant_id string, tag_id string, unit string")
    got = [(r.tenant_id, r.tag_id, r.error_code) for r in enrich.check_mapping(readings, tags).collect()]
    wrong = "invalid_asset_tag_mapping"
    assert set(got) == {("t", "x", wrong), ("", "x", wrong), (None, "x", wrong), ("t", "y", None), ("t", "z", "missing_tag_metadata")}


def test_payload_of_a_dead_letter_is_a_valid_record(spark):
    lines = ['{"event_id": "e", "tenant_id": "tenant_a", "tag_id": "tag_1", "x\\u00e9": "a\\"b"}', "[1]", "{broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    checked = contracts.contract_errors(df).withColumns({c: F.get_json_object("value", f"$.{c}") for c in ("tenant_id", "tag_id")})
    sent = logs.with_payload(logs.route_records(checked, spark.createDataFrame([("tenant_a",)], "tenant_id string")))
    records = {r.value: json.loads(r.payload) for r in sent.collect()}
    assert all(list(x) == sorted(x) and x["error_code"] == "schema_validation_error" for x in records.values())
    assert [records[x]["original_record"] for x in lines] == [json.loads(lines[0]), None, None]
    judged = contracts.contract_errors(sent.select(F.col("payload").alias("value")), contracts.DEAD_LETTER)
    assert judged.filter(F.size("errors") > 0).count() == 0
