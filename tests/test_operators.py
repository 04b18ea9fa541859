"""Incidents, windows, contracts, responses, sinks: small cases with known answers."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import context, contracts, incidents, late, quality, recommend, windows
from plantpulse.sources import logs

START = datetime(2024, 1, 1)


def anomalies(spark, points, key=("tenant_a", "asset_1", "temperature", "r1")):
    data = [(*key, f"a{i:02d}", sev, START + timedelta(minutes=m)) for i, (m, sev) in enumerate(points)]
    df = spark.createDataFrame(
        data,
        "tenant_id string, asset_id string, metric_name string, rule_id string, anomaly_id string, severity string, "
        "window_start timestamp_ntz",
    )
    return df.withColumn("window_end", F.col("window_start"))


def test_cooldown_is_inclusive_and_extends(spark):
    a = anomalies(spark, [(0, "info"), (10, "critical"), (20, "warning"), (30.02, "info")])
    got = sorted(incidents.incidents(a).collect(), key=lambda r: r.first_seen_at)
    assert [r.anomaly_count for r in got] == [3, 1]
    assert (got[0].max_severity, got[0].routing_channel) == ("critical", "teams_card")
    assert (got[0].primary_anomaly_id, got[0].last_seen_at) == ("a00", START + timedelta(minutes=20))


def test_incident_id_comes_from_the_first_bucket(spark):
    import hashlib

    a = anomalies(spark, [(7, "info"), (12, "info")])
    r = incidents.incidents(a).collect()[0]
    key = "tenant_a|asset_1|temperature|r1|2024-01-01T00:05:00Z"
    assert r.correlation_key == key and r.incident_id == "inc_" + hashlib.sha1(key.encode()).hexdigest()[:16]


def test_unknown_severity_goes_to_the_dashboard(spark):
    r = incidents.incidents(anomalies(spark, [(0, "odd")])).collect()[0]
    assert (r.max_severity, r.routing_channel) == ("odd", "dashboard_only")


def test_members_keep_order_and_pages_are_whole(spark):
    a = anomalies(spark, [(i * 3, "info") for i in range(25)])
    pages = incidents.incident_id_pages(incidents.incident_members(a), 10).orderBy("page").collect()
    assert [len(p.source_anomaly_ids) for p in pages] == [10, 10, 5]
    assert [x for p in pages for x in p.source_anomaly_ids] == [f"a{i:02d}" for i in range(25)]


def test_window_statistics(spark):
    values = [float(v) for v in range(20)]
    data = [("t", "tag", "as", f"e{i:02d}", START + timedelta(seconds=40 * i), v, ["b", "a"]) for i, v in enumerate(values)]
    df = spark.createDataFrame(
        data, "tenant_id string, tag_id string, asset_id string, event_id string, event_time timestamp_ntz, value double, "
        "quality_flags array<string>",
    )
    r = windows.window_stats(df).collect()[0]
    assert (r.p95_value, r.slope, r.event_count, r.expected_count) == (18.0, 1.0, 20, 15)
    assert (r.avg_value, r.quality_flags, r.window_end) == (9.5, ["a", "b"], START + timedelta(minutes=15))
    assert r.stddev_value == pytest.approx(5.766281) and r.z_score == pytest.approx(1.647509)


GOOD = (
    '{"event_id":"e","schema_version":"raw_sensor_event.v1","tenant_id":"tenant_a","tag_id":"tag_1","tag_name":"n",'
    '"event_time":"2024-01-01T00:00:00Z","ingest_time":"2024-01-01T00:00:00Z","value":1,"unit":"bar",'
    '"source_system":"scada","quality_flags":[]%s}'
)


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        (GOOD % "", []),
        ("{nope", [("/", "invalid_json", "Invalid JSON")]),
        ("[1]", [("/", "invalid_json", "JSONL record must be an object")]),
        (GOOD.replace('"value":1', '"value":"1"') % "", [("/value", "invalid_type", "'1' is not of type 'number'")]),
        (GOOD.replace('"value":1', '"value":null') % "", [("/value", "invalid_type", None)]),
        (GOOD.replace('[]', '["x",3,"x"]') % "", [
            ("/quality_flags", "schema_validation_error", None),
            ("/quality_flags/1", "invalid_type", "3 is not of type 'string'"),
        ]),
        (GOOD % ',"b":1,"a":2', [("/", "unexpected_field", "Additional properties are not allowed ('a', 'b' were unexpected)")]),
        (GOOD % ',"synthetic_metadata":{"scenario":"zzz","other":1}', [("/synthetic_metadata/scenario", "invalid_value", None)]),
        (GOOD.replace('"tag_name":"n",', "").replace('"unit":"bar",', "") % "", [
            ("/tag_name", "missing_required_field", "'tag_name' is a required property"),
            ("/tag_name", "missing_required_field", "'unit' is a required property"),
        ]),
    ],
)
def test_contract(spark, line, expected):
    df = spark.createDataFrame([(line,)], "value string")
    errors = contracts.contract_errors(df).collect()[0].errors
    assert [(e.field_path, e.error_code) for e in errors] == [(p, c) for p, c, _ in expected]
    for e, (_, _, message) in zip(errors, expected, strict=True):
        assert message is None or e.message == message


def test_fences(spark):
    cases = {"```json\n{\"a\": 1}\n```": True, "```{\"a\":1}```": False, " {\"a\":1} \n": True, "[1]": False, "```\n{\"a\":1}": True}
    df = spark.createDataFrame([(k,) for k in cases], "content string")
    got = {r.content: r.parsed_status == "parsed_json" for r in recommend.parse_responses(df).collect()}
    assert got == cases


def test_unknown_check_and_topic(spark):
    df = spark.createDataFrame([("t", START)], "tenant_id string, event_time timestamp_ntz")
    with pytest.raises(ValueError):
        quality.quality_rows(df, "nonsense", status="fail", severity="info", start=F.col("event_time"),
                             end=F.col("event_time"), evidence={"x": F.lit("y")})
    with pytest.raises(ValueError):
        logs.topic_for("nonsense", F.lit("t"))


def brute_late(events):
    out, top = set(), {}
    for e in sorted(events, key=lambda e: (e[3], e[0])):
        seen = top.get(e[1])
        if seen is not None and e[2] < seen - timedelta(minutes=15):
            out.add(e[0])
        top[e[1]] = e[2] if seen is None else max(seen, e[2])
    return out


def test_late_by_watermark_against_brute_force(spark):
    events = [
        (f"e{i:03d}", "t1" if i % 3 else "t2", START + timedelta(minutes=(i * 37) % 200), START + timedelta(seconds=i * 11))
        for i in range(200)
    ]
    df = spark.createDataFrame(events, "event_id string, tenant_id string, event_time timestamp_ntz, ingest_time timestamp_ntz")
    got = {r.event_id for r in late.late_by_watermark(df.withColumn("tag_id", F.lit("x"))).collect()}
    assert got == brute_late(events) and got


def test_signal_window_against_brute_force(spark):
    times = [START + timedelta(minutes=(i * i) % 97, seconds=i % 2) for i in range(80)]
    r = spark.createDataFrame(
        [("t", "g", "m", f"e{i:02d}", x) for i, x in enumerate(times)],
        "tenant_id string, tag_id string, metric_name string, event_id string, event_time timestamp_ntz",
    )
    bounds = [(START + timedelta(minutes=k * 9), START + timedelta(minutes=k * 9 + 4)) for k in range(9)]
    a = spark.createDataFrame(
        [(f"a{k}", "t", "g", "m", lo, hi) for k, (lo, hi) in enumerate(bounds)],
        "anomaly_id string, tenant_id string, tag_id string, metric_name string, window_start timestamp_ntz, "
        "window_end timestamp_ntz",
    )
    got = {x.anomaly_id: x.reading_count for x in context.anomaly_signal_window(a, r, "5 MINUTES", "5 MINUTES").collect()}
    m5 = timedelta(minutes=5)
    assert got == {f"a{k}": sum(lo - m5 <= x <= hi + m5 for x in times) for k, (lo, hi) in enumerate(bounds)}


def test_monthly_files_prune_and_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("t", START + timedelta(days=20 * i), float(i)) for i in range(6)], "tenant_id string, event_time timestamp_ntz, value double"
    )
    logs.write_by_month(df, str(tmp_path / "m"), "event_time")
    assert len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("month=")]) == 4
    assert logs.read_by_month(spark, str(tmp_path / "m"), "event_time", "2024-03-01").count() == 3
    (tmp_path / "in.jsonl").write_text('{"event_id":"a","value":"2.5"}\n\n{bad\n[1]\n')
    good, bad = logs.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert [(r.event_id, r.value) for r in good.collect()] == [("a", 2.5)]
    assert sorted(r.message for r in bad.collect()) == ["Invalid JSON", "JSONL record must be an object"]
