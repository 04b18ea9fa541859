"""Streams with several outputs, incidents by session window, and the state each leaves."""

from __future__ import annotations

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.functions.times import parse_iso
from plantpulse.operators import dead_letter, enrich, health, incidents, late
from plantpulse.plans.reports import replay_diff
from plantpulse.sources import testtables as t
from plantpulse.sources.logs import parse_json
from plantpulse.streaming import jobs

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def files(batches, path):
    """One file per micro-batch, in order."""
    for k, df in enumerate(batches):
        out = f"{path}/part{k}"
        df.coalesce(1).write.parquet(out)
        for f in os.listdir(out):
            os.utime(f"{out}/{f}", (time.time() - 1000 + k,) * 2)


def source(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_one_pass_gives_all_outputs_equal_to_the_batch_forms(spark, tmp_path):
    lines = t.raw_json(spark, SF).select("value")
    n = lines.count()
    files([lines.filter(F.pmod(F.xxhash64("value"), F.lit(3)) == k) for k in range(3)], str(tmp_path / "in"))
    dims = lambda: (t.tags(spark, SF), t.assets(spark, SF), t.components(spark, SF))
    path = str(tmp_path / "out")
    q = jobs.run_available(jobs.ingest_batches(source(spark, "value string", str(tmp_path / "in")), dims, path, str(tmp_path / "cp")))
    # the source is read once per batch, whatever the number of outputs
    assert sum(p["numInputRows"] for p in q.recentProgress) == n
    out = {name: spark.read.parquet(f"{path}/{name}").drop("batch_id") for name in jobs.OUTPUTS}

    parsed = parse_json(lines)
    dead = dead_letter.missing_required(parsed)
    fine = parsed.filter(dead_letter.complete()).withColumns({c: parse_iso(c) for c in ("event_time", "ingest_time")})
    enriched = enrich.enrich_readings(fine, *dims())
    assert dead.count() > 0 and enriched.count() > 0
    assert replay_diff(out["dead_letters"].drop("validation_time", "tenant_id", "at"), dead.drop("validation_time")).count() == 0
    assert replay_diff(out["readings"], enriched).count() == 0
    assert replay_diff(out["late"], late.late_by_ingest_lag(enriched)).count() == 0
    times = parsed.filter(~dead_letter.complete()).select("tenant_id", parse_iso("event_time").alias("event_time"))
    gaps = enriched.limit(20).select("tenant_id", F.col("event_time").alias("window_end"))
    for some in (None, gaps):
        want = health.health_snapshot(enriched, times, some)
        assert replay_diff(jobs.current_health(spark, path, some), want).count() == 0 and len(want.columns) == 10
    m = out["metrics"].agg(F.sum("dead_count"), F.sum("complete_count"), F.max("max_lag_seconds"), F.sum("late_count")).first()
    lag = fine.agg(F.max(F.expr("timestampdiff(MICROSECOND, event_time, ingest_time) / 1e6"))).first()[0]
    assert (m[0], m[1], m[2]) == (dead.count(), fine.count(), lag) and m[3] > 0


def test_a_repeated_batch_leaves_one_copy_of_every_output(spark, tmp_path):
    lines = t.raw_json(spark, SF).select("value").limit(50)
    files([lines], str(tmp_path / "in"))
    dims = lambda: (t.tags(spark, SF), t.assets(spark, SF), t.components(spark, SF))
    path, counts = str(tmp_path / "out"), []
    for k in range(2):  # a new checkpoint takes batch 0 again
        jobs.run_available(jobs.ingest_batches(source(spark, "value string", str(tmp_path / "in")), dims, path, str(tmp_path / f"cp{k}")))
        counts.append({name: spark.read.parquet(f"{path}/{name}").count() for name in jobs.OUTPUTS})
    assert counts[0] == counts[1]


def test_health_of_three_streams_has_the_columns_and_rows_of_the_batch_form(spark, tmp_path):
    r = t.readings(spark, SF).select("tenant_id", F.col("event_time").cast("timestamp"), F.col("ingest_time").cast("timestamp"))
    some = r.filter(F.second("event_time") % 7 == 0)
    dead, gaps = some.select("tenant_id", "event_time"), some.select("tenant_id", F.col("event_time").alias("window_end"))
    streams = []
    for name, df, at in (("r", r, "event_time"), ("d", dead, "event_time"), ("g", gaps, "window_end")):
        df.coalesce(1).write.parquet(str(tmp_path / name / "part0"))
        far = df.limit(1).withColumn(at, F.lit("2030-01-01").cast("timestamp"))
        far.coalesce(1).write.parquet(str(tmp_path / name / "part1"))
        streams.append(source(spark, df.schema, str(tmp_path / name)).withWatermark(at, "5 minutes"))
    out = jobs.health_stream(*streams)
    jobs.run_available(jobs.append_files(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    want = health.health_snapshot(r, dead, gaps)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == want.columns
    assert replay_diff(got.filter("observed_at < '2029-01-01'"), want).count() == 0 and want.count() > 50


KINDS = "tenant_id string, asset_id string, metric_name string, rule_id string, anomaly_id string, severity string, window_start timestamp_ntz, window_end timestamp_ntz"


def anomalies(spark, points):
    rows = [(*key, f"{key[1]}-{s:05d}", sev, START + timedelta(seconds=s), None) for key, s, sev in points]
    return spark.createDataFrame(rows, KINDS)


def keyed(asset):
    return ("t", asset, "temperature", "r")


@pytest.mark.parametrize(("gap", "number"), [(599, 1), (600, 1), (601, 2)])
def test_streamed_incidents_break_where_the_batch_form_does(spark, tmp_path, gap, number):
    points = [(keyed("x"), 0, "warning"), (keyed("x"), gap, "critical"), (keyed("y"), 5, None), (keyed("y"), 300, "odd")]
    far = [(keyed("far"), 100_000, "info")]
    # the later of x first: order inside the delay does not matter
    batches = [points[1:2] + points[2:3], points[:1] + points[3:], far, [(keyed("far"), 100_001, "info")]]
    files([anomalies(spark, b) for b in batches], str(tmp_path / "in"))
    delay = "30 minutes"
    stream = jobs.incident_stream(source(spark, KINDS, str(tmp_path / "in")), delay=delay)
    q = jobs.run_available(jobs.append_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = incidents.incidents(anomalies(spark, points))
    assert got.filter("asset_id = 'x'").count() == number
    assert replay_diff(got.select(*want.columns), want).count() == 0
    # closed incidents have left the state
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_a_late_anomaly_opens_nothing_and_is_told(spark, tmp_path):
    first = [(keyed("x"), 0, "warning"), (keyed("x"), 60, "warning")]
    batches = [first, [(keyed("far"), 100_000, "info")], [(keyed("far"), 100_001, "info")], [(keyed("x"), 30, "critical"), (keyed("x"), 200, "info"), (keyed("z"), 1, "info")], [(keyed("far"), 100_002, "info")]]
    files([anomalies(spark, b) for b in batches], str(tmp_path / "in"))
    stream = jobs.incident_stream(source(spark, KINDS, str(tmp_path / "in")))
    q = jobs.run_available(jobs.append_files(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert [(r.asset_id, r.anomaly_count, r.max_severity) for r in got.collect()] == [("x", 2, "warning")]
    assert sum(int(p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in q.recentProgress) == 3
    landed = spark.read.schema(KINDS).parquet(str(tmp_path / "in/*"))
    missed = incidents.missed_anomalies(landed, got, F.lit(START + timedelta(hours=2)).cast("timestamp_ntz"))
    assert sorted((r.asset_id, r.incident_id is None, r.missed_count) for r in missed.collect()) == [("x", False, 1), ("x", True, 1), ("z", True, 1)]


def test_placed_anomalies_find_their_incident(spark):
    points = [(keyed("x"), s, "info") for s in (0, 300, 900, 1500, 4000, 4100)]
    df = anomalies(spark, points)
    placed = incidents.placed_anomalies(df, incidents.incidents(df))
    assert placed.filter("incident_id IS NULL").count() == 0
    assert sorted(r["count"] for r in placed.groupBy("incident_id").count().collect()) == [2, 4]
    members = incidents.incident_members(df).select("incident_id", "anomaly_id")
    assert replay_diff(placed.select("incident_id", "anomaly_id"), members).count() == 0
