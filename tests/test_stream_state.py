"""Keyed detector state: equal to the batch features, silences by timer, bounded state."""

from __future__ import annotations

import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import detectors as d
from plantpulse.plans.reports import replay_diff
from plantpulse.streaming import jobs, state

START = datetime(2024, 1, 1)
SCHEMA = (
    "tenant_id string, asset_id string, tag_id string, metric_name string, event_id string, event_time timestamp_ntz, "
    "value double, quality_flags array<string>, plant_id string, asset_name string, component_id string, tag_name string"
)


def reading(tag, minutes, value, name=None):
    at = START + timedelta(minutes=minutes)
    return ("t", "a", tag, "temperature", name or f"{tag}-{minutes:09.3f}", at, value, ["Dead_Sensor"] if minutes % 7 == 0 else None, "p", "A", "c", "n")


def run(spark, batches, folder, build):
    """One file per micro-batch through ``build`` of the feature stream; returns what was written and the last progress."""
    for k, rows in enumerate(batches):
        out = f"{folder}/in/part{k}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(out)
        for f in os.listdir(out):
            os.utime(f"{out}/{f}", (time.time() - 1000 + k,) * 2)
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = jobs.run_available(jobs.append_files(build(s), f"{folder}/out", f"{folder}/cp"))
    return spark.read.parquet(f"{folder}/out"), q.recentProgress


def dealt(rows, parts):
    """Rows in arrival order with every 5th one a batch late, and a far reading of another series that moves the watermark on."""
    size = -(-len(rows) // parts)
    out = [rows[k * size : (k + 1) * size] for k in range(parts)]
    for k in range(parts - 1):
        out[k + 1] = out[k][-1:] + out[k + 1]  # the last one of a batch arrives after the first of the next
        out[k] = out[k][:-1]
    return out


def test_features_and_verdicts_equal_the_batch_form(spark, tmp_path):
    rows = []
    for tag in ("x", "y", None):
        rows += [reading(tag, 2 * i + (30 if i > 25 else 0), 20.0 + (i * 7919 % 11) * 0.25 if i != 40 else 90.0, f"{tag}{i:03d}") for i in range(60)]
    rows += [reading("flat", 2 * i, 5.0) for i in range(20)] + [reading("holes", 3 * i, None if i % 4 == 0 else float(i)) for i in range(20)]
    rows.sort(key=lambda r: (r[5], r[4]))
    r = spark.createDataFrame(rows, SCHEMA)
    far = [reading("far", 10_000, 1.0)]
    got, progress = run(spark, [*dealt(rows, 6), far, [reading("far", 10_001, 1.0)]], str(tmp_path), state.feature_stream)
    assert got.count() > 0 and sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"]) == 0
    mine, want = got.filter("NOT silent AND tag_id IS DISTINCT FROM 'far'"), d.detector_features(r)
    rounded = {c: F.round(c, 9) for c in ("rolling_baseline_mean", "rolling_baseline_stddev", "window_stddev", "gap_minutes")}
    assert replay_diff(mine.drop("silent").withColumns(rounded).select(*want.columns), want.withColumns(rounded)).count() == 0
    for verdict in (d.spike_verdict(), d.zscore_verdict(), d.drift_verdict(), d.heartbeat_verdict(), d.flatline_verdict()):
        a, b = state.anomaly_stream(got.filter("tag_id IS DISTINCT FROM 'far'"), verdict), d.window_anomalies(want, verdict)
        assert replay_diff(a.drop("quality_event_ids"), b.drop("quality_event_ids")).count() == 0
    # far's one reading is all that waits; per series the last 24 judged, per key one timer (two entries)
    kept = progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert kept <= 6 * (d.BASELINE_POINTS + 4)


def test_a_silent_series_is_told_when_the_timer_fires_and_once(spark, tmp_path):
    quiet = [reading("quiet", m, 1.0) for m in (0, 5, 10)]
    other = lambda a, b: [reading("busy", float(m), 1.0) for m in range(a, b)]
    batches = [[*quiet, *other(0, 12)], other(12, 26), other(26, 40), [reading("quiet", 60, 1.0), *other(40, 70)], other(70, 90), other(90, 91)]
    got, _ = run(spark, batches[:4], str(tmp_path / "a"), lambda s: state.silence_stream(state.feature_stream(s)))
    told = got.filter("tag_id = 'quiet'").collect()
    # the reading at minute 60 has not been judged yet: its watermark comes later
    assert [(r.window_start, r.window_end, r.observed_value, r.severity) for r in told] == [
        (START + timedelta(minutes=10), START + timedelta(minutes=20), 10.0, "critical")
    ]
    got, _ = run(spark, batches, str(tmp_path / "b"), state.feature_stream)
    quiet_rows = got.filter("tag_id = 'quiet'")
    assert [r.window_start for r in quiet_rows.filter("silent").orderBy("window_start").collect()] == [
        START + timedelta(minutes=10), START + timedelta(minutes=60)
    ]
    back = quiet_rows.filter("NOT silent AND gap_minutes >= 10").collect()
    assert [(r.gap_minutes, r.event_time) for r in back] == [(50.0, START + timedelta(minutes=60))]


@pytest.mark.parametrize(("pause", "told"), [(9.999, 0), (10.0, 1)])
def test_a_pause_of_exactly_the_limit_is_told(spark, tmp_path, pause, told):
    batches = [[reading("x", 0, 1.0), reading("x", pause, 1.0)], [reading("far", 16, 1.0)], [reading("far", 17, 1.0)]]
    got, _ = run(spark, batches, str(tmp_path), state.feature_stream)
    assert got.filter("silent AND tag_id = 'x'").count() == told


def test_a_late_reading_within_the_delay_takes_its_place(spark, tmp_path):
    batches = [[reading("x", m, float(m)) for m in (0, 1, 2, 4)], [reading("x", 3, 100.0)], [reading("x", 20, 5.0)], [reading("x", 40, 5.0)]]
    got, _ = run(spark, batches, str(tmp_path), state.feature_stream)
    order = [r.observed_value for r in got.filter("NOT silent").orderBy("event_time").collect()]
    assert order == [0.0, 1.0, 2.0, 100.0, 4.0, 5.0]
    assert got.filter("observed_value = 4 AND NOT silent").first().prev_window_value == 100.0
