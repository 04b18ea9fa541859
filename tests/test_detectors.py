"""Detector boundaries with hand-computed expectations, and independence of splitting and order."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plantpulse.operators import detectors as d
from plantpulse.operators.series import with_halo
from plantpulse.plans.reports import replay_diff

START = datetime(2024, 1, 1)
SCHEMA = (
    "tenant_id string, asset_id string, tag_id string, metric_name string, event_id string, event_time timestamp_ntz, "
    "value double, quality_flags array<string>, plant_id string, asset_name string, component_id string, tag_name string"
)


def series(spark, values, tag="tag_1", minutes=5, flags=()):
    times = [START + timedelta(minutes=minutes * i) for i in range(len(values))]
    return rows(spark, list(zip(times, values, strict=True)), tag, flags)


def rows(spark, points, tag="tag_1", flags=()):
    data = [
        ("tenant_a", "asset_1", tag, "temperature", f"e{i:05d}", t, float(v), list(flags), "p", "Asset 1", "c", "n")
        for i, (t, v) in enumerate(points)
    ]
    return spark.createDataFrame(data, SCHEMA)


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


def test_spike_needs_two_and_reaches_the_limit(spark):
    assert d.detect_spike(series(spark, [100])).count() == 0
    a = one(d.detect_spike(series(spark, [10, 10, 25])))  # exactly 2.5 x the mean
    assert (a.observed_value, a.baseline_value, a.expected_value, a.severity) == (25.0, 10.0, 25.0, "critical")
    assert d.detect_spike(series(spark, [10, 10, 24.99])).count() == 0


def test_spike_bounds_come_first_and_lower_wins(spark):
    bounds = spark.createDataFrame([("tenant_a", "tag_1", 20.0, 50.0)], "tenant_id string, tag_id string, upper double, lower double")
    assert one(d.detect_spike(series(spark, [10, 10, 30]), bounds=bounds)).expected_value == 50.0


def test_zscore_three_points_are_too_few_and_constant_baseline_never_fires(spark):
    assert d.detect_zscore(series(spark, [1, 2, 100])).count() == 0
    assert d.detect_zscore(series(spark, [0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 100])).count() == 0
    a = one(d.detect_zscore(series(spark, [1, 3, 1, 3, 5])))  # mean 2, deviation 1, z = 3
    assert (a.baseline_value, a.expected_value, a.detection_confidence) == (2.0, 5.0, 0.5)


def test_zscore_near_constant_baseline_is_not_taken_for_constant(spark):
    # same extremes and sum as a constant series would need, but not all equal
    assert d.detect_zscore(series(spark, [5, 4, 6, 5, 4, 6, 50])).count() == 1


def test_zscore_sees_past_a_huge_outlier(spark):
    base = [10.0 + 0.01 * (i % 7) for i in range(60)]
    a = one(d.detect_zscore(series(spark, [*base, 1e5])))
    mean = sum(base) / 60
    sd = (sum((v - mean) ** 2 for v in base) / 60) ** 0.5
    assert a.baseline_value == pytest.approx(mean, abs=1e-6)
    assert a.expected_value == pytest.approx(mean + 3 * sd, abs=1e-3)


def test_drift_keeps_slope_as_observation(spark):
    a = one(d.detect_drift(series(spark, [10, 9, 8.5]), 0.75))  # slope -0.75, the limit itself
    assert (a.observed_value, a.baseline_value, a.expected_value, a.breach_count) == (-0.75, 10.0, 0.75, 2)
    assert d.detect_drift(series(spark, [10, 9])).count() == 0


def test_gap_of_exactly_ten_minutes_counts_and_the_first_one_is_reported(spark):
    t = [START, START + timedelta(minutes=9), START + timedelta(minutes=19), START + timedelta(minutes=60)]
    r = rows(spark, [(x, i) for i, x in enumerate(t)])
    a = one(d.detect_heartbeat_gap(r))
    assert (a.observed_value, a.window_start, a.window_end) == (10.0, t[1], t[2])
    assert a.source_event_ids == ["e00001", "e00002"]
    assert d.detect_heartbeat_gap(r, all_gaps=True).count() == 2
    close = rows(spark, [(START, 1), (START + timedelta(minutes=9, seconds=59, microseconds=999999), 1)])
    assert d.detect_heartbeat_gap(close).count() == 0


def test_flatline_needs_six_equal_values_at_the_end(spark):
    a = one(d.detect_flatline(series(spark, [1, 2, 7, 7, 7, 7, 7, 7])))
    assert (a.fault_type, a.event_count, a.expected_value) == ("sensor_fault", 6, None)
    assert d.detect_flatline(series(spark, [7] * 5)).count() == 0
    assert d.detect_flatline(series(spark, [7, 7, 7, 7, 7, 7, 1])).count() == 0


def test_ids_follow_the_public_hash(spark):
    import hashlib

    a = one(d.detect_spike(series(spark, [10, 10, 25])))
    key = "threshold_spike|tenant_a|asset_1|tag_1|temperature|2024-01-01T00:00:00Z|2024-01-01T00:10:00Z"
    assert a.anomaly_id == "anom_" + hashlib.sha256(key.encode()).hexdigest()[:16]


def test_window_spike_takes_a_zero_mean_for_missing(spark):
    f = d.detector_features(series(spark, [0, 0, 0]))
    assert d.window_anomalies(f, d.spike_verdict()).count() == 3  # every value reaches 0 x 2.5


def test_sensor_flags_any_case(spark):
    a = one(d.detect_spike(series(spark, [10, 10, 25], flags=["Dead_Sensor"])))
    assert a.fault_type == "sensor_fault"


def busy(spark, n=400):
    """One series with most rows, in bursts, and a few short ones."""
    points = [(START + timedelta(seconds=37 * i + (600 if i % 50 > 25 else 0)), (i * 7919) % 101) for i in range(n)]
    out = rows(spark, points, "tag_busy").withColumn("event_id", F.concat(F.lit("b"), "event_id"))
    for k in range(3):
        out = out.unionByName(
            series(spark, range(5), f"tag_{k}").withColumn("event_id", F.concat(F.lit(f"s{k}"), "event_id"))
        )
    return out


@pytest.mark.parametrize("target", [5, 40, 150])
def test_chunked_features_equal_unchunked(spark, target):
    whole = d.detector_features(busy(spark), target_rows=10_000)
    split = d.detector_features(busy(spark).repartition(5), target_rows=target)
    show = lambda f: f.select(
        "event_id", "prev_window_value", "gap_minutes", "event_count", "window_start", "source_event_ids",
        F.round("rolling_baseline_mean", 9).alias("m"), F.round("rolling_baseline_stddev", 6).alias("s"),
    )
    assert replay_diff(show(whole), show(split)).count() == 0


def test_busy_series_is_really_split(spark):
    chunks = with_halo(busy(spark), 24, target_rows=40).filter("tag_id = 'tag_busy'")
    sizes = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 200


def test_order_and_partitions_do_not_matter(spark):
    r = busy(spark)
    a, b = d.detect_all(r), d.detect_all(r.orderBy(F.rand(7)).repartition(7))
    drop = "quality_event_ids"
    assert replay_diff(a.drop(drop), b.drop(drop)).count() == 0
