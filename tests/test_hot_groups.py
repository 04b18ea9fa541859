"""One group holding all rows: equal to brute force, and no task, window or buffer holds the group."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plantpulse.functions.joins import join_same
from plantpulse.operators import detectors, late, series, windows

START = datetime(2024, 1, 1)


def test_late_by_watermark_of_one_tenant_and_one_ingest_time(spark):
    rng = np.random.default_rng(2)
    minutes = rng.permutation(4000) * 0.25 + rng.integers(0, 120, 4000)
    rows = [(f"e{i:05d}", None if i % 3 else "t", "tag", START + timedelta(minutes=float(m)), START) for i, m in enumerate(minutes)]
    df = spark.createDataFrame(rows, "event_id string, tenant_id string, tag_id string, event_time timestamp_ntz, ingest_time timestamp_ntz")
    want = set()
    for tenant in ("t", None):
        top = None
        for event_id, who, _, at, _ in rows:
            if who == tenant:
                if top is not None and at < top - timedelta(minutes=15):
                    want.add((event_id, top - timedelta(minutes=5)))
                top = at if top is None else max(top, at)
    got = late.late_by_watermark(df.repartition(7), target_rows=100)
    assert {(r.event_id, r.watermark_time) for r in got.collect()} == want and len(want) > 100
    ranged = series.with_ranges(df, ["tenant_id"], ["ingest_time", "event_id"], 100, ranges=64)
    sizes = [r["count"] for r in ranged.groupBy("tenant_id", "_range").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 600
    assert {(r.event_id, r.watermark_time) for r in late.late_by_watermark(df).collect()} == want


@pytest.mark.parametrize("ranges", [1, 2, 9, 100])
def test_ranges_follow_the_order_and_equal_rows_share_one(spark, ranges):
    rng = np.random.default_rng(ranges)
    rows = [(None if x % 11 == 0 else int(x % 5), float(x) if x % 7 else None) for x in rng.integers(0, 300, 2000).tolist()]
    df = spark.createDataFrame(rows, "a int, b double")
    got = [(r.a, r.b, r._range) for r in series.with_ranges(df, ["a"], ["b"], 0, ranges).orderBy("a", "b").collect()]
    assert [x[2] for x in got] == sorted(x[2] for x in got) and len(got) == 2000
    assert len({x[2] for x in got}) <= ranges + 1 and len({x[:2] for x in got}) == len({x for x in got})
    assert series.with_ranges(df.limit(0), ["a"], ["b"], 0, ranges).count() == 0


@pytest.mark.parametrize("percent", [1, 50, 95, 100])
def test_nearest_rank_equals_sorting(spark, percent):
    rng = np.random.default_rng(percent)
    rows = [("hot", float(v)) for v in rng.lognormal(3, 2, 50_000)] + [(None, float(v % 3)) for v in range(100)] + [("one", 5.0), ("nothing", None), ("some", None), ("some", 2.0)]
    df = spark.createDataFrame(rows, "tag string, value double").repartition(6)
    want = {}
    for tag in {t for t, _ in rows}:
        values = sorted(v for t, v in rows if t == tag and v is not None)
        if values:
            want[tag] = values[-(-len(values) * percent // 100) - 1]
    for target in (0, 1000, 10**6):
        assert {r.tag: r.p for r in series.nearest_rank(df, ["tag"], "value", percent, "p", target).collect()} == want
    ranged = series.with_ranges(df, ["tag"], ["value"], 1000).groupBy("tag", "_range").count()
    assert ranged.agg(F.max("count")).first()[0] < 1000


def test_window_stats_of_a_tag_day_with_all_values_different(spark):
    n = 20_000
    values = np.random.default_rng(4).permutation(n) / 7
    df = spark.range(n, numPartitions=8).select(
        F.lit("t").alias("tenant_id"), F.lit("x").alias("tag_id"), F.lit("a").alias("asset_id"), F.format_string("e%07d", "id").alias("event_id"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 4)).alias("event_time"),
        F.lit(None).cast("array<string>").alias("quality_flags"), ((F.col("id") * 7919 % n) / 7.0).alias("value"),
    )
    r = windows.window_stats(df, "1 day", target_rows=1000).collect()
    assert len(r) == 1 and r[0].event_count == n and r == windows.window_stats(df, "1 day").collect()
    assert r[0].p95_value == round(float(np.sort(values)[-(-n * 95 // 100) - 1]), 3)


SCHEMA = (
    "tenant_id string, asset_id string, tag_id string, metric_name string, event_id string, event_time timestamp_ntz, "
    "value double, quality_flags array<string>, plant_id string, asset_name string, component_id string, tag_name string"
)


def readings(spark, values, metric="temperature", tag="x", seconds=600, name="e"):
    rows = [("t", "a", tag, metric, f"{name}{i:05d}", START + timedelta(seconds=seconds * i), v, [], "p", "A", "c", "n") for i, v in enumerate(values)]
    return spark.createDataFrame(rows, SCHEMA)


def test_series_with_null_keys_have_baselines_and_verdicts(spark):
    base = [10.0 + 0.5 * (i % 3) for i in range(20)]
    df = readings(spark, [*base, 60.0], metric=None).unionByName(readings(spark, [*base, 60.0], tag=None, name="f"))
    got = detectors.series_summary(df).collect()
    assert len(got) == 2 and all(r.base_mean == pytest.approx(np.mean(base)) and r.base_stddev == pytest.approx(np.std(base)) for r in got)
    assert all(len(r.source_event_ids) == 10 and r.source_event_ids[0].endswith("00000") for r in got)
    rules = sorted(r.rule_id for r in detectors.detect_all(df).collect())
    assert rules.count("rolling_zscore") == rules.count("threshold_spike") == rules.count("drift_rate_of_change") == 2


@pytest.mark.parametrize("top", [1e5, 1e9, 1e15])
@pytest.mark.parametrize("cell", ["10 minutes", "1 hour", "30 days"])
def test_moments_of_many_cells_equal_those_of_all_values(spark, top, cell):
    base = [1000.0 + 1e-3 * (i * 7919 % 13) for i in range(200)]
    r = detectors.series_summary(readings(spark, [*base, top]), cell).first()
    assert r.base_mean == pytest.approx(np.mean(base), rel=1e-14) and r.base_stddev == pytest.approx(np.std(base), rel=1e-8)
    assert (r.event_count, r.first_value, r.last_value) == (201, 1000.0, top)
    still = detectors.series_summary(readings(spark, [0.1] * 50 + [top]), cell).first()
    assert still.base_stddev == 0.0


def test_only_one_of_several_last_readings_leaves_the_baseline(spark):
    df = readings(spark, [1.0, 2.0, 3.0])
    last = df.filter("event_id = 'e00002'")
    r = detectors.series_summary(df.unionByName(last)).first()
    assert (r.event_count, r.base_mean) == (4, 2.0)  # 1, 2 and one of the two last ones
    none = detectors.series_summary(readings(spark, [None, None, 5.0])).first()
    assert (none.event_count, none.base_mean, none.base_stddev) == (1, None, None)


def test_all_detectors_read_the_input_three_times(spark, tmp_path):
    path = str(tmp_path / "r")
    readings(spark, [1.0] * 5).write.parquet(path)
    plan = detectors.detect_all(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet", plan)) <= 4


def test_null_keys_meet_in_join_same(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    rows = lambda how: sorted(map(tuple, join_same(a, b, ["k"], how).collect()), key=repr)
    assert rows("inner") == sorted([("x", 2, 20), (None, 1, 10)], key=repr)
    assert rows("left") == sorted([("x", 2, 20), (None, 1, 10), ("y", 3, None)], key=repr)
