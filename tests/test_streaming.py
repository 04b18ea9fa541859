"""Streaming forms equal their batch forms on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantpulse.operators import detectors, enrich, late
from plantpulse.plans.reports import replay_diff
from plantpulse.sources import testtables as t
from plantpulse.streaming import jobs

SF = "/root/testdata/sf0.001"


def split_files(df, path, parts=4):
    """Rows in arrival order, in ``parts`` files that are read one per micro-batch."""
    import os
    import time

    rows = df.orderBy("ingest_time", "event_id")
    n = rows.count()
    numbered = rows.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF([*rows.columns, "_i"])
    base = time.time() - 1000
    for k in range(parts):
        out = f"{path}/part{k}"
        keep = numbered.filter((F.col("_i") >= k * n // parts) & (F.col("_i") < (k + 1) * n // parts)).drop("_i")
        keep.select(*[F.col(c).cast(df.schema[c].dataType) for c in df.columns]).coalesce(1).write.parquet(out)
        for f in os.listdir(out):
            if f.endswith(".parquet"):
                os.utime(f"{out}/{f}", (base + k, base + k))


def stream(spark, df, path):
    split_files(df, path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_late_by_watermark_stream_equals_batch(spark, tmp_path):
    r = t.readings(spark, SF).select("event_id", "tenant_id", "tag_id", "event_time", "ingest_time")
    # later ingestion for some readings, so that there is something late
    slow = F.when(F.crc32("event_id") % 5 == 0, F.col("ingest_time") + F.expr("INTERVAL 5 HOURS")).otherwise(F.col("ingest_time"))
    r = r.withColumn("ingest_time", slow)
    want = late.late_by_watermark(r)
    assert want.count() > 20
    s = stream(spark, r, str(tmp_path / "in"))
    w = jobs.late_batches(s, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"))
    jobs.run_available(w)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 4
    assert replay_diff(got.drop("batch_id"), want).count() == 0


def test_detector_stream_equals_batch(spark, tmp_path):
    keep = [*detectors.SERIES, *detectors.ORDER, "ingest_time", "value", "quality_flags", *detectors._PASSENGERS]
    r = t.measured(spark, SF).select(*keep)
    verdict = detectors.heartbeat_verdict
    want = detectors.window_anomalies(detectors.detector_features(r), verdict())
    s = stream(spark, r, str(tmp_path / "in"))
    w = jobs.detect_batches(s, verdict, str(tmp_path / "out"), str(tmp_path / "hist"), str(tmp_path / "cp"))
    jobs.run_available(w)
    got = jobs.current_anomalies(spark, str(tmp_path / "out"))
    drop = ("quality_event_ids",)
    assert replay_diff(got.drop(*drop), want.drop(*drop)).count() == 0


def test_enriched_stream_equals_batch(spark, tmp_path):
    r = t.readings(spark, SF).select(
        "event_id", "tenant_id", "tag_id", "tag_name", "value", "unit", "event_time", "ingest_time", "quality_flags"
    )
    dims = lambda: (t.tags(spark, SF), t.assets(spark, SF), t.components(spark, SF))
    want = enrich.enrich_readings(r, *dims())
    s = stream(spark, r, str(tmp_path / "in"))
    jobs.run_available(jobs.enrich_batches(s, dims, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = jobs.current_rows(spark, str(tmp_path / "out"), ["event_id"], ["ingest_time"])
    assert replay_diff(got, want).count() == 0


def test_json_stream_lands_once_and_windows_close(spark, tmp_path):
    lines = t.raw_json(spark, SF).select("value")
    lines.unionByName(lines).coalesce(1).write.text(str(tmp_path / "in"))
    s = jobs.readings_stream(jobs.json_files(spark, str(tmp_path / "in")))
    jobs.run_available(jobs.append_files(s, str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.select("event_id").distinct().count() > 800
    health = jobs.health_stream(s)
    jobs.run_available(jobs.append_files(health, str(tmp_path / "h"), str(tmp_path / "cph")))
    assert spark.read.parquet(str(tmp_path / "h")).count() > 0
