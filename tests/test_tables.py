"""Keyed tables and mart snapshots: merges, repeats, failures between writing and committing, cost of a read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.latest import latest_by_key
from plantpulse.plans import marts
from plantpulse.plans.reports import replay_diff
from plantpulse.sources import manifest, tables
from plantpulse.sources import testtables as t
from plantpulse.streaming import jobs

KINDS = "tenant_id string, id bigint, version int, note string"
KEYS = ["tenant_id", "id"]


def batch(spark, ids, version, note=""):
    return spark.createDataFrame([(None if i % 10 == 0 else "t", i, version, f"{note}{i}") for i in ids], KINDS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def data_files(df):
    return len(df.inputFiles())


def test_merges_keep_the_newest_row_and_read_one_file_per_bucket(spark, tmp_path):
    path, parts = str(tmp_path / "table"), []
    for n in range(12):
        part = batch(spark, range(n * 7, n * 7 + 60), n % 5, f"b{n}-")
        tables.merge_batch(part, path, KEYS, "version", ["note"], n, buckets=4)
        parts.append(part)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    got = tables.read_table(spark, path)
    assert rows(got) == rows(latest_by_key(whole, KEYS, "version", ["note"]))
    assert data_files(got) == 4


def test_only_touched_buckets_are_written_anew(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.merge_batch(batch(spark, range(200), 1), path, KEYS, "version", batch_id=0, buckets=8)
    before = manifest.read_manifest(spark, path).folders
    touched = tables.merge_batch(batch(spark, [5], 2, "new"), path, KEYS, "version", batch_id=1, buckets=99)
    after = manifest.read_manifest(spark, path).folders
    assert len(before) == 8 and len(touched) == 1
    assert [b for b in before if before[b] != after[b]] == [str(touched[0])]
    one = tables.read_table(spark, path, KEYS, {"tenant_id": "t", "id": 5})
    assert rows(one) == [("t", 5, 2, "new5")] and data_files(one) == 1
    assert rows(tables.read_table(spark, path, KEYS, {"tenant_id": None, "id": 10})) == [(None, 10, 1, "10")]


def test_a_repeated_or_older_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in (0, 1, 1, 0):
        tables.merge_batch(batch(spark, range(10), n, f"b{n}-"), path, KEYS, "version", batch_id=n)
    m = manifest.read_manifest(spark, path)
    assert (m.version, m.mark) == (2, 1)
    assert rows(tables.read_table(spark, path)) == rows(batch(spark, range(10), 1, "b1-"))


def test_a_crash_between_write_and_manifest_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    tables.merge_batch(batch(spark, range(30), 1, "old"), path, KEYS, "version", batch_id=0)
    want = rows(tables.read_table(spark, path))

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(tables, "commit", die)
        with pytest.raises(RuntimeError):
            tables.merge_batch(batch(spark, range(30), 2, "new"), path, KEYS, "version", batch_id=1)
    assert rows(tables.read_table(spark, path)) == want
    tables.merge_batch(batch(spark, range(30), 2, "new"), path, KEYS, "version", batch_id=1)
    assert rows(tables.read_table(spark, path)) == rows(batch(spark, range(30), 2, "new"))
    tables.merge_batch(batch(spark, [1], 3), path, KEYS, "version", batch_id=2)
    whole = rows(tables.read_table(spark, path))
    assert manifest.vacuum(spark, path) == 2  # the dead attempt's folder, and batch 0's, which both slots have left
    assert rows(tables.read_table(spark, path)) == whole and manifest.vacuum(spark, path) == 0


def test_a_torn_manifest_is_not_read(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.merge_batch(batch(spark, range(30), 1), path, KEYS, "version", batch_id=0)
    old = manifest.read_manifest(spark, path)
    torn = spark.createDataFrame([(old.version + 1, 16, 9, 16, old.schema, "0", "nowhere")], manifest._SCHEMA)
    torn.write.mode("overwrite").parquet(f"{path}/manifest/slot={(old.version + 1) % 2}")
    assert manifest.read_manifest(spark, path) == old


def test_compaction_keeps_all_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.merge_batch(batch(spark, range(300), 1), path, KEYS, "version", batch_id=4, buckets=16)
    want = rows(tables.read_table(spark, path))
    tables.compact(spark, path, KEYS, 2)
    assert rows(tables.read_table(spark, path)) == want and data_files(tables.read_table(spark, path)) == 2
    tables.merge_batch(batch(spark, [7], 2, "x"), path, KEYS, "version", batch_id=5)
    assert rows(tables.read_table(spark, path).filter("id = 7")) == [("t", 7, 2, "x7")]
    assert manifest.read_manifest(spark, path).mark == 5
    with pytest.raises(ValueError, match="no table"):
        tables.read_table(spark, str(tmp_path / "none"))


def test_streamed_upserts_equal_the_batch_form(spark, tmp_path):
    for n in range(4):
        batch(spark, range(n * 5, n * 5 + 20), n, f"b{n}-").coalesce(1).write.parquet(str(tmp_path / f"in/part{n}"))
    source = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    path = str(tmp_path / "table")
    jobs.run_available(jobs.merge_batches(source, path, str(tmp_path / "cp"), KEYS, "version", ["note"], 4))
    want = latest_by_key(spark.read.schema(KINDS).parquet(str(tmp_path / "in/*")), KEYS, "version", ["note"])
    assert rows(tables.read_table(spark, path)) == rows(want)
    assert manifest.read_manifest(spark, path).mark == 3


def test_refreshed_marts_have_one_snapshot_per_day(spark, tmp_path, monkeypatch):
    sf, path = "/root/testdata/sf0.001", str(tmp_path / "mart")
    as_of = "2024-02-01 00:00:00"
    mart = marts.signal_series(t.measured(spark, sf), t.tags(spark, sf), as_of=as_of, lookback="60 DAYS")
    for _ in range(2):
        tables.refresh_snapshot(mart, path, "2024-02-01")
    tables.refresh_snapshot(mart.limit(3), path, "2024-02-02")
    day = tables.read_snapshots(spark, path, "2024-02-01").drop("snapshot_date")
    assert replay_diff(day, mart).count() == 0
    assert tables.latest_snapshot(spark, path).count() == 3
    assert tables.read_snapshots(spark, path).count() == mart.count() + 3
    broken = mart.limit(3).withColumn("bucket_minute", F.raise_error(F.lit("bad row")).cast("timestamp_ntz"))
    with pytest.raises(Exception, match="bad row"):
        tables.refresh_snapshot(broken, path, "2024-02-02")
    assert tables.latest_snapshot(spark, path).count() == 3
    with pytest.raises(ValueError, match="another schema"):
        tables.refresh_snapshot(mart.withColumn("more", F.lit(1)), path, "2024-02-02")
