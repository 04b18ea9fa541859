"""Tables that are replaced part by part: keyed tables (upserts) and mart snapshots.

Both write new folders and then replace the manifest (see :mod:`manifest`), so a reader sees a whole state
before or after, and a job that dies in between changes nothing that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plantpulse.operators.latest import latest_by_key
from plantpulse.sources.manifest import Manifest, commit, read_folders, read_manifest

BUCKETS = 16


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


# --- keyed tables ----------------------------------------------------------------------------


def merge_batch(
    changes: DataFrame,
    path: str,
    keys: Sequence[str],
    version: str,
    ties: Sequence[str] = (),
    batch_id: int | None = None,
    buckets: int = BUCKETS,
) -> list[int]:
    """Merge ``changes`` into the table below ``path``: the newest row per key stays.  Returns the buckets rewritten.

    Keys are hashed to ``buckets`` (fixed by the first batch or :func:`compact`).  Only buckets with a change are
    read and written anew, each as one file, so a read takes one file per bucket however many batches there were.
    A ``batch_id`` not above the last one merged changes nothing, so a repeated batch leaves one version.
    The order of versions is ``version``, then ``ties``; keys may be NULL.
    """
    spark = changes.sparkSession
    old = read_manifest(spark, path)
    if batch_id is not None and batch_id <= old.mark:
        return []
    buckets = old.buckets or buckets
    changes = changes.withColumn("_bucket", bucket_of(keys, buckets)).persist()
    touched = [str(r[0]) for r in changes.select("_bucket").distinct().orderBy("_bucket").collect()]
    stored = read_folders(spark, old, touched)
    rows = changes if stored is None else stored.withColumn("_bucket", bucket_of(keys, buckets)).unionByName(changes)
    folder = _new_folder(path, old)
    _write_buckets(latest_by_key(rows, keys, version, ties), folder)
    new = {b: f"{folder}/_b={b}" for b in touched}
    schema = old.schema or changes.drop("_bucket").schema.json()
    commit(spark, path, Manifest(old.version + 1, old.mark if batch_id is None else batch_id, buckets, schema, old.folders | new))
    changes.unpersist()
    return [int(b) for b in touched]


def _new_folder(path: str, old: Manifest) -> str:
    return f"{path}/data/{old.version + 1:012d}-{uuid.uuid4().hex[:12]}"


def _write_buckets(rows: DataFrame, folder: str) -> None:
    rows.repartition(F.col("_bucket")).withColumn("_b", F.col("_bucket")).drop("_bucket").write.partitionBy("_b").parquet(folder)


def read_table(spark: SparkSession, path: str, keys: Sequence[str] = (), where: dict[str, object] | None = None) -> DataFrame:
    """The table's rows; with ``where`` (a value for each of ``keys``) only the bucket of that key is read."""
    manifest = read_manifest(spark, path)
    names = None
    if where is not None:
        one = spark.range(1).select(*[F.lit(where[k]).cast(_kind(manifest, k)).alias(k) for k in keys])
        names = [str(one.select(bucket_of(keys, manifest.buckets)).first()[0])] if manifest.buckets else []
    rows = read_folders(spark, manifest, names)
    if rows is None and not manifest.folders:
        raise ValueError(f"no table at {path}")
    if rows is None:  # a bucket without rows
        return spark.createDataFrame([], StructType.fromJson(json.loads(manifest.schema)))
    for k in keys if where is not None else ():
        rows = rows.filter(F.col(k).eqNullSafe(F.lit(where[k])))
    return rows


def _kind(manifest: Manifest, column: str) -> str:
    return StructType.fromJson(json.loads(manifest.schema))[column].dataType.simpleString()


def compact(spark: SparkSession, path: str, keys: Sequence[str], buckets: int) -> None:
    """Deal all rows to another number of buckets, in one new folder."""
    old = read_manifest(spark, path)
    rows = read_folders(spark, old)
    if rows is None:
        return
    folder = _new_folder(path, old)
    _write_buckets(rows.withColumn("_bucket", bucket_of(keys, buckets)), folder)
    filled = [r[0] for r in spark.read.parquet(folder).select("_b").distinct().collect()]
    commit(spark, path, Manifest(old.version + 1, old.mark, buckets, old.schema, {str(b): f"{folder}/_b={b}" for b in filled}))


# --- mart snapshots --------------------------------------------------------------------------


def refresh_snapshot(mart: DataFrame, path: str, snapshot_date: str) -> None:
    """Replace the snapshot of one day by the rows of ``mart``; other days stay.

    Every refresh writes a folder of its own; the manifest then names it for the day.  A refresh that
    fails, or dies before that, leaves the day's old snapshot; one run twice leaves one.
    """
    spark = mart.sparkSession
    rows = mart.withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
    old = read_manifest(spark, path)
    if old.schema and old.schema != rows.schema.json():
        raise ValueError(f"the mart at {path} has another schema")
    folder = _new_folder(path, old)
    rows.write.parquet(folder)
    commit(spark, path, Manifest(old.version + 1, schema=rows.schema.json(), folders=old.folders | {snapshot_date: folder}))


def read_snapshots(spark: SparkSession, path: str, snapshot_date: str | None = None) -> DataFrame:
    """Rows of all days' snapshots, or of one day; only its folder is read."""
    manifest = read_manifest(spark, path)
    rows = read_folders(spark, manifest, None if snapshot_date is None else [snapshot_date])
    if rows is None:
        raise ValueError(f"no snapshot at {path}")
    return rows


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest day."""
    return read_snapshots(spark, path, max(read_manifest(spark, path).folders, default=""))
