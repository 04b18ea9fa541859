"""A manifest that says which folders make up a table; replaced as a whole.

A manifest is one small table of rows (name, folder). A new version is written over the older of two
slots, so the newer one is whole at any time: a writer that dies leaves the version before. Every row
tells how many rows its version has, and a slot with fewer is not read. One writer at a time is assumed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SCHEMA = "version bigint, n_rows bigint, mark bigint, buckets int, schema string, name string, folder string"


@dataclass
class Manifest:
    """``mark``: the last batch taken in (-1: none); ``buckets``: of a keyed table; ``schema``: the rows' schema as JSON; ``folders``: by name."""

    version: int = 0
    mark: int = -1
    buckets: int = 0
    schema: str = ""
    folders: dict[str, str] = field(default_factory=dict)


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest whole version below ``path``; an empty one if there is none.  Bounded by the table's folders, not its rows."""
    for slot in (0, 1):  # so that both can be listed
        if not _exists(spark, f"{path}/manifest/slot={slot}"):
            spark.createDataFrame([], _SCHEMA).write.mode("ignore").parquet(f"{path}/manifest/slot={slot}")
    rows = (
        spark.read.schema(_SCHEMA).option("ignoreMissingFiles", "true").parquet(f"{path}/manifest/slot=0", f"{path}/manifest/slot=1").collect()
    )
    whole = [v for v in {r.version for r in rows} if sum(r.version == v for r in rows) == next(r.n_rows for r in rows if r.version == v)]
    if not whole:
        return Manifest()
    mine = [r for r in rows if r.version == max(whole)]
    return Manifest(mine[0].version, mine[0].mark, mine[0].buckets, mine[0].schema, {r.name: r.folder for r in mine if r.name is not None})


def commit(spark: SparkSession, path: str, new: Manifest) -> None:
    """Write ``new`` over the slot its version does not share with the version before."""
    names = sorted(new.folders) or [None]
    rows = [(new.version, len(names), new.mark, new.buckets, new.schema, n, new.folders.get(n)) for n in names]
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/slot={new.version % 2}")


def read_folders(spark: SparkSession, manifest: Manifest, names: list[str] | None = None) -> DataFrame | None:
    """The rows of the folders of these names (default: all); None where there are none."""
    folders = sorted({manifest.folders[n] for n in (manifest.folders if names is None else names) if n in manifest.folders})
    if not folders:
        return None
    return spark.read.schema(T.StructType.fromJson(json.loads(manifest.schema))).parquet(*folders)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete data folders that no version in either slot names; how many.  Not while readers hold an older version."""
    kept = {r.folder for r in spark.read.schema(_SCHEMA).parquet(f"{path}/manifest/slot=0", f"{path}/manifest/slot=1").select("folder").collect()}
    store, root = _store(spark, f"{path}/data")
    gone = 0
    for run in store.listStatus(root) if store.exists(root) else []:
        at = f"{path}/data/{run.getPath().getName()}"
        if not any(f == at or f.startswith(f"{at}/") for f in kept if f):
            gone += store.delete(run.getPath(), True)
    return gone


def _store(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _exists(spark: SparkSession, path: str) -> bool:
    store, where = _store(spark, path)
    return store.exists(where)

