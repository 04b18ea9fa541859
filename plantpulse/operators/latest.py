"""Current state of a change feed: the newest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: Sequence[str], version: str, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Newest row per key.  ``row_number() = 1`` lets Spark keep one row per key *before*
    the shuffle (window group limit), so a key with very many changes stays cheap."""
    return latest_n(df, keys, [version, *tie_breakers], 1)


def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str | None = None) -> DataFrame:
    """Newest ``n`` rows per key, ordered by ``order`` descending.  ``rank`` keeps the row number."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rank: str | None = None) -> DataFrame:
    """Oldest ``n`` rows per key, ordered by ``order`` ascending."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc() for c in order])
    out = df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def dedup_events(df: DataFrame, keys: Sequence[str] = ("event_id",)) -> DataFrame:
    """Idempotent re-delivery.  Copies are collapsed map-side; a stream also needs a watermark."""
    if df.isStreaming:
        return df.dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def insert_new_only(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose id the target does not hold yet."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def upsert_latest(
    target: DataFrame, changes: DataFrame, keys: Sequence[str], version: str, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """Keyed upsert: the newest version wins, whichever side it comes from."""
    return latest_by_key(target.unionByName(changes), keys, version, tie_breakers)


def representative(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a fixed order (e.g. one tag per tenant and metric)."""
    return first_n(df, keys, order, 1)
