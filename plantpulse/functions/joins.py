"""Joins on keys that may be NULL; rows dealt over all tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Equi-join in which NULL meets NULL (for inner, left, semi and anti joins).

    The keys meet as one struct, which is never NULL itself.  ``small``: the right side has a size bound that
    the caller knows, and is broadcast.
    """
    same = F.struct(*[F.col(k) for k in keys]).alias("_same")
    other = right.select(same, *[c for c in right.columns if c not in keys])
    return left.withColumn("_same", same).join(F.broadcast(other) if small else other, "_same", how).drop("_same")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as a shuffle has, for few bytes that become much work.

    The number is given, so that adaptive execution, which sees the bytes only, does not merge the tasks again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
